"""Secret spans against a plain version that looks at all pairs of parts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import secrets

VALUE = r"""["']?\x20*[:=]\x20*["']?"""
PLAIN = [
    (f"(?ai:password|passwd|secret|token|api_?key){VALUE}([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
    ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
    (f"(?ai:user(name)?|login|account|client_?id){VALUE}[A-Za-z0-9_.@-]{{3,}}", lambda m: True),
    ("[A-Za-z0-9+/]{32,}", lambda m: len(m[0]) <= 128 and all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))),
    ("(https?|ftp|ssh|s3|postgres(ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@-]+", lambda m: True),
]
KEY, HASH, TOKEN = "AKIA" + "B7" * 8, "0a1b" * 7, "aB3" * 11
PARTS = [KEY, KEY[:19], HASH, HASH[:23], TOKEN, TOKEN * 4, 'password="hunter22"', "Token : abc", "secret: token: abcdefgh", "API_KEY=" + TOKEN, "user=bob", "Login: 'alice.b'", "client_id=" + TOKEN, "https://example.org:8080/x", "postgres://u:p@db", "user: " + KEY]
PARTS += ["\n", "\n\n", "\n \t\r\n", "\n\n\n", "word", "日本 \U0001f600", " ", ", ", "x" * 90, "lorem ipsum " * 18, "Kelvin Ky tokзn toKen=abcdefgh"]


def plain(text):
    text = text or ""
    found = [[(m.start(), k, m.end()) for m in re.finditer(p, text) if keep(m)] for k, (p, keep) in enumerate(PLAIN)]
    base = sorted(sum(found[:3], []))
    parts = base + [w for w in sum(found[3:], []) if not any(b[0] <= w[0] and w[2] <= b[2] for b in base)]
    near = lambda x, y: x[2] <= y[0] <= x[2] + 200 and breaks(x) == breaks(y)
    blanks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    breaks = lambda x: sum(b <= x[0] for b in blanks)
    both = lambda x, y: near(x, y) or near(y, x)
    of = lambda *kinds: [p for p in parts if p[1] in kinds]
    members = {p for i in of(1, 3) for s in of(0, 2, 4) if both(i, s) for p in (i, s)}
    told = members | {e for e in of(5) if any(both(e, m) for m in members)}
    return base, sorted(set(base) | {p for p in told if p[1] >= 3})


def texts():
    r = random.Random(4)
    out = [None, "", " \n\n ", "".join(PARTS), KEY * 3, HASH * 50, "user=abc password=abcdef " * 400]
    out += [f"user=bob{' ' * n}{TOKEN} ftp://h{' ' * m}x" for n in (199, 200, 201) for m in (0, 300)] + [f"{TOKEN}{' ' * n}user=bob" for n in (200, 201)]
    out += ["".join(r.choice(PARTS) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(1, 30))) for _ in range(300)]
    return out + ["same " + KEY + " " + TOKEN] * 5


@pytest.mark.parametrize("run", [secrets.RUN, 2])
def test_spans(spark, monkeypatch, run):
    monkeypatch.setattr(secrets, "RUN", run)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "id", "base", "spans", "start", "kind", "scope", "part", "hex")}).repartition(3)
    out = secrets.scan_secrets(docs)
    got = Counter((r.doc_id, tuple(map(tuple, r.base)), tuple(map(tuple, r.spans))) for r in out.collect())
    assert got == Counter((i, *map(tuple, plain(t))) for i, t in rows)
    assert any(p[1] == k for _, _, spans in got for p in spans for k in (3, 4, 5))
    assert secrets.scan_secrets(docs.limit(0)).isEmpty()


def test_a_long_text_with_very_many_spans(spark):
    """8 MB in one row: 200 000 matches, linear in them."""
    text = "user=bob " + "0123456789abcdef01234567 token=abcdefg\n" * 200_000
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(row.base) == 400_000 and len(row.spans) == 400_001
    assert [tuple(s) for s in row.spans[-2:]] == [(len(text) - 39, 2, len(text) - 15), (len(text) - 14, 0, len(text) - 1)]


def test_only_functions_run_on_the_texts(spark):
    """No Python worker in the plan of the scan or of the result."""
    docs = spark.createDataFrame([(1, KEY + " " + TOKEN)], "doc_id long, text string")
    plan = secrets.scan_secrets(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
