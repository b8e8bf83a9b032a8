"""The trie of conversations against one that is made of whole sequences."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie

from .test_operators import prose, words


def plain(rows, family=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        head = c - int(c - family * int(c / family))
        whole = tuple(own.get(head, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[q] for q in children[p]]
        saved = (len(members[p]) - 1) * len(words(p[-1][1])) if p else 0
        totals[p] = (sum(x for x, _ in below) or 1, saved + sum(y for _, y in below))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *totals[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def tables():
    r = random.Random(8)
    texts = [prose(k, r.randrange(8)) for k in range(6)] + [None, "", " \n", "日本 語"]
    out = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(texts)) for c in range(-30, 90) if c % 20 or c % 40 for t in range(r.choice([1, 1, 2, 3, 6, 12]))]
    out += [(200 + c, t, "user", f"same {t}") for c in range(90) for t in range(4)]  # copies
    out += [(300 + c, t, "user", f"deep {t}" if t < 60 else f"own {c}") for c in range(5) for t in range(70)]
    out += [(400, t, "user", "long") for t in range(500)] + [(None, 0, "user", "of none"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "user", "tie of another")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("most", [64, 1, 7])
def test_trie(spark, monkeypatch, most):
    """Few and many levels of the cluster; hot keys broadcast."""
    monkeypatch.setattr(prefix_trie, "SUBTREE_CONVERSATIONS", most)
    rows = [x for x in tables() if most > 1 or x[0] is None or x[0] < 300]  # a level takes seconds
    if most == 7:
        monkeypatch.setattr(prefix_trie, "HOT_SHARE", 0.05)
        monkeypatch.setattr(prefix_trie, "SUBTREE_TURNS", 700)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "place", "depth", "n", "node", "size", "n_words", "band")})
    got = prefix_trie.prefix_trie(df.repartition(3))
    assert sorted(map(tuple, got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: r[:2]) == plain(rows)


def test_other_rebuildings(spark):
    rows = [x for x in tables() if x[0] is None or x[0] < 60]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.prefix_trie(df, family=7, most=3).collect()), key=lambda r: r[:2]) == plain(rows, 7, 3)


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([(25, 0, "user", "a b"), (26, 0, "user", "c"), (None, 1, "x", "y")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df.limit(0)).isEmpty() and prefix_trie.prefix_trie(df.where("conv_id is null")).isEmpty()
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect())) == plain([(25, 0, "user", "a b"), (26, 0, "user", "c")])
