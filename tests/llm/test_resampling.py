"""Importance resampling against a plain version of its contract."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ranks, resampling

from .test_operators import cases, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, longest=2):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n_buckets=10000, longest=2, percent=25, least=20, seed=7):
    """(doc_id, text) and texts to Counter of (doc_id, n_features, weight, score), and the drawn (score, id) in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    found = [features(t, longest) for _, t in docs]
    s = Counter(bucket(f) for _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + n_buckets) / ((s[b] + 1.0) * (T + n_buckets))))
    rows = []
    for (i, _), (n, fs) in zip(docs, found):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted(((-r[3], r[0] is None, r[0] or 0) for r in rows if r[4] >= least))
    return Counter(r[:4] for r in rows), [(-a, None if b else c) for a, b, c in fit[: percent * len(fit) // 100]]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(cases(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("id", "slice", "nth", "range", "place", "score", "weight", "rank", "n_words", "salt")}).repartition(3)


@pytest.mark.parametrize("case", ["whole", "one text a slice", "many groups"])
def test_resampling(spark, docs, monkeypatch, case):
    if case == "one text a slice":
        monkeypatch.setattr(resampling, "SLICE_TEXTS", 1)
    if case == "many groups":
        monkeypatch.setattr(resampling, "GROUP_BYTES", 50)
        monkeypatch.setattr(resampling, "SLICE_TEXTS", 2)
    target = [prose(3, 40), prose(77, 30), None, "", "Été 日本語 été"]
    goal = spark.createDataFrame([(t,) for t in target], "text string").withColumn("id", F.lit(1))
    out = resampling.resample(docs, goal).collect()
    want, drawn = plain([r[:2] for r in cases()], target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in out) == want
    ranked = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r.score, r.doc_id) for r in ranked] == drawn


def test_other_widths(spark, docs):
    goal = spark.createDataFrame([(prose(3, 40),)], "body string")
    out = resampling.resample(docs, goal, percent=50, least_words=5, n_buckets=13, longest=3, seed=1, target_text_col="body").collect()
    want, drawn = plain([r[:2] for r in cases()], [prose(3, 40)], 13, 3, 50, 5, 1)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in out) == want
    assert sorted((r["rank"], r.score, r.doc_id) for r in out if r["rank"]) == [(k + 1, *d) for k, d in enumerate(drawn)]


def test_empty_tables(spark, docs):
    goal = spark.createDataFrame([(None,)], "text string")
    assert resampling.resample(docs.limit(0), goal).isEmpty()
    out = resampling.resample(docs, goal.limit(0)).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in out) == plain([r[:2] for r in cases()], [])[0]


def test_a_third_of_all_rows_alike(spark):
    """Copies of one id and text are still dealt to many partitions, and each has a rank of its own or none."""
    rows = [(1, prose(1, 30))] * 2000 + [(i, prose(i, 25)) for i in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = resampling.resample(df, df.limit(1)).where("rank is not null").select("rank")
    assert sorted(r[0] for r in out.collect()) == list(range(1, 2398 // 4 + 1))


def test_places_of_a_key_in_many_partitions(spark):
    rows = [(5, i % 7, i) for i in range(500)] + [(k, 0, 1000 * k) for k in range(-3, 60) if k != 5] * 2
    df = spark.createDataFrame(rows, "k long, a long, b long")
    got = ranks.numbered(df, [F.col("k"), F.col("a").desc(), F.col("b")], key="k").collect()
    assert sorted(map(tuple, got)) == sorted((*r, p) for k in {r[0] for r in rows} for p, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))))
