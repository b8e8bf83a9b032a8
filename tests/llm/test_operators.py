r"""Each operator against a plain version of its contract, on a small table with every odd case in it."""

from __future__ import annotations

import math
import pickle
import random
import struct
import time
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, language, language_model, near_duplicates, packing, quality, repeats, resampling, secrets, sharding, token_counts, token_files, tokenization

PATH = public_tokenizers.path("byte_bpe_50k.json")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def cases() -> list[tuple]:
    base, tail = prose(1, 120), prose(2, 60)
    texts = [None, "", " \n\t ", "One", "two words", base, base, base.upper(), base + " extra", " ".join(base.split()[:-3]), tail + "\n" + base, "x " * 300, "<|endoftext|> and a <|endoftext|>b"]
    texts += ["lété à la mer  d’or\x85 日本語 \U0001f600", "a  b\n\n c  d", "\x0b\x0c\r", "!!! ### 123", prose(3, 12000), "same same", "same same"]
    texts += ["\n".join([prose(9, 6)] * 8), prose(4, 40) + " | " * 30]
    rows = [(i if i != 18 else 19, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, "de", "s", 0), (7, base.upper(), "en", "s", 1), (None, prose(5, 50), "de", "s", 9)]
    rows += [(100 + i, prose(50 + i, 30) + " der die und", "de" if i % 3 else "en", "s", 1) for i in range(12)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that operators make themselves are there under the same names already.
    df = spark.createDataFrame(cases(), "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("x") for c in ("n_words", "n_tokens", "key", "id", "score", "shard", "bucket", "length", "contaminated", "kept", "batch", "c0")}
    return df.withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().split()


def low_words(t):
    return (t or "").encode().translate(LOWER).split()


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(t):
    return tokenizer().encode(t or "", add_special_tokens=False).ids


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def bag(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


# -- arrays --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("width", [1, 2, 3, 5, 13, 35])
def test_rolling_hashes(width):
    h = np.random.default_rng(1).integers(0, 1 << 63, 80).astype(np.uint64)
    want = [sum(int(h[i + k]) * pow(int(common.MULT), width - 1 - k, 1 << 64) for k in range(width)) % (1 << 64) for i in range(80 - width + 1)]
    assert common.rolling(h, width).tolist() == want
    assert len(common.rolling(h[:2], 3)) == 0


def test_slices_keep_all_rows():
    texts = ["a" * n for n in (3, 0, 50, 1, 1, 1, 90)] + [None]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    out = list(common.text_slices(iter([batch, batch]), "text", 52))
    assert sum((b.column(0).to_pylist() for b in out), []) == texts * 2
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(0).to_pylist()) <= 52 for b in out)


def random_texts():
    r = random.Random(3)
    return ["".join(r.choice("aabBz 'st\n\t\xa0 \xe91%日., \x1c") for _ in range(r.randrange(60))) for _ in range(1500)]


def test_encoding_is_the_library_s(monkeypatch):
    texts = random_texts() + [t for _, t, *_ in cases()]
    want = [ids(t) for t in texts]
    monkeypatch.setattr(tokenization, "REMEMBERED", 300)
    monkeypatch.setattr(tokenization, "_ENCODERS", {})
    for _ in range(2):
        flat, n = tokenization.encode(pa.array(texts), PATH)
        assert n.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_merging_counts_are_the_library_s():
    texts = random_texts() + [t for _, t, *_ in cases()] + ["a" * 3000, "ab" * 900]
    assert token_counts.text_counts(pa.array(texts), PATH).tolist() == [len(ids(t)) for t in texts]


# -- 1 language ----------------------------------------------------------------------------------------------
def test_automaton_has_all_substrings_and_no_others():
    r = random.Random(5)
    s = [r.randrange(3) for _ in range(60)]
    go = language.automaton(s)
    inside = {tuple(s[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(3000):
        x = [r.randrange(3) for _ in range(r.randrange(1, 8))]
        state = 0
        for c in x:
            state = go[state].get(c) if state is not None else None
        assert (state is not None) == (tuple(x) in inside)


@pytest.mark.parametrize("cells", [8_000_000, 10])
def test_phrases_are_the_greedy_parse(monkeypatch, cells):
    """Of whole texts, longer than a block, with tables and with hash tables of moves, and more letters than a byte."""
    monkeypatch.setattr(language, "TABLE_CELLS", cells)
    r = random.Random(31)
    han = [chr(0x4E00 + k) for k in range(400)]
    samples = {"en": [prose(11, 80)], "de": [prose(12, 80) + " über schön"], "ja": ["".join(r.choices(han, k=900))]}
    parser = language.CrossParser(samples)
    texts = [prose(13, 370), "Straße 日本", "x", prose(11, 60), "a" * 700, samples["ja"][0][100:500] + "".join(r.choices(han, k=200)), prose(12, 50) + "ψω" + prose(11, 50), "", "1 2"]
    got, _ = parser.phrases(texts)
    for i, t in enumerate(texts):
        low = language.letters([t])[0].tolist()
        for k, lang in enumerate(parser.languages):
            text = language.letters(samples[lang])[0].tolist()
            known = {c for s in samples.values() for c in language.letters(s)[0].tolist()} | {0}
            source, n, phrase = ",".join(map(str, ["", *text, ""])), sum(c not in known for c in low) + bool(low), []
            for c in low:
                if c not in known:
                    continue
                phrase.append(c)
                if "," + ",".join(map(str, phrase)) + "," not in source:
                    n, phrase = n + 1, [c] if f",{c}," in source else []
            assert got[i, k] == pytest.approx(n * parser.scale[k])


def test_many_languages_are_learnt():
    samples = {f"l{k:03d}": ["".join(chr(0x4E00 + 40 * k + (7 * i * i + i) % 40) for i in range(60))] for k in range(300)}
    parser = language.CrossParser(samples)
    got, _ = parser.predict([samples[x][0][5:50] for x in ("l000", "l123", "l299")])
    assert got == ["l000", "l123", "l299"]


def test_language_of_odd_texts(docs, empty):
    rows = language.identify_language(docs, docs, also=("lang",)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in rows)
    und = language.identify_language(docs, docs).where("lang_pred = 'und'").collect()
    assert {r["doc_id"] for r in und} == {None, 0, 1, 2, 15, 16}
    assert language.identify_language(empty, docs).count() == 0
    assert {r["lang_pred"] for r in language.identify_language(docs, empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    out = language.identify_language(d.where(rest == 1), d.where(rest != 1), also=("lang",))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_languages_of_long_or_copied_texts_are_learnt(spark):
    long = [" ".join(f"{w}el" for w in prose(70 + k, 9000).split()) for k in range(3)]
    assert min(map(len, long)) > language.SAMPLE_TEXT_CHARS
    copied = "zwq xoyv uwq yoq vuxy " * 40
    train = spark.createDataFrame([("long", t) for t in long] + [("late", "1 2 " * 9000 + "быстрая лиса " * 90), ("few", prose(75, 60).replace("e", "i"))], "lang string, text string")
    train = train.unionByName(spark.range(60_000).select(F.lit("copied").alias("lang"), F.lit(copied).alias("text")))
    sample = language.labelled_sample(train, "lang", "text")
    assert {k: len(v) for k, v in sample.items()} == {"long": 3, "late": 1, "few": 1, "copied": 1}
    assert all(len(t) <= language.SAMPLE_TEXT_CHARS and language.letters([t])[0].any() for v in sample.values() for t in v)
    docs = spark.createDataFrame([(1, long[0][:900]), (2, "лиса быстрая"), (3, copied[:200])], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify_language(docs, train).collect()} == {1: "long", 2: "late", 3: "copied"}
    only = language.identify_language(docs, train.where("lang = 'long'")).collect()
    assert {r["lang_pred"] for r in only} == {"long"}


# -- 2 quality -----------------------------------------------------------------------------------------------
def plain_features(t):
    t = t or ""
    w = words(t)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [any(win[tuple(w[i : i + 8])] > 1 for i in range(max(0, j - 7), min(j, len(w) - 8) + 1)) for j in range(len(w))]
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(hit)


def test_quality(docs, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality.quality_report(docs).collect()
    want = Counter((i, *f, f[0] < 20 or 100 * f[4] > 30 * f[0]) for i, t, *_ in cases() for f in [plain_features(t)])
    assert bag(rows, "doc_id", *names, "base_failed") == want
    assert all(r["kept"] == (r["failed_rule"] is None) and not (r["kept"] and r["base_failed"]) for r in rows)
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.quality_report(empty).count() == 0 and quality.keep_quality(empty).count() == 0


def test_the_cascade_is_the_sum_of_its_rules_in_any_order():
    t = pa.array([t for _, t, *_ in cases()])
    want = np.logical_or.reduce([r.rejects(quality.Texts(t)) for r in quality.RULES])
    for rules in (quality.RULES, quality.RULES[::-1], quality.order_rules(quality.RULES, t)):
        assert [f is not None for f in quality.cascade(quality.Texts(t), rules)] == want.tolist()


def test_equal_hashes_of_unlike_windows_are_told_apart(monkeypatch):
    t = quality.Texts(pa.array([prose(1, 60), prose(2, 30) + " " + prose(2, 30)]))
    want = quality.n_repeat_words(t).tolist()
    monkeypatch.setattr(quality, "rolling", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    assert quality.n_repeat_words(quality.Texts(t.texts)).tolist() == want


# -- 3 token counts ------------------------------------------------------------------------------------------
def test_token_counts(docs, empty):
    rows = token_counts.count_tokens(docs, PATH).collect()
    want = Counter((i, len((t or "").encode()), n, n > 512) for i, t, *_ in cases() for n in [len(ids(t))])
    assert bag(rows, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty, PATH).count() == 0


# -- 4 near duplicates ---------------------------------------------------------------------------------------
def plain_groups(rows):
    sets = []
    for _, t in rows:
        w = low_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return Counter((d, len(s), (min(least[root(i)]) if least[root(i)] else None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_near_duplicates(docs, empty):
    rows = near_duplicates.near_duplicate_groups(docs).collect()
    assert bag(rows, "doc_id", "n_shingles", "component_id") == plain_groups([(i, t) for i, t, *_ in cases()])
    assert near_duplicates.near_duplicate_groups(empty).count() == 0


@pytest.mark.parametrize("points, rounds", [(256, 6), (12, 6), (12, 0)])
def test_chains_of_near_copies(spark, monkeypatch, points, rounds):
    """Chains, borderline pairs and a hot group, with regions whole, divided and met as pairs of parts."""
    monkeypatch.setattr(near_duplicates, "TASK_POINTS", points)
    monkeypatch.setattr(near_duplicates, "ROUNDS", rounds)
    r, rows = random.Random(8), []
    for g in range(6):
        w = prose(900 + g, 60).split()
        for _ in range(25):
            rows.append((len(rows), " ".join(w)))
            if r.random() < 0.7:
                w = list(w)
                for _ in range(r.randrange(1, 4)):
                    w[r.randrange(len(w))] = prose(r.randrange(10**6), 1)
    rows += [(len(rows) + i, prose(900, 60)) for i in range(40)]
    got = near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert bag(got, "doc_id", "n_shingles", "component_id") == plain_groups(rows)


# -- 5 decontamination ---------------------------------------------------------------------------------------
def plain_words(t):
    out, now = [], b""
    for c in (t or "").encode().translate(LOWER) + b" ":
        if 48 <= c < 58 or 97 <= c < 123 or c >= 128:
            now += bytes([c])
        elif now:
            out.append(now)
            now = b""
    return out


def test_decontamination(spark, docs, empty, monkeypatch):
    base = prose(1, 120).split()
    items = [(1, " ".join(base[5:40])), (2, "Two-words!"), (10, " ".join(base[10:23])), (3, None), (4, " ... "), (None, " ".join(base[60:80])), (5, prose(77, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for k in range(max(len(w) - 12, min(len(w), 1))):
            found[tuple(w[k : k + 13])].add("" if i is None else str(i))
    want = Counter()
    for d, t, *_ in cases():
        w, have = plain_words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if owners := found.get(tuple(w[k : k + n])):
                    have |= owners
                    hit[k : k + n] = [True] * n
        spans = [(k, next((j for j in range(k, len(w)) if not hit[j]), len(w))) for k in range(len(w)) if hit[k] and (k == 0 or not hit[k - 1])]
        want[d, len(w), sum(hit), tuple(sorted(have)), tuple(spans), sum(hit) > 0 and 20 * sum(hit) >= len(w)] += 1
    for block, held in ((8 << 20, 64 << 20), (10, 64 << 20), (10, 0)):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontamination, "HELD_BYTES", held)
        out = decontamination.find_benchmark(docs.select("doc_id", "text"), bench).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), tuple((s["from"], s["to"]) for s in r["spans"]), r["contaminated"]) for r in out) == want
    assert sum(n for x, n in want.items() if x[-1]) > 3
    wide = decontamination.find_benchmark(docs, bench)
    assert wide.columns[: len(docs.columns)] == docs.columns and wide.count() == docs.count()
    assert decontamination.find_benchmark(empty, bench).count() == 0
    assert decontamination.find_benchmark(docs.select("doc_id", "text"), bench.limit(0)).where("n_hit > 0").count() == 0


def test_only_blocks_that_can_occur_are_opened(monkeypatch, tmp_path):
    """Of many blocks, a slice without long runs of their words opens none, and one with a phrase its own block."""
    phrases = [prose(1000 + k, 40) for k in range(30)]
    names, opened = [], []
    for k, t in enumerate(phrases):
        made = decontamination.Phrases([(str(k), t)], 13)
        names.append(str(tmp_path / str(k)))
        for end, kept in (("", made), (decontamination.WORDS, (made.vocabulary, made.rarest(), 13))):
            (tmp_path / f"{k}{end}").write_bytes(pickle.dumps(kept))
    real = decontamination.load
    monkeypatch.setattr(decontamination, "load", lambda uri: opened.append(uri) or real(uri))

    def slices(text):
        opened.clear()
        words_, counts = decontamination.plain_words(pa.array([text]))
        found = [len(s.occurrences(p)[0]) for s in [decontamination.Shard(words_, counts, names)] for p in s.to_open()]
        return sum(found), sum(not o.endswith(decontamination.WORDS) for o in opened)

    assert slices(" ".join(f"other{i}" for i in range(500))) == (0, 0)
    assert slices(" ".join(phrases[7].split()[:12])) == (0, 0)
    times, blocks = slices("before " + phrases[7] + " after")
    assert times == 28 and 1 <= blocks <= 30
    assert len(decontamination.Phrases([("x", None), ("y", "...")], 13).rarest()) == 0


def test_partitions_of_100_tb_are_bounded(spark):
    """By sizes alone: parts of token files, and runs of shards' buckets."""
    whole = 100 << 40
    n = common.partitions_for(spark, whole)
    assert n <= 1 << 16 and (1 << 30) < whole / n < (2 << 30) and common.partitions_for(spark, 1 << 40) == 1 << 15
    buckets = -(-whole // (24 * sharding.BUCKET_BYTES)) * 24
    run = sharding.run_of(buckets)
    assert buckets / run <= 1 << 16 and run * sharding.BUCKET_BYTES < 2 << 30 and sharding.run_of(1000) == sharding.RUN


@pytest.mark.parametrize("n_symbols", [2, 5, 300])
def test_index_finds_what_is_there(n_symbols):
    r = np.random.default_rng(2)
    sizes = r.integers(1, 40, 30)
    symbols = r.integers(1, n_symbols, int(sizes.sum()))
    index = decontamination.FMIndex(symbols, sizes, n_symbols)
    first = np.cumsum(sizes) - sizes
    patterns = [symbols[a : a + n].tolist() for a, n in zip(r.integers(0, len(symbols) - 6, 60), r.integers(1, 6, 60))]
    back = np.zeros((6, len(patterns)), np.int64)
    for k, p in enumerate(patterns):
        back[: len(p), k] = p[::-1]
    low, high = index.search(back)
    for k, p in enumerate(patterns):
        want = [int(f + i) for f, n in zip(first, sizes) for i in range(n - len(p) + 1) if symbols[f + i : f + i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(low[k], max(low[k], high[k]))).tolist()) == want


# -- 6 token files -------------------------------------------------------------------------------------------
def test_token_files(spark, docs, empty):
    uri = token_files.write_token_files(docs, PATH, 2)
    rows = sorted(token_files.read_token_files(spark, uri, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, *_ in cases()), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), crc(r["ids"]))
        at += r["n_tokens"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((i, (*ids(t), 2)) for i, t, *_ in cases())
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, PATH, 2)).count() == 0


# -- 7 repeats -----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("width", [35, 3])
def test_repeats(docs, empty, width):
    rows = repeats.remove_repeats(docs.select("doc_id", "text"), width).collect()
    seen = Counter(tuple(w[k : k + width]) for _, t, *_ in cases() for w in [words(t)] for k in range(len(w) - width + 1))
    want = Counter()
    for i, t, *_ in cases():
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    assert bag(rows, "doc_id", "n_words", "n_removed", "kept") == want
    for r in rows:
        assert sum(s["to"] - s["from"] for s in r["removed"] or []) == r["n_removed"]
    if width == 35:
        wide = repeats.remove_repeats(docs)
        assert wide.columns[: len(docs.columns)] == docs.columns and wide.count() == docs.count()
        assert repeats.remove_repeats(empty).count() == 0


def test_windows_of_equal_half_hashes_are_told_apart(docs, monkeypatch):
    """Half of the hash bits forged to be the same for all words."""
    src = docs.select("doc_id", "text")
    want = bag(repeats.remove_repeats(src).collect(), "doc_id", "n_words", "n_removed", "kept")
    honest = repeats.hash_words
    for forged in (0, repeats.SEED):
        monkeypatch.setattr(repeats, "hash_words", lambda v, seed=0, forged=forged: np.ones(len(v), np.uint64) if seed == forged else honest(v, seed))
        assert bag(repeats.remove_repeats(src).collect(), "doc_id", "n_words", "n_removed", "kept") == want


def test_repeats_within_a_text(spark):
    """Runs of one word, of two, and passages that begin and end in repeated words."""
    r = random.Random(12)
    texts = [" ".join("a" for _ in range(n)) for n in (34, 35, 36, 90)] + ["u v " * 40, prose(1, 30) + " " + "y " * 36 + prose(2, 30)]
    shared = prose(3, 50).split()
    texts += [" ".join(prose(90 + k, r.randrange(5)).split() + shared[k % 7 : 36 + k] + prose(80 + k, 9).split()) for k in range(9)]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    seen = Counter(tuple(w[k : k + 35]) for t in texts for w in [words(t)] for k in range(len(w) - 34))
    for row in got:
        w = words(texts[row["doc_id"]])
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        assert row["kept"].encode().split() == [x for j, x in enumerate(w) if j not in gone] and row["n_removed"] == len(gone)


def test_intervals():
    assert repeats.merged([5, 1, 2, 11, 30], 4) == ([1, 11, 30], [9, 15, 34])
    assert repeats.merged([0, 4, 8], 4) == ([0], [12])


# -- 8 packing -----------------------------------------------------------------------------------------------
def test_packing(docs, empty):
    rows = packing.pack_documents(docs, PATH, 2, 64, with_ids=True).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 64 and r["ids_crc32"] == crc(r["ids"])
        bins[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for i, t, *_ in cases():
        full = [*ids(t), 2]
        if sum(j == i for j, *_ in cases()) == 1:
            p = sorted(pieces[i], key=lambda r: r["piece"])
            assert [r["piece"] for r in p] == list(range(-(-len(full) // 64))) and sum((r["ids"] for r in p), []) == full
            assert [r["start"] for r in p] == np.cumsum([0] + [r["length"] for r in p])[:-1].tolist()
    assert sum(r["length"] for r in rows) == sum(len(ids(t)) + 1 for _, t, *_ in cases())
    for b in bins.values():
        b.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in b] == np.cumsum([0] + [r["length"] for r in b])[:-1].tolist() and sum(r["length"] for r in b) <= 64
    assert packing.pack_documents(empty, PATH, 2).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_local_search_only_ever_helps(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 100) for _ in range(r.choice([1, 5, 60, 400]))]
    before = packing.best_fit(lengths, 100)
    after = packing.local_search([list(b) for b in before], lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 100 for b in after)
    assert -(-sum(lengths) // 100) <= len(after) <= len(before)


def test_local_search_empties_a_bin():
    lengths = [60, 60, 40, 30, 10, 20, 25, 35, 20]
    bins = [[0, 3], [1, 6], [2, 7, 4], [5, 8]]
    assert len(packing.local_search(bins, lengths, 100)) == 3


def fewest_bins(lengths, cap):
    """By trying every place for every item."""
    best = [len(lengths)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in sorted({r: i for i, r in enumerate(rooms)}.values()):
            if rooms[i] >= lengths[k]:
                put(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, cap - lengths[k]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_few_items_are_packed_as_well_as_can_be(seed):
    """Within one bin of the optimum, and at the optimum for most."""
    r = random.Random(100 + seed)
    cases_ = [sorted((r.randint(15, 70) for _ in range(9)), reverse=True) for _ in range(6)]
    made = [(len(set(packing.pack(x, 100)[0].tolist())), fewest_bins(x, 100)) for x in cases_]
    assert all(a <= b + 1 for a, b in made) and sum(a == b for a, b in made) >= 5


@pytest.mark.parametrize("low, high", [(600, 600), (520, 700), (300, 400), (1, 60), (1, 1024)])
def test_a_group_of_its_real_size_is_packed_in_seconds(low, high):
    r = random.Random(low)
    lengths = [r.randint(low, high) for _ in range(packing.GROUP_PIECES)]
    began = time.time()
    which, offset = packing.pack(lengths, 1024)
    assert time.time() - began < 20  # 2 seconds on an idle machine; the square of the items takes minutes
    fill, least = np.bincount(which, lengths), -(-sum(lengths) // 1024)
    assert fill.max() <= 1024 and fill.min() > 0 and len(fill) <= (packing.GROUP_PIECES if low > 512 else 1.11 * least)
    order = np.lexsort((offset, which))
    ends = (offset + np.array(lengths))[order]
    assert (np.where(np.diff(which[order], prepend=-1) > 0, 0, np.r_[0, ends[:-1]]) == offset[order]).all()


def test_a_document_of_very_many_pieces(spark, monkeypatch):
    """A million ids; full pieces are sequences of their own, and short ones are dealt to groups by their number."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    rows = [(0, "word " * 1_000_000)] + [(i, prose(i, 20 + i % 7)) for i in range(1, 400)] + [(400, "same text")] * 300
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 2).persist()
    long = out.where("doc_id = 0").orderBy("piece").collect()
    n = len(ids(rows[0][1])) + 1
    assert [r.length for r in long] == [n % 1024 or 1024] + [1024] * (-(-n // 1024) - 1) and [r.start for r in long] == np.cumsum([0] + [r.length for r in long])[:-1].tolist()
    bins = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces"), F.max("length").alias("most"))
    assert bins.where("n <> end or n > 1024 or places <> pieces or (most = 1024 and pieces > 1)").isEmpty()
    groups = out.where("length < 1024").groupBy(F.expr("shiftright(sequence_id, 32)").alias("g")).count().collect()
    assert len(groups) == 14 and max(r["count"] for r in groups) <= 50 + 3
    assert bins.count() <= -(-sum(len(ids(t)) + 1 for _, t in rows) // 1024) + len(groups)
    out.unpersist()


# -- 9 sharding ----------------------------------------------------------------------------------------------
def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, 4, bucket_bytes=5000).collect()
    assert bag(rows, "doc_id", "text", "size") == Counter((i, t, len((t or "").encode()) + 8) for i, t, *_ in cases())
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 4)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(4))
    where = {(r["doc_id"], r["shard"]) for r in rows}
    assert len({d for d, _ in where}) == len(where)
    again = sharding.shard_documents(docs.where("doc_id > 5"), 4).collect()
    assert {(r["doc_id"], r["shard"]) for r in again} <= where
    assert {(r["doc_id"], r["grown_shard"]) for r in rows} == {(r["doc_id"], r["shard"]) for r in sharding.shard_documents(docs, 5).collect()}
    assert sharding.shard_documents(empty, 4).count() == 0
    assert {r["shard"] for r in sharding.shard_documents(docs, 1).collect()} == {0}


def plain_shard(key, n, seed=17):
    """Rendezvous hashing in plain words: chained XXH64 of seed, shard and key; a null key leaves the hash as it is."""

    def weight(s):
        h = 42
        for data in (struct.pack("<i", seed), struct.pack("<i", s), None if key is None else struct.pack("<q", key)):
            h = h if data is None else xxhash.xxh64_intdigest(data, h)
        return h - (1 << 64) if h >> 63 else h, s

    return max(map(weight, range(n)))[1]


def test_shards_are_those_of_the_plain_law(spark, docs):
    for n in (1, 7, 24):
        rows = sharding.shard_documents(docs, n).collect()
        assert all((r["shard"], r["grown_shard"]) == (plain_shard(r["doc_id"], n), plain_shard(r["doc_id"], n + 1)) for r in rows)
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).repartition(5)
    one, two = ({(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(many.coalesce(k), 3, bucket_bytes=4000).collect()} for k in (5, 5))
    assert one == two


def test_a_shard_is_shuffled(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sorted(sharding.shard_documents(df, 2).where("shard = 0").collect(), key=lambda r: r["slot"])
    x = np.array([r["doc_id"] for r in rows])
    assert abs(np.corrcoef(x, np.arange(len(x)))[0, 1]) < 0.1


# -- 10 language model ---------------------------------------------------------------------------------------
def stream(t):
    return b"\n" * language_model.ORDER + b" ".join(low_words(t)) + b"\n"


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_language_model(docs, empty, monkeypatch, most):
    monkeypatch.setattr(language_model, "COMMON", most)  # how many worths are sent to all changes no result
    monkeypatch.setattr(language_model, "HELD", 20 * most)
    monkeypatch.setattr(language_model, "TASK_STRINGS", 10 * most)
    learn = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    rows = language_model.score_texts(docs, learn).collect()
    train = [t for i, t, *_ in cases() if i is not None and i % 2 == 0]
    count = Counter(w for t in train for w in low_words(t))
    count[None] = len(train)
    total, distinct, n = sum(count.values()), len(count), language_model.ORDER
    seen = [defaultdict(Counter) for _ in range(n + 1)]
    for t in train:
        s = stream(t)
        for p in range(n, len(s)):
            for k in range(n + 1):
                seen[k][s[p - k : p]][s[p]] += 1

    def score(t):
        s, out = stream(t), 0.0
        for p in range(n, len(s)):
            gone: set[int] = set()
            for k in range(n, -1, -1):
                left = {b: c for b, c in seen[k].get(s[p - k : p], {}).items() if b not in gone}
                if not left:
                    continue
                t_, d_ = sum(left.values()), len(left)
                if s[p] in left:
                    out += math.log10(left[s[p]] / (t_ + d_))
                    break
                out += math.log10(d_ / (t_ + d_))
                gone |= set(left)
            else:
                out += math.log10(1 / (256 - len(gone)))
        return out

    want = defaultdict(list)
    for i, t, *_ in cases():
        w = [*low_words(t), None]
        want[i, len(w), sum(x in count for x in w), total].append((sum(math.log10((count.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), score(t)))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]].append((r["base_score"], r["score"]))
    assert got.keys() == want.keys()
    for k in got:
        assert np.array(sorted(got[k])) == pytest.approx(np.array(sorted(want[k])), rel=1e-6)
    if most == 300:
        assert language_model.score_texts(empty, learn).count() == 0
        none = language_model.score_texts(docs, F.lit(False)).where("doc_id = 3").first()
        assert none["score"] == pytest.approx(-4 * math.log10(256)) and none["base_score"] == 0


def test_worths_are_found():
    r = np.random.default_rng(6)
    items = np.unique(np.r_[r.integers(-(1 << 63), 1 << 48, 3000), 0, 1, 2])
    values = r.random(len(items))
    worths = common.Worths(items, values)
    got, known = worths(np.r_[items, items + 1])
    also = np.isin(items + 1, items)
    assert known.tolist() == [True] * len(items) + also.tolist() and got[: len(items)].tolist() == values.tolist()
    assert not common.Worths(items[:0], values[:0])(items)[1].any()


def test_all_contexts_are_kept(spark):
    """More contexts than any fixed number of them: the rare ones count as the common ones do."""
    r = random.Random(4)
    train = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(900)) for _ in range(12)]
    texts = [*train[:2], train[3][:200] + "zq~" + train[4][:200]]
    n = language_model.ORDER
    seen = [defaultdict(Counter) for _ in range(n + 1)]
    for s in map(stream, train):
        for p in range(n, len(s)):
            for k in range(n + 1):
                seen[k][s[p - k : p]][s[p]] += 1
    assert sum(map(len, seen)) > 120_000
    want = []
    for s in map(stream, texts):
        out = 0.0
        for p in range(n, len(s)):
            gone: set[int] = set()
            for k in range(n, -1, -1):
                left = {b: c for b, c in seen[k].get(s[p - k : p], {}).items() if b not in gone}
                if s[p] in left:
                    out += math.log10(left[s[p]] / (sum(left.values()) + len(left)))
                    break
                if left:
                    out += math.log10(len(left) / (sum(left.values()) + len(left)))
                gone |= set(left)
            else:
                out += math.log10(1 / (256 - len(gone)))
        want.append(out)
    rows = [(i, t) for i, t in enumerate(train)] + [(100 + i, t) for i, t in enumerate(texts)]
    got = language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).where("doc_id >= 100").orderBy("doc_id").collect()
    assert [r["score"] for r in got] == pytest.approx(want, rel=1e-6)


# -- very long texts -----------------------------------------------------------------------------------------
def test_a_text_longer_than_a_slice(spark):
    """It is a slice of its own, and counted whole."""
    long = (prose(41, 20_000) + "\n") * 45
    assert len(long) > 1.2 * common.SLICE_BYTES
    rows = [(0, prose(42, 60), "en"), (1, long, "en"), (2, None, None), (3, prose(43, 400), "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    n = len(words(long))
    one = lambda df: df.where("doc_id = 1").first()
    assert one(language.identify_language(d, d))["lang_pred"] == "en"
    r = one(quality.quality_report(d))
    assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (n, n, 44)
    assert one(token_counts.count_tokens(d, PATH))["n_tokens"] == len(ids(long))
    assert one(near_duplicates.near_duplicate_groups(d))["n_shingles"] == len({tuple(w) for w in zip(*(words(long)[k:] for k in range(5)))})
    bench = spark.createDataFrame([(9, " ".join(long.split()[500:530]))], "item_id long, text string")
    r = one(decontamination.find_benchmark(d, bench))
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (n, 45 * 30, False)
    r = one(repeats.remove_repeats(d))
    assert (r["n_words"], r["n_removed"], r["kept"]) == (n, n, "")
    assert packing.pack_documents(d, PATH, 2).where("doc_id = 1").agg(F.sum("length")).first()[0] == len(ids(long)) + 1
    assert one(sharding.shard_documents(d, 3))["size"] == len(long.encode()) + 8
    assert one(token_files.read_token_files(spark, token_files.write_token_files(d, PATH, 2)))["n_tokens"] == len(ids(long)) + 1
    r = one(resampling.resample(d, bench))
    assert (r["n_words"], r["n_features"]) == (n, 2 * n - 1)
    assert one(secrets.scan_secrets(d))["base"] == []
    assert one(language_model.score_texts(d, F.lit(True)))["n_tokens"] == n + 1


# -- pipeline ------------------------------------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(300 + i, 90), "en", "s", 0) for i in range(30)]
    rows[1] = (1, rows[0][1] + " more", "en", "s", 0)
    passage, shared = prose(999, 40), prose(998, 60)
    rows[2] = (2, rows[2][1] + " " + passage, "en", "s", 0)
    rows[3], rows[4] = ((i, prose(400 + i, 400) + " " + shared, "en", "s", 0) for i in (3, 4))
    rows[5] = (5, "JUNK!! " * 50, "en", "s", 0)
    rows += [(None, None, None, None, None), (40, "", "en", "s", 0)]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d/documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "d/benchmark.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "d/documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, str(tmp_path / "d")))
        after.append(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    have = [{r["doc_id"] for r in d.select("doc_id").distinct().collect()} for d in after]
    assert have[0] == set(range(30)) - {5}
    assert have[1] == have[0] - {1} and have[2] == have[1] and have[3] == have[2] - {2} and have[4] == have[3]
    texts = {r["doc_id"]: r["text"] for r in after[2].collect()}
    assert texts[3] == " ".join(prose(403, 400).split()) and texts[6] == rows[6][1]
    assert corpus_pipeline.run(spark, str(tmp_path / "d")).count() == after[-1].count()


def test_pipeline_keeps_one_of_rows_that_share_an_id_or_have_none(spark):
    import corpus_pipeline

    a, b, c, d, e = (prose(600 + k, 80) for k in range(5))
    rows = [(None, a, "en", "s", 1)] * 3 + [(None, a + " more", "en", "s", 2)]
    rows += [(5, b, "en", "t", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (None, b, "en", "a", 1), (9, b, "en", "a", 1)]
    rows += [(1, c, "en", "s", 1), (2, c, "en", "s", 1), (2, d, "en", "s", 1), (None, e, None, None, None)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter(tuple(r) for r in out.collect())
    first = [r for r in got if r[1] and r[1].startswith(a)]
    assert len(first) == 1 and first[0] in rows and got.pop(first[0]) == 1
    assert got == Counter(rows[5:6] + rows[9:10] + rows[11:])
    kept = corpus_pipeline.repeats(spark, spark.createDataFrame(out.collect(), docs.schema), "").collect()
    assert {r["text"] for r in kept} >= {first[0][1], b, c, d, e}


def plain_quality(t):
    n, chars, symbols, dup, hit = plain_features(t)
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    shouted = sum(sum(65 <= c <= 90 for c in x) > 1 and not any(97 <= c <= 122 for c in x) for x in w)
    marks = sum(not any(c >= 128 or chr(c).isalnum() for c in x) for x in w)
    echoes = sum(a == b for a, b in zip(w, w[1:]))
    out = [n < 20, 100 * hit > 30 * n, 10 * symbols > n, 2 * dup > len(lines), not 2 * n <= chars <= 15 * n, 100 * shouted > 30 * n, 100 * echoes > 30 * n, 100 * marks > 20 * n]
    return not any(out)


def test_pipeline_stages_are_the_plain_ones(spark, tmp_path):
    """Each stage of the pipeline against a plain version of it, on what the plain stages before have kept."""
    import corpus_pipeline

    r = random.Random(77)
    rows = [(i, prose(2000 + i, r.randint(10, 160)), "en", "s") for i in range(60)]
    for i in range(0, 12, 2):  # near copies, copies, shared passages, passages of the benchmark, junk
        rows[i + 1] = (i + 1, rows[i][1] + " more" if i % 4 else rows[i][1], "en", "s")
    shared, bench = prose(2900, 70), prose(2901, 40)
    for i in range(20, 26):
        rows[i] = (i, prose(2100 + i, 30 + i) + " " + " ".join(shared.split()[i - 20 : 60]) + " " + prose(2200 + i, 150), "en", "s")
    for i in range(30, 34):
        rows[i] = (i, rows[i][1] + " " + " ".join(bench.split()[: 16 + i - 30]), "en", "s")
    rows += [(70, "HEY YOU " * 30, "en", "s"), (71, prose(5, 30) + " | ! ? " * 20, "en", "s"), (72, "a " * 60, "en", "s"), (73, "", "en", "s"), (None, None, None, None)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    place = tmp_path / "d"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    docs, after = spark.read.parquet(f"{place}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, str(place)))
        after.append(docs.collect())
    as_rows = lambda k: Counter(map(tuple, after[k]))
    plain = [x for x in rows if plain_quality(x[1])]
    assert as_rows(0) == Counter(plain) and 0 < len(plain) < len(rows)
    component = {d: c for d, _, c in plain_groups([x[:2] for x in plain])}
    plain = [x for x in plain if component[x[0]] == x[0]]
    assert as_rows(1) == Counter(plain)
    seen = Counter(tuple(w[k : k + 35]) for x in plain for w in [words(x[1])] for k in range(len(w) - 34))
    cut = []
    for d, text, *rest, n_chars in plain:
        w = words(text)
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        cut.append((d, kept, *rest, len(kept)) if gone else (d, text, *rest, n_chars))
    assert as_rows(2) == Counter(cut) and cut != plain
    windows = {tuple(w[k : k + 13]) for w in [plain_words(bench)] for k in range(len(w) - 12)}
    clean = []
    for x in cut:
        w = plain_words(x[1])
        hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(k, k + 13)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(x)
    assert as_rows(3) == Counter(clean) and len(clean) < len(cut)
    pieces = Counter()
    for x in clean:
        full, at = [*ids(x[1]), 2], 0
        steps = [len(full) % 1024 or 1024] + [1024] * (-(-len(full) // 1024) - 1)
        for k, step in enumerate(steps):
            pieces[x[0], k, at, step, crc(full[at : at + step])] += 1
            at += step
    assert bag(after[4], "doc_id", "piece", "start", "length", "ids_crc32") == pieces
    bins = defaultdict(list)
    for p in after[4]:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0] + [n for _, n in b])[:-1].tolist() and sum(n for _, n in b) <= 1024
    assert len(bins) == fewest_bins(sorted((n for *_, n, _ in pieces), reverse=True), 1024) if len(pieces) < 12 else len(bins) <= -(-sum(n for *_, n, _ in pieces) // 1024) + 1


def test_pipeline_of_empty_tables(spark, tmp_path):
    """No rows, and columns of clashing names."""
    import corpus_pipeline

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, key string, digest long, root int, kept string, n_words string, d1 int, whole string")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(i, prose(i, 60) if i else None, "en", "s", 1, "k", i, i, "x", "y", i, "w") for i in range(6)], empty.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        some = common.staged(stage(spark, some, str(tmp_path)))
        assert some.columns == empty.columns
    assert {r["doc_id"] for r in some.collect()} == {1, 2, 3, 4, 5}
