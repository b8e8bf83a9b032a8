r"""Exact n-gram Jaccard self-join in metric space, and its connected groups.

Jaccard distance is a metric. Texts are points: their sets of `n`-word shingles. Nearly all pairs of texts are at
distance 1, from each other and from any pivot, where neither Voronoi regions nor triangle windows tell points apart:
all would be on every boundary. So the space first falls into the neighbourhoods of rare shingles, which is exact:
points near enough to be linked share a shingle of their prefixes (their rarest shingles, in an order all points
share). Each shingle of a prefix names a point that has it there, and the points that name the same one are a region.

Regions join recursively. In one that is too large for a task, pivots are drawn and all points' distances to them
measured, without the region ever meeting in one place. Points within the radius of a pivot are linked to it; those
that these links connect are the region's core, within which no pair needs to meet. Where few points are left outside
the core, parts of the core meet those. Otherwise each point goes to the Voronoi region of its nearest pivot, and by the
triangle inequality also to every region q on whose boundary it is: only where its distance to q is at most that to its
own pivot and twice the radius, and at most the radius more than that of q's farthest point, can it be linked to a
point of q. Points that are far from all pivots, further than 1 - radius, are a region of their own. Regions that this
does not divide try other pivots as long as the core grows by that; then parts of what is outside the core meet all
other parts: slower, and as exact. In a task, a region's points are joined by pivots, distances to them and triangle
windows in the same way.

Which shingles are rare is told by a sketch of counts over all texts. It is of a bounded size, and only the
amount of work depends on it: any order that all points share gives the same links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, doc_windows, drop_staged, filled, hash_words, mix, rolling, split_words, staged, text_slices, word_ids
from .components import connected_components

#: Bounds, in powers of two, of the cells of the sketch of counts; a cell is a byte in every worker.
SKETCH_BITS = (16, 25)
#: Cells in a row of the sketch.
SKETCH_ROW = 1 << 16
#: Partial sums of the sketch that meet in the second of two steps, at most.
SKETCH_TURNS = 256
#: Points and shingles of a region that a task joins; larger ones are divided.
TASK_POINTS, TASK_SHINGLES = 128, 2_000_000
#: Pivots that are drawn in a region, and how often that is tried. Linked pivots are told by bits.
PIVOTS, ROUNDS = 8, 6
#: The place, beside the pivots', of points that are far from all.
FAR = -1
#: Distinct texts whose names, and bytes of pivots' sets that, are broadcast at most; more are joined by a shuffle.
BROADCAST_TEXTS, BROADCAST_BYTES = 500_000, 32 << 20


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, joined; and their numbers. A text of fewer than n words,
    but not none, has all of them as its one shingle."""
    words, counts = split_words(pc.ascii_lower(filled(texts)))
    ids, vocabulary = word_ids(words)
    h = hash_words(vocabulary)[ids]
    at, doc = doc_windows(counts, n)
    value = mix(rolling(h, n)[at]) if len(at) else np.empty(0, np.uint64)
    cuts = np.searchsorted(doc, np.arange(len(counts) + 1))
    first = np.cumsum(counts) - counts
    sets = []
    for k, c in enumerate(counts.tolist()):
        if c >= n:
            sets.append(np.unique(value[cuts[k] : cuts[k + 1]]))
        elif c:
            sets.append(mix(rolling(h[first[k] : first[k] + c], c) + np.uint64(c)))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate([*sets, np.empty(0, np.uint64)]), np.array(list(map(len, sets)), np.int64)


def count_sketch(texts: DataFrame, n: int) -> np.ndarray:
    """By cell of shingle hashes, the logarithm of how many (text, shingle) pairs fall there."""
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(n_bytes // 48).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    cells = 1 << bits

    def count(batches):
        seen = np.zeros(cells, np.uint8)
        for b in text_slices(batches, "text"):
            values, _ = shingle_sets(b.column("text"), n)
            cell, times = np.unique(values >> np.uint64(64 - bits), return_counts=True)
            cell = cell.astype(np.int64)
            seen[cell] = np.minimum(seen[cell] + times, 255)
        press = zstandard.ZstdCompressor(1)
        for k in range(0, cells, SKETCH_ROW):
            part = seen[k : k + SKETCH_ROW]
            if part.any():
                yield pa.RecordBatch.from_pydict({"row": pa.array([k // SKETCH_ROW], pa.int32()), "counts": [press.compress(part.tobytes())]})

    def total(table: pa.Table, kind: str) -> np.ndarray:
        out = np.zeros(SKETCH_ROW, np.int64)
        for c in table["counts"].to_pylist():
            out += np.frombuffer(zstandard.decompress(c), kind)
        return out

    def row(table: pa.Table, counts: np.ndarray) -> pa.Table:
        return pa.table({"row": table["row"].slice(0, 1), "counts": pa.array([zstandard.ZstdCompressor(1).compress(counts.tobytes())], pa.binary())})

    def part(table: pa.Table) -> pa.Table:
        return row(table, np.minimum(total(table, "u1"), (1 << 32) - 1).astype("<u4"))

    def add(table: pa.Table) -> pa.Table:
        return row(table, np.ceil(np.log2(total(table, "<u4") + 1)).astype(np.uint8))

    # In two steps, so that no task gets a row from every partition of the texts.
    schema = "row int, counts binary"
    out = np.zeros(cells, np.uint8)
    turns = by_bytes(texts).mapInArrow(count, schema).withColumn("turn", F.pmod(F.spark_partition_id(), F.lit(SKETCH_TURNS)))
    for r in turns.groupBy("row", "turn").applyInArrow(part, schema).groupBy("row").applyInArrow(add, schema).collect():
        out[r["row"] * SKETCH_ROW : (r["row"] + 1) * SKETCH_ROW] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.uint8)
    return out


def prefixes(texts: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(digest, n_shingles, prefix) for each row of texts (digest, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        order = shared.value
        shift = np.uint64(64 - (len(order).bit_length() - 1))
        for b in text_slices(batches, "text"):
            values, sizes = shingle_sets(b.column("text"), n)
            rank = (order[(values >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (values >> np.uint64(7))
            out, lens, at = [], [], 0
            for size in sizes.tolist():
                take = size - -(-percent * size // 100) + 1 if size else 0
                out.append(values[at : at + size][np.argsort(rank[at : at + size], kind="stable")[:take]])
                lens.append(take)
                at += size
            flat = np.concatenate([*out, np.empty(0, np.uint64)]).view(np.int64)
            offsets = np.r_[0, np.cumsum(lens)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["digest", "n_shingles", "prefix"])

    return by_bytes(texts.select("digest", "text")).mapInArrow(run, "digest binary, n_shingles long, prefix array<long>")


class Region:
    """Points of one region: their sets over a common numbering of shingles."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, percent: int):
        self.token = np.unique(flat, return_inverse=True)[1] if len(flat) else np.empty(0, np.int64)
        self.n_tokens = int(self.token.max()) + 1 if len(flat) else 0
        self.sizes, self.first, self.percent = sizes, np.cumsum(sizes) - sizes, percent
        self.parent = np.arange(len(sizes))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def measure(self, pivot: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of points to a point, and which of them are linked to it."""
        mark = np.zeros(self.n_tokens, bool)
        mark[self.token[self.first[pivot] : self.first[pivot] + self.sizes[pivot]]] = True
        if len(points) == len(self.sizes):
            both = np.add.reduceat(mark[self.token], self.first, dtype=np.int64)
        else:
            each = self.sizes[points]
            start = np.cumsum(each) - each
            at = np.repeat(self.first[points] - start, each) + np.arange(int(each.sum()))
            both = np.add.reduceat(mark[self.token[at]], start, dtype=np.int64)
        union = self.sizes[points] + self.sizes[pivot] - both
        return 1 - both / union, 100 * both >= self.percent * union

    def join(self, pivot: int) -> None:
        """Links all points that are near enough."""
        everyone = np.arange(len(self.sizes))
        far, near = self.measure(pivot, everyone)
        radius = 1 - self.percent / 100 + 1e-9
        self.parent[near] = pivot
        self.parent[pivot] = pivot
        left = np.flatnonzero(~near)
        # Each further pivot meets the window of points around its distance; it is done with afterwards.
        order = left[np.argsort(-far[left], kind="stable")]
        done = np.zeros(len(self.sizes), bool)
        for p in order.tolist():
            low, high = self.percent * self.sizes[p], 100 * self.sizes[p]
            fits = (np.abs(far - far[p]) <= radius) & ~done & (100 * self.sizes >= low) & (self.percent * self.sizes <= high)
            fits[p] = False
            done[p] = True
            window = np.flatnonzero(fits)
            if not len(window):
                continue
            mine = self.root(p)
            roots = np.array([self.root(i) for i in window.tolist()])
            window = window[roots != mine]
            if len(window):
                for i in window[self.measure(p, window)[1]].tolist():
                    a, b = self.root(p), self.root(i)
                    self.parent[max(a, b)] = min(a, b)


def region_members(points: DataFrame, percent: int) -> DataFrame:
    """A staged table (cell, key, n_shingles) of the regions' points, each region named by one of its own. A shingle's
    points are told apart by size: linked points are in the same class of sizes or in neighbouring ones, so each
    class and the next together name a point of their own."""
    entries = points.where("n_shingles > 0").select("key", "n_shingles", F.explode("prefix").alias("shingle"))
    every = entries.groupBy("shingle").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.count("*").alias("c"))
    unlike = (F.col("c") == 2) & (100 * F.col("low") < percent * F.col("high"))
    # What is joined is staged first: Spark can then split the rows of a shingle that very many points have.
    shared = staged(every.where((F.col("a") != F.col("b")) & ~unlike).select("shingle"))
    met = staged(entries.join(shared, "shingle"))
    size_class = F.floor(F.log("n_shingles") / float(np.log(101 / percent)))
    classed = met.select("shingle", "key", "n_shingles", F.explode(F.array(size_class, size_class + 1)).alias("sizes"))
    named = classed.groupBy("shingle", "sizes").agg(F.min("key").alias("cell"), F.max("key").alias("other")).where("cell <> other")
    named = staged(named.drop("other"))
    out = staged(classed.join(named, ["shingle", "sizes"]).select("cell", "key", "n_shingles").distinct())
    for t in (shared, met, named):
        drop_staged(t)
    return out


def shingle_table(texts: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """A staged table (key, shingles) of the texts (digest, text) that names (digest, key) names, each once."""
    n_names = names.count()
    named = texts.join(F.broadcast(names) if n_names <= BROADCAST_TEXTS else names, "digest")
    # Copies of a text are made one before its shingles are taken.
    one = named.groupBy("key").agg(F.first("text").alias("text"))

    def run(batches):
        for b in text_slices(batches, "text"):
            values, sizes = shingle_sets(b.column("text"), n)
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], ["key", "shingles"])

    return staged(by_bytes(one).mapInArrow(run, "key long, shingles array<long>"))


def measured(rows: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """A staged table: rows (cell, key, n_shingles, core) with `to`, what they are to each pivot of their cell: its key,
    their distance, and whether they are linked. Pivots are drawn from points outside the core first."""
    place = F.row_number().over(Window.partitionBy("cell").orderBy("core", F.xxhash64(F.lit(turn), "key"), "key"))
    drawn = rows.withColumn("place", place).where(F.col("place") <= PIVOTS).join(sets, "key")
    pivots = drawn.groupBy("cell").agg(F.collect_list(F.struct("key", "n_shingles", "shingles")).alias("pivots"))
    pivots = staged(pivots)
    n_bytes = pivots.agg(F.sum(F.aggregate("pivots", F.lit(0), lambda a, p: a + F.size(p["shingles"]) * 8 + 64))).first()[0] or 0
    both = F.transform("pivots", lambda p: F.struct(p["key"].alias("key"), p["n_shingles"].alias("size"), F.size(F.array_intersect("shingles", p["shingles"])).alias("both")))
    to = F.transform(
        both,
        lambda p: F.struct(
            p["key"].alias("key"),
            (1 - p["both"] / (F.col("n_shingles") + p["size"] - p["both"])).alias("d"),
            (100 * p["both"] >= percent * (F.col("n_shingles") + p["size"] - p["both"])).alias("linked"),
        ),
    )
    met = rows.join(sets, "key").join(F.broadcast(pivots) if n_bytes <= BROADCAST_BYTES else pivots, "cell")
    out = staged(met.select("cell", "key", "n_shingles", "core", to.alias("to")))
    drop_staged(pivots)
    return out


def grown_cores(rows: DataFrame) -> DataFrame:
    """(cell, pivots): the bits of the pivots in each cell's core, from measured rows with `bits` of linked pivots. Points
    with the same bits are one row, at most 2 * 2**PIVOTS in a cell."""
    alike = rows.where("core or bits > 0").groupBy("cell", "core", "bits").agg(F.count("*").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        core, bits, n = (table[c].to_pylist() for c in ("core", "bits", "n"))

        def closed(mask: int) -> int:
            while (grown := mask | sum({1 << i for b in bits if b & mask for i in range(PIVOTS) if b >> i & 1})) != mask:
                mask = grown
            return mask

        seed = 0
        for c, b in zip(core, bits):
            seed |= b if c else 0
        # Without a core yet, the largest connected set of points is it.
        best = closed(seed) if any(core) else max({closed(b) for b in bits}, key=lambda m: (sum(k for b, k in zip(bits, n) if b & m), m))
        return pa.table({"cell": table["cell"].slice(0, 1), "pivots": pa.array([best], pa.int32())})

    return alike.groupBy("cell").applyInArrow(run, "cell long, pivots int")


def divided(rows: DataFrame, percent: int) -> DataFrame:
    """A staged table (cell, key, n_shingles, core, stuck) of the Voronoi regions of measured rows (with was_core),
    boundary points in several. Regions that this does not divide stay as they are; they are stuck if their core has
    not taken up a quarter of the points outside of it either."""
    radius = 1 - percent / 100 + 1e-9
    nearest = F.array_min(F.transform("to", lambda p, i: F.struct(p["d"].alias("d"), i.alias("slot"))))
    near = rows.withColumn("nearest", nearest).withColumn("far", F.col("nearest.d") >= 1 - radius)
    slots = F.filter(F.transform("to", lambda p, i: F.struct(i.alias("slot"), p["d"].alias("d"))), lambda p: p["d"] <= F.col("nearest.d") + 2 * radius)
    with_far = F.concat(slots, F.array(F.struct(F.lit(FAR).alias("slot"), F.lit(0.0).alias("d"))))
    at = F.explode(F.when(F.col("far"), with_far).otherwise(slots)).alias("at")
    everywhere = near.select("cell", "key", "n_shingles", "core", at).withColumn("slot", F.col("at.slot"))
    home = near.where("not far").groupBy("cell", F.col("nearest.slot").alias("slot")).agg(F.max("nearest.d").alias("reach"))
    placed = everywhere.join(home, ["cell", "slot"], "left").where((F.col("slot") == FAR) | (F.col("at.d") <= F.col("reach") + radius))
    placed = staged(placed.select("cell", "key", "n_shingles", "core", F.xxhash64("cell", "slot").alias("child")))
    sizes = placed.groupBy("cell", "child").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    whole = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(~F.col("core")).alias("open"), F.count_if(~F.col("was_core")).alias("was_open"))
    is_split = (4 * F.col("most") <= 3 * F.col("n")) & (F.col("all") <= 2 * F.col("n"))
    kinds = staged(whole.join(sizes, "cell").select("cell", is_split.alias("split"), (4 * F.col("open") > 3 * F.col("was_open")).alias("stuck")))
    split = placed.join(kinds.where("split"), "cell").select(F.col("child").alias("cell"), "key", "n_shingles", "core", F.lit(False).alias("stuck"))
    kept = rows.join(kinds.where("not split"), "cell").select("cell", "key", "n_shingles", "core", "stuck")
    out = staged(split.unionByName(kept))
    drop_staged(placed)
    drop_staged(kinds)
    return out


def dealt(sized: DataFrame) -> DataFrame:
    """(cell, i, j, key) for tasks that join all that is in cells (cell, key, core, points, shingles, open), save pairs
    within a core: points outside the core are in parts 0 and up, the core in parts after those, and each part of the
    first meets all others. A cell that fits a task is one part."""
    # How many times as long as a task's points may be those of the cell are, if they are too long.
    long = F.greatest(F.lit(1.0), F.col("shingles") / F.col("points") * TASK_POINTS / TASK_SHINGLES)
    parts = lambda n: F.ceil(2 * long * n / TASK_POINTS).cast("int")
    n_open = F.when(fits_a_task(), 1).otherwise(parts(F.col("open")))
    n_all = F.when(fits_a_task(), 1).otherwise(parts(F.col("open")) + parts(F.col("points") - F.col("open")))
    turn = F.xxhash64("key")
    part = F.when(fits_a_task(), 0).when(F.col("core"), F.col("n_open") + F.pmod(turn, F.greatest(F.col("n_all") - F.col("n_open"), F.lit(1)))).otherwise(F.pmod(turn, F.col("n_open"))).cast("int")
    placed = sized.withColumns({"n_open": n_open, "n_all": n_all}).withColumn("part", part)
    others = F.sequence(F.lit(0), F.when(F.col("part") < F.col("n_open"), F.col("n_all")).otherwise(F.col("n_open")) - 1)
    # A part meets itself where it meets any other.
    others = F.when(F.col("n_all") > 1, F.filter(others, lambda o: o != F.col("part"))).otherwise(others)
    met = placed.select("cell", "part", F.explode(others).alias("other"), "key")
    return met.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "key")


def fits_a_task() -> Column:
    return (F.col("points") <= TASK_POINTS) & (F.col("shingles") <= TASK_SHINGLES)


def region_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A staged table of links (a, b) within the regions (cell, key, n_shingles): they connect all points that are
    near enough."""
    cells = members.withColumns({"core": F.lit(False), "stuck": F.lit(False)})
    tasks, links, tables = [], [], []
    for turn in range(ROUNDS + 1):
        sizes = cells.groupBy("cell").agg(F.count("*").alias("points"), F.sum("n_shingles").alias("shingles"), F.count_if(~F.col("core")).alias("open"))
        # A region that is all core has no pair left to be joined.
        sizes = staged(sizes.where("open > 0"))
        sized = cells.join(sizes, "cell")
        ready = fits_a_task() | F.col("stuck") | (2 * F.col("open") <= TASK_POINTS) | F.lit(turn == ROUNDS)
        tasks.append(dealt(sized.where(ready)))
        large = staged(sized.where(~ready).select("cell", "key", "n_shingles", "core"))
        tables += [sizes, large]
        if large.isEmpty():
            break
        now = measured(large, sets, percent, turn)
        links.append(now.select(F.col("key").alias("a"), F.explode(F.filter("to", lambda p: p["linked"])).alias("p")).select("a", F.col("p.key").alias("b")).where("a <> b"))
        bits = F.aggregate(F.transform("to", lambda p, i: F.when(p["linked"], F.pow(F.lit(2), i).cast("int")).otherwise(0)), F.lit(0), lambda a, b: a + b)
        marked = now.withColumn("bits", bits)
        core = F.col("core") | (F.col("bits").bitwiseAND(F.coalesce("pivots", F.lit(0))) != 0)
        marked = staged(marked.join(staged_in(tables, grown_cores(marked)), "cell", "left").select("cell", "key", "n_shingles", F.col("core").alias("was_core"), core.alias("core"), "to"))
        cells = divided(marked, percent)
        tables += [now, marked, cells]

    def join(table: pa.Table) -> pa.Table:
        keys, shingles = table["key"].to_numpy(), table["shingles"].combine_chunks()
        region = Region(shingles.flatten().to_numpy(), pc.list_value_length(shingles).to_numpy(zero_copy_only=False).astype(np.int64), percent)
        region.join(0)
        roots = np.array([region.root(i) for i in range(len(keys))])
        linked = np.flatnonzero(roots != np.arange(len(keys)))
        return pa.table({"a": pa.array(keys[linked]), "b": pa.array(keys[roots[linked]])})

    rows = tasks[0]
    for more in tasks[1:]:
        rows = rows.unionByName(more)
    found = rows.join(sets, "key").groupBy("cell", "i", "j").applyInArrow(join, "a long, b long")
    for more in links:
        found = found.unionByName(more)
    out = staged(found)
    for t in tables:
        drop_staged(t)
    return out


def staged_in(tables: list[DataFrame], df: DataFrame) -> DataFrame:
    """A staged table, noted among those to be dropped."""
    tables.append(staged(df))
    return tables[-1]


def text_groups(src: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """A staged table (digest, root, component_id, n_shingles) of the distinct texts of src (id, text, digest), where
    digest is the text's: linked texts have one root, and component_id is the least id of all rows with them."""
    texts = src.where("text is not null").select("digest", "text")
    points = prefixes(texts, n, percent, count_sketch(texts, n)).dropDuplicates(["digest"])
    points = staged(points.withColumn("key", F.monotonically_increasing_id()))
    members = region_members(points, percent)
    sets = shingle_table(texts, points.select("digest", "key").join(members.select("key").distinct(), "key"), n)
    links = region_links(members, sets, percent)
    roots = connected_components(links)
    ids = src.groupBy("digest").agg(F.min("id").alias("least"))
    named = points.select("digest", "key", "n_shingles").join(ids, "digest")
    rooted = named.join(roots, F.col("key") == F.col("node"), "left").select("digest", "n_shingles", "least", F.coalesce("root", "key").alias("root"))
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    groups = staged(rooted.join(least, "root").select("digest", "root", "component_id", "n_shingles"))
    for t in (points, members, sets, links, roots, least):
        drop_staged(t)
    return groups


def digest(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def near_duplicate_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""id_col, n_shingles and component_id: the least id of the texts reachable by links, its own included.

    Words are `[^\x20\x09-\x0D]+` of the text with A-Z lower-cased. Two texts are linked when
    100 * intersection >= percent * union of their sets of n-word shingles; with fewer words, all of them are
    one shingle. Texts without words, null texts among them, have no shingles and are linked with nothing.
    Equal texts are one point, so a group of copies costs one point however large; repeated rows and null ids
    give rows of their own, and a group in which all ids are null has a null component_id. Other columns are
    not read. Texts are told apart by their MD5, a text's shingles by 64-bit hashes.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), digest(docs[text_col]).alias("digest"))
    groups = text_groups(src, n, percent).drop("root")
    out = src.select("id", "digest", F.col("text").isNull().alias("empty")).join(groups, "digest", "left")
    none = F.col("empty") | F.coalesce(F.col("n_shingles") == 0, F.lit(True))
    return out.select(
        F.col("id").alias(id_col),
        F.when(none, 0).otherwise(F.col("n_shingles")).cast("long").alias("n_shingles"),
        F.when(none, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
