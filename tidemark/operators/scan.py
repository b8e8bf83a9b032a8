"""Scans along time that no task sees whole: places in a group, values carried on, running sums and recursions.

A group of any size is cut into blocks of neighbouring rows. Each block is scanned on its own, then the blocks' ends
are scanned, which are few, and what came before a block is added to its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import stored

#: Rows in a block.
BLOCK_ROWS = 1 << 17


def beside(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """df with other's columns where the keys are equal; null equals null. other has each key once."""
    other = other.withColumnsRenamed({c: f"__on_{c}" for c in on})
    equal = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on])
    return df.join(other, equal, "left").drop(*[f"__on_{c}" for c in on])


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with `__part`, as a table in the shared folder: neighbours by (by, order) share a part, and a hot group has many."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BLOCK_ROWS))
    return stored(df.repartitionByRange(n, *map(F.col, by), *order).withColumn("__part", F.spark_partition_id()))


def from_before(ranged: DataFrame, by: Sequence[str], summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """(by, __part, carry): for each part but a group's first, the carry columns, which read the summaries of the group's
    earlier parts by a window over them. Of each part only the first group can have begun before it, so there are
    never more rows than parts, and they may be broadcast."""
    parts = ranged.groupBy(*by, "__part").agg(*[c.alias(k) for k, c in summary.items()])
    w = Window.partitionBy(*by).orderBy("__part")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({k: c.over(earlier) for k, c in carry.items()} | {"__k": F.row_number().over(w)})
    return F.broadcast(out.where("__k > 1").select(*by, "__part", *carry))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "nth") -> DataFrame:
    """df with each row's place in its group, from 0. df should be a table or cheap to read: ranges are sampled from it."""
    ranged = in_ranges(df, by, order)
    before = from_before(ranged, by, {"__n": F.count("*")}, {"__base": F.sum("__n")})
    place = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)) - 1
    return beside(ranged.withColumn("__place", place), before, [*by, "__part"]).select(*df.columns, (F.col("__place") + F.coalesce("__base", F.lit(0))).alias(name))


def running_total(df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with value summed up from the group's first row to each row; null values add nothing."""
    ranged = in_ranges(df, by, order)
    before = from_before(ranged, by, {"__sum": F.coalesce(F.sum(value), F.lit(0))}, {"__base": F.sum("__sum")})
    so_far = F.sum(value).over(Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("__so_far", F.coalesce(so_far, F.lit(0)))
    return beside(out, before, [*by, "__part"]).select(*df.columns, (F.col("__so_far") + F.coalesce("__base", F.lit(0))).alias(name))


def sessions(df: DataFrame, by: Sequence[str], time: str, gap: Column, name: str = "session") -> DataFrame:
    """df with each row's session in its group, from 1: a row later than the one before it by more than `gap`, an interval,
    begins one. Blocks know the last time before them and the sessions begun there, so a session may span many.
    Rows without a time are a group's first session's, as they come first."""
    ranged = in_ranges(df, by, [F.col(time)])
    keys, w = [*by, "__part"], Window.partitionBy("__part", *by).orderBy(time)
    before = from_before(ranged, by, {"__last": F.max(time)}, {"__late": F.max("__last")})
    earlier = F.coalesce(F.max(time).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__late"))
    late = F.coalesce(F.col(time) > F.col("__earlier") + gap, F.lit(False)).cast("long")
    marked = beside(ranged, before, keys).withColumn("__earlier", earlier).withColumn("__late", late)
    begun = from_before(marked, by, {"__n": F.sum("__late")}, {"__base": F.sum("__n")})
    so_far = F.sum("__late").over(w.rangeBetween(Window.unboundedPreceding, 0))
    return beside(marked.withColumn("__so_far", so_far), begun, keys).select(*df.columns, (F.col("__so_far") + F.coalesce("__base", F.lit(0)) + 1).alias(name))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, right_time: str | None = None, ties: Sequence[str] = (), how: str = "left", strict: bool = False, within: Column | None = None) -> DataFrame:
    """Each row of left with the latest row of right that has the same `by` and is not later (strict: is earlier).

    Returns left's columns, then right's without `by`; a name that both have gets `right_` in front. Among right's rows of one
    time the greatest by `ties` is meant. Null times and null keys match nothing; how = "inner" drops rows without a match. within:
    an interval; an older match counts as none. Both sides are put in one order and cut into blocks, the last row of
    right is carried on within each block and then between blocks, so one key may have nearly all rows. No row is
    multiplied: the work is that of two shuffles of both sides. Repeated rows of left are rows of their own.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how!r}")
    right_time = right_time or time
    rest = [c for c in right.columns if c not in by]
    names = [f"right_{c}" if c in left.columns else c for c in rest]
    keys = [f"__k{i}" for i in range(len(by))]
    payload = {"__l": F.struct(*[left[c] for c in left.columns]), "__r": F.struct(*[right[c].alias(n) for c, n in zip(rest, names)])}
    kind = {c: payload[c] for c in payload}

    def side(df: DataFrame, at: str, mine: str, tie: list[Column], first: int) -> DataFrame:
        return df.select(*[df[b].alias(k) for b, k in zip(by, keys)], df[at].alias("__t"), F.lit(first).alias("__first"), F.struct(*tie).alias("__tie") if tie else F.lit(None).alias("__tie"), kind[mine].alias(mine))

    usable = right.where(" and ".join(f"`{c}` is not null" for c in (*by, right_time)))
    a = side(left, time, "__l", [], 0 if strict else 1)
    b = side(usable, right_time, "__r", [usable[c] for c in ties], 1 if strict else 0)
    if ties:
        a = a.withColumn("__tie", F.lit(None).cast(b.schema["__tie"].dataType))
    ranged = in_ranges(a.unionByName(b, allowMissingColumns=True), keys, [F.col(c) for c in ("__t", "__first", "__tie")])
    at = F.struct("__t", "__first", "__tie")
    last = F.max_by("__r", F.when(F.col("__r").isNotNull(), at))
    before = from_before(ranged, keys, {"__last": last}, {"__old": F.last("__last", ignorenulls=True)})
    rows = Window.partitionBy("__part", *keys).orderBy("__t", "__first", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("__seen", F.last("__r", ignorenulls=True).over(rows)).where("__l is not null")
    found = beside(seen, before, [*keys, "__part"]).select("__l", "__t", F.when(F.col("__t").isNotNull(), F.coalesce("__seen", "__old")).alias("__r"))
    new_time = names[rest.index(right_time)]
    if within is not None:
        found = found.withColumn("__r", F.when(F.col(f"__r.{new_time}") >= F.col("__t") - within, F.col("__r")))
    if how == "inner":
        found = found.where("__r is not null")
    return found.select("__l.*", "__r.*")


def with_halo(df: DataFrame, nth: str, halo: int, rows: int | None = None) -> DataFrame:
    """df with `__block`, whole blocks of a group's rows by their places, and `__own`; a block's last `halo` rows are
    in the next one too, not as its own, so that windows of so many rows back are whole."""
    rows = max(rows or BLOCK_ROWS, halo)
    block = F.floor(F.col(nth) / rows)
    also = F.when(F.pmod(F.col(nth), F.lit(rows)) >= rows - halo, F.array(block, block + 1)).otherwise(F.array(block))
    return df.select("*", F.explode(also).alias("__block")).withColumn("__own", F.col("__block") == block)


def _scan_in_order(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """df with `__y{i}` and `__p{i}` for i < n: along each group of keys in order, y = d * y + a from 0, and the product of d."""
    schema = StructType([*df.schema, *[StructField(f"__{c}{i}", DoubleType()) for i in range(n) for c in "yp"]])

    def scan(batches):
        last, state = None, []
        for b in batches:
            if not b.num_rows:
                continue
            key = list(zip(*[b.column(c).to_pylist() for c in keys]))
            starts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
            steps = [list(zip(b.column(f"__d{i}").to_pylist(), b.column(f"__a{i}").to_pylist())) for i in range(n)]
            runs: list[list[tuple[float, float]]] = [[] for _ in range(n)]
            for i, j in zip(starts, starts[1:]):
                if key[i] != last:
                    last, state = key[i], [(0.0, 1.0)] * n
                for k in range(n):
                    runs[k] += list(accumulate(steps[k][i:j], lambda s, x: (x[0] * s[0] + x[1], x[0] * s[1]), initial=state[k]))[1:]
                    state[k] = runs[k][-1]
            made = [pa.array([r[c] for r in run], pa.float64()) for run in runs for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[f.name for f in schema])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(scan, schema)


def affine_scan(df: DataFrame, by: Sequence[str], nth: str, recursions: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df with, for each name, y = decay * (y of the row before) + add along a group's places, from 0 before its first.

    df has `__block`, which cuts groups into runs of neighbouring places. Each block is scanned from 0, with the product
    of its decays: its last row is an affine map of what comes before it. Those maps are scanned by group, one row
    for each block, and give each block's beginning. Neither decay nor add may be null.
    """
    n, keys, kept = len(recursions), [*by, "__block"], df.columns
    pairs = {f"__{k}{i}": c.cast("double") for i, pair in enumerate(recursions.values()) for k, c in zip("da", pair)}
    scanned = stored(_scan_in_order(df.withColumns(pairs), keys, nth, n))
    ends = scanned.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"__{c}{i}") for i in range(n) for c in "yp"]), nth).alias("e"))
    ends = ends.select(*keys, *[F.col(f"e.__{old}{i}").alias(f"__{new}{i}") for i in range(n) for new, old in (("d", "p"), ("a", "y"))])
    begins = _scan_in_order(ends, by, "__block", n).select(*by, (F.col("__block") + 1).alias("__block"), *[F.col(f"__y{i}").alias(f"__b{i}") for i in range(n)])
    out = beside(scanned, begins, keys)
    y = {name: F.col(f"__y{i}") + F.col(f"__p{i}") * F.coalesce(f"__b{i}", F.lit(0.0)) for i, name in enumerate(recursions)}
    return out.select(*[c for c in kept if c not in y], *[c.alias(k) for k, c in y.items()])
