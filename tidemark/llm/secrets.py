r"""Secrets in texts, and weak candidates that their complements confirm, by DataFrame functions alone.

Base spans (assignments, access keys, hexadecimal runs) stand for themselves. Weak candidates (logins, opaque tokens,
endpoints) are too common to be told alone: one is told only where its complement is in its scope. A scope is a
paragraph, and in it REACH characters from the end of one part to the start of the next. Identifiers (access keys,
logins) and secrets (assignments, hexadecimal runs, opaque tokens) of one scope are credentials; endpoints in the
scope of a credential's part belong to it. Parts meet by an interval join: equal document, paragraph and bin of
places, then the distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# The contract's base patterns, and its least lengths of an assigned value and of the matches.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE_LENGTH = 6

LOGIN = r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"(?:https?|ftp|ssh|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@-]+"
#: Longer runs of letters and digits are data and no token.
OPAQUE_LENGTH = 128
#: Between paragraphs.
BLANK = r"\n[ \t\r]*\n"

KINDS = ["assign", "access", "hex", "login", "opaque", "endpoint"]
N_BASE, BREAK = 3, len(KINDS)
IDENTIFIERS, SECRETS, ENDPOINTS = (1, 3), (0, 2, 4), (5,)

#: Code points between two parts of a scope, at most; and the width of a bin of places, no less than that.
REACH, BIN = 200, 256
#: Matches of a text whose places are summed up together.
RUN = 256

PLACE = "struct<start:int,end:int>"


def bound(value: Column, body) -> Column:
    """body(value), with value made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column) -> Column:
    """A (total, places) of steps (gap, size, keep): the places of those kept, counted from the first step's gap on."""
    none = F.array().cast(f"array<{PLACE}>")

    def add(acc: Column, p: Column) -> Column:
        begin = acc["total"] + p["gap"]
        place = F.array(F.struct(begin.alias("start"), (begin + p["size"]).alias("end")))
        return F.struct((begin + p["size"]).alias("total"), F.when(p["keep"], F.concat(acc["places"], place)).otherwise(acc["places"]).alias("places"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("total"), none.alias("places")), add)


def matches(text: Column, pattern: str, keep=None, group: int = 0) -> Column:
    """The places of a pattern's leftmost matches that do not overlap; keep(match or its group) drops some of them.

    The texts between matches and the matches follow one another, so their lengths' running sums are the places:
    sums of runs of RUN matches, then of the runs, since a fold copies what it has gathered at each step.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("hit")))
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        pairs = F.zip_with(pairs, values, lambda p, v: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), v.alias("hit")))
    steps = F.transform(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        lambda p: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), (keep(p["hit"]) if keep else F.lit(True)).alias("keep")),
    )
    runs = bound(steps, lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / RUN).cast("int")), lambda k: running(F.slice(s, k * RUN + 1, RUN))))
    moved = lambda r, base: F.transform(r["places"], lambda p: F.struct((p["start"] + base).alias("start"), (p["end"] + base).alias("end")))
    bases = lambda rs: F.aggregate(rs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["total"])))
    places = bound(runs, lambda rs: F.flatten(F.zip_with(rs, F.slice(bases(rs), 1, F.size(rs)), moved)))
    return F.when(text.rlike(pattern), places).otherwise(F.array().cast(f"array<{PLACE}>"))


def all_places(text: Column) -> dict[str, Column]:
    """Each kind's places in a text."""
    mixed = lambda h: (F.length(h) <= OPAQUE_LENGTH) & h.rlike("[a-z]") & h.rlike("[A-Z]") & h.rlike("[0-9]")
    return {
        "assign": matches(text, ASSIGN, lambda v: F.length(v) >= VALUE_LENGTH, group=2),
        "access": matches(text, ACCESS),
        "hex": matches(text, HEX),
        "login": matches(text, LOGIN),
        "opaque": matches(text, OPAQUE, mixed),
        "endpoint": matches(text, ENDPOINT),
    }


def of_kind(kind: int, places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end")))


def any_of(kinds: tuple[int, ...]) -> Column:
    """A document has a part of these kinds."""
    return F.greatest(F.lit(0), *[F.size(KINDS[k]) for k in kinds]) > 0


def near(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs of parts of one scope of which the first ends before the second starts. Columns a and b are the parts.

    A bin holds only as many parts as fit into its characters, so neither a key nor the pairs grow with the data.
    """
    ends = before.select("row", "scope", F.col("part").alias("a"), F.explode(F.array(F.floor(F.col("part.end") / BIN), F.floor(F.col("part.end") / BIN) + 1)).alias("bin"))
    starts = after.select("row", "scope", F.col("part").alias("b"), F.floor(F.col("part.start") / BIN).alias("bin"))
    return ends.join(starts, ["row", "scope", "bin"]).where(F.expr(f"b.start - a.end between 0 and {REACH}")).drop("bin")


def linked_parts(parts: DataFrame) -> DataFrame:
    """(row, part) of all parts of credentials: identifiers and secrets that share a scope, and endpoints in it."""
    identifiers, secrets, endpoints = (parts.where(F.col("part.kind").isin(*kinds)) for kinds in (IDENTIFIERS, SECRETS, ENDPOINTS))
    pairs = near(identifiers, secrets).unionByName(near(secrets, identifiers))
    members = staged(pairs.select("row", "scope", F.explode(F.array("a", "b")).alias("part")).distinct())
    at = near(endpoints, members).select("row", F.col("a").alias("part")).unionByName(near(members, endpoints).select("row", F.col("b").alias("part")))
    return members.select("row", "part").unionByName(at.distinct())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id_col, base and spans: arrays of (start, kind, end) in that order; places count code points, end
    exclusive, and kind is a place in KINDS. spans are the base spans and the weak candidates that are confirmed.

    A weak part inside a base span is part of that and no candidate. Null and empty texts have no spans; repeated
    rows and null ids are rows of their own; an empty table gives an empty one. Other columns are not read. The
    texts are read once and never shuffled: what is found is staged, and only rows that hold an identifier, a secret
    and a weak part send their parts to the join. Rows are told apart by their place in the scan, which the staged
    table keeps, so neither copies of a text nor of an id meet under one key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    found = src.select(F.monotonically_increasing_id().alias("row"), "id", text.alias("text"), *[c.alias(k) for k, c in all_places(text).items()])
    to_join = any_of(IDENTIFIERS) & any_of(SECRETS) & any_of((3, 4, 5))
    base = F.sort_array(F.concat(*[of_kind(k, F.col(KINDS[k])) for k in range(N_BASE)]))
    weak = F.concat(*[of_kind(k, F.col(KINDS[k])) for k in range(N_BASE, BREAK)], of_kind(BREAK, matches(F.col("text"), BLANK)))
    scanned = staged(found.select("row", "id", base.alias("base"), F.when(to_join, weak).alias("weak")))

    joined = scanned.where("weak is not null")
    events = joined.select("row", F.explode(F.concat("base", "weak")).alias("part"))
    so_far = Window.partitionBy("row").orderBy("part.start")
    kind, end = F.col("part.kind"), F.col("part.end")
    parts = events.select(
        "row",
        "part",
        F.count_if(kind == BREAK).over(so_far).alias("scope"),
        F.coalesce(F.max(F.when(kind < N_BASE, end)).over(so_far) >= end, F.lit(False)).alias("inside"),
    ).where((kind < N_BASE) | ((kind < BREAK) & ~F.col("inside")))
    told = linked_parts(staged(parts.drop("inside"))).where(kind >= N_BASE)
    told = told.groupBy("row").agg(F.collect_list("part").alias("more"))
    spans = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    out = joined.join(told, "row", "left").select("id", "base", spans.alias("spans"))
    alone = scanned.where("weak is null").select("id", "base", F.col("base").alias("spans"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def n_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def written(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
