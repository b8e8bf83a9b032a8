"""Packing documents into token sequences of bounded length: best fit, then swap-based local search."""

from __future__ import annotations

import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, ragged, staged, text_slices
from .tokenization import ENCODED_BYTES, encode

#: Pieces that are packed together in one task, and bytes of their ids where those are wanted.
GROUP_PIECES, GROUP_BYTES = 16384, 32 << 20
#: Sequences of one whole piece have numbers from here on, by the task that cut it.
FULL = 1 << 62


def best_fit(lengths: list[int], cap: int) -> list[list[int]]:
    """Items, longest first, each into the fullest bin that still holds it. A bin is a list of items."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        fits = rooms >> size << size
        if fits:
            room = (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = cap, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


class OpenBins:
    """Bins that are neither full nor empty, by their room, and the sizes of items that bins of one room hold.

    Rooms and sizes are bits of whole numbers, so the least that will do is found without a look at any bin.
    """

    def __init__(self, cap: int):
        self.cap = cap
        self.by_room: list[dict[int, None]] = [{} for _ in range(cap + 1)]
        self.sizes = [0] * (cap + 1)
        self.holders: dict[tuple[int, int], dict[int, None]] = {}
        self.rooms = 0

    def enter(self, b: int, room: int, held: dict[int, list[int]]) -> None:
        self.by_room[room][b] = None
        self.rooms |= 1 << room
        for size in held:
            self.holders.setdefault((room, size), {})[b] = None
            self.sizes[room] |= 1 << size

    def leave(self, b: int, room: int, held: dict[int, list[int]]) -> None:
        del self.by_room[room][b]
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        for size in held:
            holders = self.holders[room, size]
            del holders[b]
            if not holders:
                self.sizes[room] ^= 1 << size

    def best_step(self, room: int, held: dict[int, list[int]]) -> tuple[tuple[int, ...], int, int] | None:
        """What a bin of this room, which has left, should give: (sizes given, size taken or 0, the bin that takes).

        A bin takes that is at least as full, so that the sum of squared fills grows: an item that fits, the
        largest, where it leaves the least room; else one or two items for a shorter one, with the most gain.
        """
        rooms = self.rooms & ((2 << room) - 1)
        for size in sorted(held, reverse=True):
            if fits := rooms >> size << size:
                return (size,), 0, next(iter(self.by_room[(fits & -fits).bit_length() - 1]))
        given = {s: (s,) for s in held}
        for s in held:
            for t in held:
                if s < t or (s == t and len(held[s]) > 1):
                    given.setdefault(s + t, (s, t))
        gain, best, open_rooms = 0, None, []
        while rooms:
            open_rooms.append((rooms & -rooms).bit_length() - 1)
            rooms &= rooms - 1
        for r in reversed(open_rooms):
            if r <= gain:
                break  # no bin of so little room can gain more
            sizes = self.sizes[r]
            for total, out in given.items():
                least = max(1, total - r)
                if (longer := sizes >> least) and (taken := least + (longer & -longer).bit_length() - 1) < total - gain:
                    gain, best = total - taken, (out, taken, r)
        return (*best[:2], next(iter(self.holders[best[2], best[1]]))) if best else None


def local_search(bins: list[list[int]], lengths: list[int], cap: int) -> list[list[int]]:
    """Empties underfull bins. The emptiest gives its items away: each is moved, or exchanged for a shorter
    item, or two are exchanged for one, always so that the sum of squared fills grows. A bin that can give
    nothing more away is left as it is until an exchange changes it; it ends when none can give."""
    held: list[dict[int, list[int]]] = []
    for items in bins:
        by_size: dict[int, list[int]] = {}
        for i in items:
            by_size.setdefault(lengths[i], []).append(i)
        held.append(by_size)
    fill = [sum(lengths[i] for i in items) for items in bins]
    least, alive = -(-sum(lengths) // cap), sum(map(bool, bins))
    open_bins = OpenBins(cap)
    for b, f in enumerate(fill):
        if 0 < f < cap:
            open_bins.enter(b, cap - f, held[b])
    givers = [(f, b) for b, f in enumerate(fill) if 0 < f < cap]
    heapify(givers)

    def pass_on(size: int, source: int, target: int) -> None:
        items = held[source][size]
        held[target].setdefault(size, []).append(items.pop())
        if not items:
            del held[source][size]

    while givers and alive > least:
        f, giver = heappop(givers)
        if fill[giver] != f or giver not in open_bins.by_room[cap - f]:
            continue
        open_bins.leave(giver, cap - f, held[giver])
        while held[giver] and (step := open_bins.best_step(cap - fill[giver], held[giver])):
            given, taken, taker = step
            open_bins.leave(taker, cap - fill[taker], held[taker])
            for size in given:
                pass_on(size, giver, taker)
            if taken:
                pass_on(taken, taker, giver)
            gain = sum(given) - taken
            fill[giver] -= gain
            fill[taker] += gain
            if fill[taker] < cap:
                open_bins.enter(taker, cap - fill[taker], held[taker])
                heappush(givers, (fill[taker], taker))
        if held[giver]:
            open_bins.enter(giver, cap - fill[giver], held[giver])
        else:
            alive -= 1
    return [[i for items in h.values() for i in items] for h in held if h]


def pack(lengths: list[int], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item's bin and its offset there. Lengths are from 1 to cap."""
    bins = local_search(best_fit(lengths, cap), lengths, cap)
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in sorted(items):
            which[i], offset[i] = b, at
            at += lengths[i]
    return which, offset


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, cap: int = 1024, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", at_once: int = ENCODED_BYTES) -> DataFrame:
    """Every document's ids with end_id appended, cut into pieces of at most cap ids, packed into sequences.

    Only documents of more than cap ids are cut; their first piece may be the shorter one. Returns a row per
    piece: id_col, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, ids. Null and empty
    texts are pieces of one id; repeated rows and null ids are pieces of their own; an empty table gives no
    rows. Other columns are not read. Texts are encoded once, and their pieces staged. A piece of cap ids is a
    sequence, which the task that cuts it numbers. Shorter ones, at most one a document, are dealt in turn to
    groups of at most about GROUP_PIECES pieces and GROUP_BYTES of ids, each packed in one task; a group
    does not grow with the data or with one text, and costs at most one underfull sequence. at_once: bytes of
    text that are encoded together, which changes a worker's memory and not the result.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    ids_type = ", ids array<int>" * with_ids

    def cut(batches):
        task = TaskContext.get().partitionId()
        turn, n_full = (task * 0x9E3779B1) & 0xFFFFFFFF, FULL + (task << 38)
        for b in text_slices(batches, "text", at_once):
            tokens, n = encode(b.column(1), tokenizer)
            tokens = np.insert(tokens, np.cumsum(n), end_id).astype("<u4")
            n = n + 1
            view = memoryview(tokens).cast("B")
            pieces = -(-n // cap)
            row, piece = np.repeat(np.arange(len(n)), pieces), ragged(pieces)
            first = (n - 1) % cap + 1
            start = np.where(piece > 0, first[row] + (piece - 1) * cap, 0)
            length = np.where(piece > 0, cap, first[row])
            at = (np.cumsum(n) - n)[row] + start
            crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(at.tolist(), (at + length).tolist())]
            # A sequence of its own, or the turn of a piece that others will join.
            full = length == cap
            place = np.where(full, n_full + np.cumsum(full) - 1, turn + np.cumsum(~full) - 1)
            n_full, turn = n_full + int(full.sum()), turn + int((~full).sum())
            out = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(place)]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(tokens.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, ["id", "piece", "start", "length", "ids_crc32", "place", "ids"][: len(out)])

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("id", "ascending"), ("piece", "ascending")])
        which, offset = pack(table["length"].to_pylist(), cap)
        group = table["group"][0].as_py() if len(table) else 0
        return table.append_column("sequence_id", pa.array(which + (group << 32))).append_column("offset", pa.array(offset)).drop_columns(["group"])

    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = staged(by_bytes(src).mapInArrow(cut, f"{columns}, place long{ids_type}"))
    short = pieces.where(F.col("length") < cap)
    n_short, n_ids = short.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    n_groups = max(1, -(-n_short // GROUP_PIECES), -(-4 * n_ids // GROUP_BYTES) if with_ids else 1)
    dealt = short.withColumn("group", F.pmod("place", F.lit(n_groups)).cast("long")).drop("place")
    out = dealt.groupBy("group").applyInArrow(packed, f"{columns}{ids_type}, sequence_id long, offset long")
    whole = pieces.where(F.col("length") == cap).withColumnRenamed("place", "sequence_id").withColumn("offset", F.lit(0).cast("long"))
    return out.unionByName(whole).withColumnRenamed("id", id_col)
