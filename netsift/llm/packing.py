"""Best-fit packing by bin completion with branch and bound.

A piece of 2048 ids fills a sequence alone. The others are dealt to groups by a hash, about ``GROUP`` to
a group, and each group is packed for itself. Then the sequences that any group left with more than
``ROOM`` ids of room are taken apart and their pieces packed once more, those of a sequence staying
together in one group, so what a group lacked another may have; the second packing stands only where it
needs fewer sequences. Inside a group bins are made around the largest document left: fillings of its
rest are listed lazily, those that another holds (dominated) fall away, and the search goes down the
fullest first. A branch ends when its waste exceeds what a better solution could have; best-fit
decreasing gives the first incumbent and the search stops at the lower bound or after ``NODES`` steps.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, ship, written
from .tokens import ENCODE_BYTES, encoder, with_end

CAPACITY = 2048
GROUP = 8192
ROOM = 64
NODES = 20_000  # steps of the search in a group; the incumbent stands when they are used up
DEAD_ENDS = 16  # ends of the listing without a filling that count as one step
_COMPARED = 64  # fillings of a bin that later ones are compared with


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2: large documents can't share, the rest must fit beside them."""
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // capacity)
    s = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(s)])
    for k in np.unique(s[s <= capacity // 2]):
        big = len(s) - np.searchsorted(s, capacity - k, side="right")
        lo, mid, hi = np.searchsorted(s, k), np.searchsorted(s, capacity // 2, side="right"), np.searchsorted(s, capacity - k, side="right")
        n_mid = hi - mid
        rest = max(0, int(total[mid] - total[lo]) - (n_mid * capacity - int(total[hi] - total[mid])))
        best = max(best, int(big + n_mid) + -(-rest // capacity))
    return max(best, int((s > capacity // 2).sum()))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of sizes: each document goes to the open bin with the least room that holds it."""
    room: dict[int, list[int]] = {}
    open_rooms, bins = 0, []
    for s in sorted(map(int, sizes), reverse=True):
        fit = open_rooms >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        if r > s:
            room.setdefault(r - s, []).append(b)
            open_rooms |= 1 << (r - s)
    return bins


def _totals(count: list[int], large: int) -> tuple[list[int], list[int]]:
    """Sizes there are, ascending, and for each of them the totals of it and smaller ones as bits."""
    values = [s for s in range(1, large + 1) if count[s]]
    out, bits, mask = [], 1, (2 << (len(count) - 1)) - 1
    for s in values:
        left, k = min(count[s], len(count) // s), 1
        while left:
            k = min(k, left)
            bits |= bits << k * s & mask
            left, k = left - k, 2 * k
        out.append(bits)
    return values, out


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether best fit puts all of ``b`` inside single documents of ``a`` (both descending)."""
    rooms = sorted(a)
    for s in b:
        i = bisect_left(rooms, s)
        if i == len(rooms):
            return False
        insort(rooms, rooms.pop(i) - s)
    return True


def _fillings(count: list[int], large: int, rest: int, room: int, reach: tuple[list[int], list[int]], step: list[int], nodes: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``rest`` beside ``large`` that waste at most ``room``, fullest first.

    Of one total, larger documents come before smaller, so what dominates a filling comes before it.
    ``reach`` (of this or a larger table) spares totals that can't be made. A filling is a step, as
    are ``DEAD_ENDS`` dead ends. ``count`` must be the same whenever the next one is asked for.
    """
    values, bits = reach
    taken, kept = {large: 1}, []
    top = bisect_right(values, rest) - 1
    totals = bits[top] & ((2 << rest) - 1) if top >= 0 else 1
    while totals:
        total = totals.bit_length() - 1
        if rest - total > room:
            return
        totals ^= 1 << total
        path, need, j = [], total, top
        while True:
            if need:
                j = min(j, bisect_right(values, need) - 1)
                while j >= 0 and bits[j] >> need & 1:
                    s = values[j]
                    if taken.get(s, 0) < count[s] and bits[j] >> (need - s) & 1:
                        break
                    j -= 1
                else:
                    j = -1
                if j >= 0:
                    path.append(j)
                    taken[s] = taken.get(s, 0) + 1
                    need -= s
                    continue
            step[0] += 1 if need else DEAD_ENDS
            if step[0] > nodes * DEAD_ENDS:
                return
            if not need:
                fill = tuple(values[i] for i in path)
                # one more document that fits beside it makes a filling that holds it
                more = any(taken.get(s, 0) < count[s] for s in values[: bisect_right(values, rest - total)])
                if not more and not any(_dominates(k, fill) for k in kept):
                    if len(kept) < _COMPARED:
                        kept.append(fill)
                    yield fill
            if not path:
                break
            j = path.pop()
            taken[values[j]] -= 1
            need += values[j]
            j -= 1


def complete_bins(sizes: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Bins (lists of sizes), as few as the search finds; sizes are 1 to ``capacity``.

    They are as few as possible unless the search takes more than ``nodes`` steps.
    """
    best = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(best) <= bound:
        return best
    count, total = np.bincount(sizes, minlength=capacity + 1).tolist(), int(sizes.sum())
    bins, waste, left, step = [], 0, len(sizes), [0]
    choices: list = []
    while True:
        spare = (len(best) - 1) * capacity - total  # what a better solution may waste
        if left and len(choices) == len(bins):
            large, reach, then = choices[-1][:3] if choices else (capacity, None, 0)
            while not count[large]:
                large -= 1
            if not reach or 2 * left <= then > 256:  # else the totals of a larger table still hold
                reach, then = _totals(count, large), left
            choices.append((large, reach, then, _fillings(count, large, capacity - large, spare - waste, reach, step, nodes)))
        large, options = choices[-1][0], choices[-1][3]
        fill = next(options, None)
        if fill is not None and waste + capacity - large - sum(fill) <= spare:
            bins.append([large, *fill])
            waste += capacity - sum(bins[-1])
            left -= len(bins[-1])
            for s in bins[-1]:
                count[s] -= 1
            if left:
                continue
            if len(bins) < len(best):
                best = [list(b) for b in bins]
            if len(best) <= bound:
                return best
        else:
            choices.pop()  # the others are emptier still
        if not bins or step[0] >= nodes * DEAD_ENDS:
            return best
        back = bins.pop()
        for s in back:
            count[s] += 1
        left += len(back)
        waste -= capacity - sum(back)


def _cut(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for c in by_bytes(batches, most=ENCODE_BYTES):
            ids, off = with_end(*enc.encode(c.column("text").to_pylist()))
            raw, docs = ids.astype("<u4"), np.diff(off)
            number = -(-docs // CAPACITY)  # pieces of each document
            doc = np.repeat(np.arange(len(docs)), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            first = (docs - 1) % CAPACITY + 1  # only the first may be shorter
            length = np.where(piece == 0, first[doc], CAPACITY)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * CAPACITY)
            begin = off[doc] + start
            crc = [zlib.crc32(raw[i : i + n]) for i, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [c.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents as pieces of at most 2048 ids with the end id; only a first piece may be shorter."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_cut(tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """Places of a group's pieces. Where they have places already, those stand unless fewer sequences do."""
    rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
    sizes = rows["length"].to_numpy()
    bins = complete_bins(sizes)
    if rows["sequence_id"].notna().all() and len(bins) >= rows["sequence_id"].nunique():
        return rows[_COLUMNS]
    last = np.searchsorted(sizes, np.arange(CAPACITY + 2))  # documents of one size are alike
    seq, offset, room = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for b, filled in enumerate(bins):
        at = 0
        for s in filled:
            i = last[s]
            last[s] += 1
            seq[i], offset[i], room[i] = b, at, CAPACITY - sum(filled)
            at += s
    rows["sequence_id"], rows["offset"], rows["room"] = (rows["grp"].to_numpy(np.int64) << 32) + seq, offset, room
    return rows[_COLUMNS]


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "room"]
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, room long"


def packed(docs: DataFrame, tokenizer: str, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    Null text counts as empty and is the end id alone; repeated rows are packed as often as they
    occur; rows without doc_id are packed too; an empty table gives an empty result. Other columns of
    ``docs`` are ignored.
    """
    cut = written(pieces(docs, tokenizer), "pieces").withColumn("row", F.monotonically_increasing_id())
    whole = cut.where(F.col("length") == CAPACITY).withColumns({"sequence_id": F.col("row") + (1 << 61), "offset": F.lit(0).cast("long")})
    some = cut.where(F.col("length") < CAPACITY)
    groups = max(1, -(-some.count() // group))
    no = F.lit(None).cast("long")
    # the row's number: pieces that are alike are dealt to different groups
    some = some.withColumns({"grp": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(groups)), "sequence_id": no, "offset": no, "room": no})
    once = written(some.groupBy("grp").applyInPandas(_pack, _SCHEMA), "once")
    loose = once.where(F.col("room") > ROOM)
    again = max(1, -(-loose.count() // group))
    twice = loose.withColumn("grp", F.pmod(F.xxhash64("sequence_id"), F.lit(again)) + groups).groupBy("grp").applyInPandas(_pack, _SCHEMA)
    last = _COLUMNS[:-1]
    return once.where(F.col("room") <= ROOM).select(*last).unionByName(twice.select(*last)).unionByName(whole.select(*last))
