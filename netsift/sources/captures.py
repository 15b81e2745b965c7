"""Binary files of any size: bytes by range, capture files and datagram logs parsed in parallel.

Spark's text reader cuts a file into byte ranges and gives the raw bytes between line feeds, in any store
that Spark reads. Lengths summed up over a file give every piece its exact offset, so the bytes can be
dealt to cells of equal size, each with the beginning of the next (``byte_cells``): no file lies in one value.

Records have no marks. Every cell guesses its first record by a chain of plausible heads and walks from there
to the first record of the next cell. One row for each cell then says whether it began where the cell before
ended; the few that didn't walk again from there, until all agree. As the first cell's start is known, the
result is exact, whatever the guesses were.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ship, written

#: Bytes of a cell, and of the next one that it also holds: more than any record (a frame has 262,144 bytes at most).
CELL, OVERLAP = 1 << 22, 300_000
#: Heads in a row that make a guess.
CHAIN = 6

# Link type, magic numbers, block types and options of capture files.
ETHERNET = 1
PCAP = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
BYTE_ORDER = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
IF_TSRESOL, IF_TSOFFSET = 9, 14


# -- bytes by range


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one range of one file joined to pieces of about a cell."""
    key, held, size, seq = None, [], 0, 0

    def piece() -> pa.RecordBatch:
        path, start, whole = key
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([whole], pa.int64()), pa.array([start], pa.int64()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["path", "size", "start", "seq", "n", "data"])

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("path", "start", "size", "value")]
        for path, start, whole, value in zip(*columns):
            if (path, start, whole) != key or size >= CELL:
                if held:
                    yield piece()
                seq = 0 if (path, start, whole) != key else seq + 1
                key, held, size = (path, start, whole), [], 0
            held += (value, b"\n")
            size += len(value) + 1
    if held:
        yield piece()


def byte_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, offset, n, data): the bytes of every file below ``path``; the last piece may have a line feed too many.

    Written to the shared folder. Files whose bytes don't add up to their size (compressed ones) raise.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    p = written(raw.mapInArrow(_pieces, "path string, size long, start long, seq long, n long, data binary"), "pieces")
    each = Window.partitionBy("path")
    at = p.select("path", "start", "seq", (F.sum("n").over(each.orderBy("start", "seq")) - F.col("n")).alias("offset"), F.sum("n").over(each).alias("_all"))  # one row a piece
    out = p.join(at, ["path", "start", "seq"])
    odd = ~(F.col("_all") - F.col("size")).isin(0, 1)
    return out.select("path", "size", F.when(odd, F.raise_error(F.concat("path", F.lit(" isn't as long as its bytes")))).otherwise(F.col("offset")).cast("long").alias("offset"), "n", "data")


def byte_cells(spark: SparkSession, path: str, cell: int = CELL, overlap: int = OVERLAP) -> DataFrame:
    """(path, size, cell, data): bytes [cell * ``cell``, (cell + 1) * ``cell`` + ``overlap``) of every file, written."""
    p = byte_pieces(spark, path)
    end = F.least(F.col("offset") + F.col("n"), F.col("size"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("offset") - overlap) / cell)), F.floor((end - 1) / cell)
    x = p.where(F.col("offset") < end).withColumn("cell", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    lo, hi = F.greatest(F.col("offset"), F.col("cell") * cell), F.least(end, (F.col("cell") + 1) * cell + overlap)
    x = x.withColumns({"_lo": lo, "_hi": hi}).where("_hi > _lo")
    part = F.substring("data", (F.col("_lo") - F.col("offset") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int"))
    parts = x.groupBy("path", "size", "cell").agg(F.array_sort(F.collect_list(F.struct(F.col("_lo").alias("at"), part.alias("part")))).alias("parts"))  # a cell's bytes
    data = F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["part"]))
    return written(parts.select("path", "size", "cell", data.alias("data")), "cells")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path`` as the driver's file index lists them, those without a byte too."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    return spark.createDataFrame([(re.sub("^file:/+", "file:/", n),) for n in names], "path string")  # as the metadata column writes it


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, sha = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sha.hexdigest()])], names=["path", "sha256"])
    for b in batches:
        for i in range(b.num_rows):
            mine = b.column("path")[i].as_py()
            if mine != path:
                if sha:
                    yield row()
                path, sha = mine, hashlib.sha256()
            left = b.column("size")[i].as_py() - b.column("offset")[i].as_py()
            sha.update(memoryview(b.column("data")[i].as_buffer())[:left])
    if sha:
        yield row()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below ``path``, empty ones too; a file's pieces pass through a task one by one."""
    p = byte_pieces(spark, path).repartition("path").sortWithinPartitions("path", "offset").select("path", "size", "offset", "data")
    found = p.mapInArrow(_digesting, "path string, sha256 string")
    found = written(found, "digests")
    listed = _listed(spark, path).join(found, "path", "left_anti").select("path", F.lit(hashlib.sha256().hexdigest()).alias("sha256"))
    return found.unionByName(listed)


# -- formats: heads at every offset, the walk from record to record, what a record holds


class Cut(ValueError):
    """A record that goes on beyond the bytes at hand."""


def _u4(view: np.ndarray, at: int, n: int, order: str) -> np.ndarray:
    """The unsigned numbers of four bytes at offsets at to at + n - 1."""
    b = [view[at + k : at + k + n].astype(np.uint32) for k in range(4)]
    b = b if order == "<" else b[::-1]
    return b[0] | b[1] << np.uint32(8) | b[2] << np.uint32(16) | b[3] << np.uint32(24)


class Pcap:
    """Classic capture files of both byte orders, in microseconds or nanoseconds."""

    orders = ("<1", ">1", "<1000", ">1000")
    head = 16
    step = 1

    @staticmethod
    def open(data: bytes) -> tuple[int, str]:
        if len(data) < 24 or data[:4] not in PCAP:
            raise ValueError("is no capture file")
        order, unit = PCAP[data[:4]]
        if struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF != ETHERNET:
            raise ValueError("is not Ethernet")
        return 24, f"{order}{unit}"

    @staticmethod
    def plausible(view: np.ndarray, n: int, order: str) -> np.ndarray:
        fraction, size, length = (_u4(view, k, n, order[0]) for k in (4, 8, 12))
        return (fraction < 1_000_000_000 // (1 if order[1:] == "1000" else 1000)) & (size > 0) & (size <= 262_144) & (length >= size) & (length < 1 << 24)

    @staticmethod
    def next(data: bytes, at: int, order: str) -> tuple[int, str, bool]:
        """End of the record, byte order behind it, and whether it is a frame."""
        if at + 16 > len(data):
            raise Cut
        return at + 16 + struct.unpack_from(order[0] + "I", data, at + 8)[0], order, True

    @staticmethod
    def about(data: bytes, at: int, end: int, order: str) -> tuple | None:
        return None

    @staticmethod
    def value(data: bytes, at: int, end: int, order: str, known: list) -> tuple:
        s, fraction = struct.unpack_from(order[0] + "II", data, at)
        return s * 1_000_000 + fraction // int(order[1:]), data[at + 16 : end]


class PcapNg:
    """Block captures: sections of either byte order, interfaces with their own clocks."""

    orders = ("<", ">")
    head = 12
    step = 4

    @staticmethod
    def open(data: bytes) -> tuple[int, str]:
        if len(data) < 28 or struct.unpack_from("<I", data)[0] != SECTION or data[8:12] not in BYTE_ORDER:
            raise ValueError("is no capture file")
        return 0, BYTE_ORDER[data[8:12]]

    @staticmethod
    def plausible(view: np.ndarray, n: int, order: str) -> np.ndarray:
        total = _u4(view, 4, n, order)
        return (total % 4 == 0) & (total >= 12) & (total <= OVERLAP)

    @staticmethod
    def next(data: bytes, at: int, order: str) -> tuple[int, str, bool]:
        if at + 12 > len(data):
            raise Cut
        kind = struct.unpack_from(order + "I", data, at)[0]
        if kind == SECTION:
            if data[at + 8 : at + 12] not in BYTE_ORDER:
                raise ValueError("has a section without byte order")
            order = BYTE_ORDER[data[at + 8 : at + 12]]
        total = struct.unpack_from(order + "I", data, at + 4)[0]
        if total < 12 or total % 4:
            raise ValueError("has a block of impossible length")
        if at + total > len(data):
            raise Cut
        if struct.unpack_from(order + "I", data, at + total - 4)[0] != total:
            raise ValueError("has a block with two lengths")
        return at + total, order, kind in (OLD_PACKET, SIMPLE_PACKET, PACKET)

    @staticmethod
    def about(data: bytes, at: int, end: int, order: str) -> tuple | None:
        """(0, 0, 0, 0) for a section, (1, link type, ticks a second, offset in seconds) for an interface."""
        kind = struct.unpack_from(order + "I", data, at)[0]
        if kind == SECTION:
            return 0, 0, 0, 0
        if kind != INTERFACE:
            return None
        if end - at < 20:
            raise ValueError("has an interface that is cut")
        link, ticks, offset, o = struct.unpack_from(order + "H", data, at + 8)[0], 1_000_000, 0, at + 16
        while o + 4 <= end - 4:
            code, size = struct.unpack_from(order + "HH", data, o)
            if code == 0 or o + 4 + size > end - 4:
                break
            if code == IF_TSRESOL and size == 1:
                r = data[o + 4]
                ticks = 2 ** (r & 0x7F) if r & 0x80 else 10**r
            elif code == IF_TSOFFSET and size == 8:
                offset = struct.unpack_from(order + "q", data, o + 4)[0]
            o += 4 + size + -size % 4
        if not 1 <= ticks < 2**63:
            raise ValueError("has an interface with an impossible clock")
        return 1, link, ticks, offset

    @staticmethod
    def value(data: bytes, at: int, end: int, order: str, known: list) -> tuple:
        kind = struct.unpack_from(order + "I", data, at)[0]
        if kind == SIMPLE_PACKET:
            interface, high, low, held, body = 0, None, None, None, at + 12
            held = min(struct.unpack_from(order + "I", data, at + 8)[0], end - 4 - body)
        elif kind == PACKET:
            interface, high, low, held = struct.unpack_from(order + "4I", data, at + 8)
            body = at + 28
        else:
            interface, _, high, low, held = struct.unpack_from(order + "HHIII", data, at + 8)
            body = at + 28
        if body + held > end - 4:
            raise ValueError("has a frame that is longer than its block")
        if interface >= len(known):
            raise ValueError("has a frame of an unknown interface")
        link, ticks, offset = known[interface]
        if link != ETHERNET:
            raise ValueError("is not Ethernet")
        time = None if high is None else ((high << 32) | low) * 1_000_000 // ticks + offset * 1_000_000
        return time, data[body : body + held]


class Datagrams:
    """Logs of (time as a double, length, payload), highest byte first."""

    orders = (">",)
    head = 12
    step = 1

    @staticmethod
    def open(data: bytes) -> tuple[int, str]:
        return 0, ">"

    @staticmethod
    def plausible(view: np.ndarray, n: int, order: str) -> np.ndarray:
        time = np.empty(n)
        for k in range(min(8, n)):
            part = view[k : k + (len(view) - k) // 8 * 8].view(">f8")
            time[k::8] = part[: len(time[k::8])]
        with np.errstate(invalid="ignore"):
            return (time >= 0) & (time < 2**33) & (_u4(view, 8, n, ">") <= 0xFFFF)

    @staticmethod
    def next(data: bytes, at: int, order: str) -> tuple[int, str, bool]:
        if at + 12 > len(data):
            raise Cut
        return at + 12 + struct.unpack_from(">I", data, at + 8)[0], order, True

    @staticmethod
    def about(data: bytes, at: int, end: int, order: str) -> tuple | None:
        return None

    @staticmethod
    def value(data: bytes, at: int, end: int, order: str, known: list) -> tuple:
        return struct.unpack_from(">d", data, at)[0], data[at + 12 : end]


FORMATS = {"pcap": Pcap, "pcapng": PcapNg, "datagrams": Datagrams}


def _records(form, data: bytes, at: int, order: str, limit: int) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, byte order, is a frame) of the records that start before ``limit``."""
    while at < limit:
        end, order, frame = form.next(data, at, order)
        if end > len(data):
            raise Cut
        yield at, end, order, frame
        at = end


def _guess(form, data: bytes, ends_file: bool) -> tuple[int, str] | None:
    """The first offset from which a chain of plausible heads goes on, with its byte order."""
    n = min(len(data) - form.head, OVERLAP)
    if n <= 0:
        return None
    view, best = np.frombuffer(data, np.uint8), None
    for order in form.orders:
        good = form.plausible(view, n, order)
        for at in np.flatnonzero(good[:: form.step]) * form.step:
            if best and at >= best[0]:
                break
            here, now, links = int(at), order, 0
            try:
                while links < CHAIN and here + form.head <= len(data):
                    if here < n and not good[here]:
                        break
                    here, now, _ = form.next(data, here, now)
                    links += 1
                else:
                    if links == CHAIN or here == len(data) or (links > 2 and here > len(data) - form.head and not ends_file):
                        best = int(at), order
                        break
            except Cut:
                if links > 2 and not ends_file:
                    best = int(at), order
                    break
            except ValueError:
                continue
    return best


_STATE_SQL = "path string, size long, cell long, start long, begins string, end long, ends string, frames long, about array<struct<kind: int, link: int, ticks: long, offset: long>>, error string"
_ABOUT = pa.list_(pa.struct([("kind", pa.int32()), ("link", pa.int32()), ("ticks", pa.int64()), ("offset", pa.int64())]))


def _walking(form, cell: int):
    """One row for each cell: where its records start and end. Cells without a given start guess it."""

    def walk(data: bytes, number: int, size: int, given: tuple[int, str] | None) -> tuple:
        base = number * cell
        limit = min(cell, size - base)
        about, frames, at, order = [], 0, None, ""
        try:
            if given:
                at, order = given[0] - base, given[1]
            elif number == 0:
                at, order = form.open(data)
            elif found := _guess(form, data, base + len(data) >= size):
                at, order = found
            if at is None:
                return -1, "", -1, "", 0, [], "has no record that can be found"
            first, begins, end = at, order, at
            for start, end, order, frame in _records(form, data, at, order, limit):  # noqa: B007
                frames += frame
                if x := form.about(data, start, end, order):
                    about.append(dict(zip(("kind", "link", "ticks", "offset"), x)))
            return first + base, begins, end + base, order, frames, about, None
        except Cut:
            why = "is cut" if base + len(data) >= size else "has a record that is too long"
        except ValueError as e:
            why = str(e)
        return (-1 if at is None else at + base), order if at is not None else "", -1, "", 0, [], why

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, size, number, data = (b.column(c)[i].as_py() for c in ("path", "size", "cell", "data"))
                given = (b.column("given")[i].as_py(), b.column("order")[i].as_py()) if "given" in b.schema.names else None
                values = (path, size, number, *walk(data, number, size, given))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), _ABOUT, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["path", "size", "cell", "start", "begins", "end", "ends", "frames", "about", "error"])

    return run


def _agreed(cells: DataFrame, form, cell: int) -> DataFrame:
    """The walk of every cell, each beginning where the one before ended."""
    state = written(cells.mapInArrow(_walking(form, cell), _STATE_SQL), "walks")
    w = Window.partitionBy("path").orderBy("cell")  # one row a cell
    while True:
        seen = state.withColumns({"given": F.lag("end").over(w), "order": F.lag("ends").over(w)})
        wrong = seen.where("given >= 0 AND (start <> given OR begins <> order)").select("path", "cell", "given", "order")
        wrong = written(wrong, "wrong")
        if wrong.isEmpty():
            return state
        again = cells.join(wrong, ["path", "cell"]).mapInArrow(_walking(form, cell), _STATE_SQL)
        state = written(state.join(wrong, ["path", "cell"], "left_anti").select(*state.columns).unionByName(again), "walks")


def _reading(form, cell: int, times: bool, strict: bool):
    """Frames of the cells, or (``times``) only the time of each cell's first and last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                data, base, known = r["data"], r["cell"] * cell, []
                for x in r["before"]:
                    known = [] if x["kind"] == 0 else [*known, (x["link"], x["ticks"], x["offset"])]
                found, late, last = [], [], r.get("last_time")
                try:
                    for start, end, order, frame in _records(form, data, r["start"] - base, r["begins"], min(cell, r["size"] - base)):
                        if x := form.about(data, start, end, order):
                            known = [] if x[0] == 0 else [*known, x[1:]]
                        if frame:
                            time, content = form.value(data, start, end, order, known)
                            behind = time is not None and last is not None and time < last
                            if behind and strict:
                                raise ValueError(f"is out of order at frame {r['number'] + len(found)}")
                            last = last if time is None else time
                            found.append((time, content))
                            late.append(behind)
                except ValueError as e:
                    raise ValueError(f"{r['path']} {e}") from None
                clock = pa.float64() if form is Datagrams else pa.int64()
                if times:
                    all_ = [t for t, _ in found if t is not None]
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["cell"]], pa.int64()), pa.array(all_[-1:] or [None], clock)], names=["path", "cell", "newest"])
                elif found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array(range(r["number"], r["number"] + n), pa.int64()), pa.array([t for t, _ in found], clock), pa.array([d for _, d in found], pa.binary()), pa.array(late)], names=["path", "number", "time", "data", "late"])

    return run


def records(spark: SparkSession, path: str, form: str, strict: bool = False, cell: int = CELL, overlap: int = OVERLAP) -> DataFrame:
    """(path, number, time, data, late) of every record below ``path``; ``form`` is pcap, pcapng or datagrams.

    ``number`` counts a file's frames from 0. ``late``: older than the frame before it, in a file of any
    number of cells; ``strict`` raises at the first such frame of a cell instead. A cut file, an unknown format, a
    link that isn't Ethernet, and a record that goes on for more than ``overlap`` bytes behind its cell raise, naming the file. Time is in microseconds
    for captures (null for blocks without a clock), seconds for datagrams. A file without any byte has no rows
    and is no capture: ``pcap`` and ``pcapng`` raise.
    """
    if cell % 4 or overlap >= cell:
        raise ValueError("a cell must be a multiple of four bytes and hold more than its overlap")
    kind = FORMATS[form]
    cells = byte_cells(spark, path, cell, overlap)
    state = _agreed(cells, kind, cell)
    faults = state.where("error IS NOT NULL").select("path", "cell", "error")
    if form != "datagrams":
        bare = _listed(spark, path).join(state, "path", "left_anti").select("path", F.lit(-1).cast("long").alias("cell"), F.lit("is no capture file").alias("error"))
        faults = faults.unionByName(bare)
    faults = faults.orderBy("path", "cell").select("path", "error").limit(1).collect()
    if faults:
        raise ValueError(" ".join(faults[0]))
    w = Window.partitionBy("path").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    before = F.flatten(F.collect_list(F.when(F.size("about") > 0, F.col("about"))).over(w))  # a file's sections and interfaces
    plan = written(state.select("path", "cell", "start", "begins", F.coalesce(F.sum("frames").over(w), F.lit(0)).alias("number"), before.alias("before")), "plan")
    work = cells.join(plan, ["path", "cell"])
    clock = "double" if form == "datagrams" else "long"
    newest = work.mapInArrow(_reading(kind, cell, True, False), f"path string, cell long, newest {clock}")
    last = newest.select("path", "cell", F.last("newest", ignorenulls=True).over(w).alias("last_time"))
    return work.join(last, ["path", "cell"]).mapInArrow(_reading(kind, cell, False, strict), f"path string, number long, time {clock}, data binary, late boolean")
