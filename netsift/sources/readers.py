"""Readers with explicit schemas, header checks, binary captures and checksums."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import captures

FLOW_LABEL_SCHEMA = "start_epoch double, end_epoch double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, label int, attack_family string, offset long"
TIMELINE_SCHEMA = "verified boolean, source string, time_basis string, intervals array<struct<start: double, end: double, label: int, attack_family: string>>"


def check_header(columns: list[str], required: list[str]) -> None:
    if missing := [c for c in required if c not in columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def flow_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole flow file by an explicit schema; a malformed row raises when read, an empty file at once."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def projected_csv(spark: SparkSession, path: str, columns: list[str], optional: list[str] | None = None) -> DataFrame:
    """Only the named columns, as trimmed strings with blanks as null; the header is checked by name."""
    raw = spark.read.option("header", True).csv(path)
    check_header(raw.columns, columns)
    keep = [*columns, *[c for c in optional or [] if c in raw.columns]]
    return raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in keep])


def record_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Records between comment lines; a malformed row raises when read."""
    return spark.read.schema(schema).option("header", header).option("comment", "#").option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)


def flow_labels(spark: SparkSession, path: str) -> DataFrame:
    """Interval labels with a verdict for each row: valid, unjoinable (no ports) or what is wrong."""
    df = spark.read.schema(FLOW_LABEL_SCHEMA).option("header", True).csv(path)
    bad = F.when(F.col("start_epoch").isNull() | F.col("end_epoch").isNull() | (F.col("end_epoch") < F.col("start_epoch")), "interval").when(~F.col("label").isin(0, 1), "label").when(F.col("attack_family").isNull(), "family")
    port = lambda c: F.col(c).isNull() | ~F.col(c).between(0, 65535)
    return df.withColumn("verdict", F.coalesce(bad, F.when((F.lower("protocol") != "icmp") & (port("src_port") | port("dst_port")), "unjoinable"), F.lit("valid")))


def label_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of a JSON timeline; unverified files, unordered or overlapping intervals are marked in ``fault``."""
    from pyspark.sql import Window

    t = spark.read.schema(TIMELINE_SCHEMA).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    x = t.select("file", "verified", "time_basis", F.explode("intervals").alias("i")).select("file", "verified", "time_basis", "i.*")
    before = F.max("end").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fault = F.when(~F.coalesce("verified", F.lit(False)), "unverified").when(F.col("end") <= F.col("start"), "interval").when(F.col("start") < before, "overlap").when(~F.coalesce("label", F.lit(0)).isin(0, 1), "label")
    return x.withColumn("fault", fault)


def run_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every JSON below a folder; unreadable files stay as rows with their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.col("_metadata.file_path"))


def checksum_mismatches(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, expected, found) for files that differ from the manifest (name, sha256) or are on one side only."""
    f = captures.digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    return f.join(manifest.select("name", F.col("sha256").alias("expected")), "name", "full").where(~F.col("found").eqNullSafe(F.col("expected")))


def pcap(spark: SparkSession, path: str, form: str = "pcap", strict: bool = False, **cells: int) -> DataFrame:
    """(path, number, epoch_us, frame, late) of capture files of any size, ``form`` pcap or pcapng; see ``captures.records``."""
    d = captures.records(spark, path, form, strict, **cells)
    return d.select("path", "number", F.col("time").alias("epoch_us"), F.col("data").alias("frame"), "late")


def datagram_log(spark: SparkSession, path: str, strict: bool = False, **cells: int) -> DataFrame:
    """(path, number, epoch, payload, late) of length-prefixed logs of any size; a cut log raises."""
    d = captures.records(spark, path, "datagrams", strict, **cells)
    return d.select("path", "number", F.col("time").alias("epoch"), F.col("data").alias("payload"), "late")


def _samples(data: bytes) -> tuple[dict, list[tuple[int, int, int, int, bytes]]]:
    """Head and (rate, drops, frame length, header protocol, header bytes) of an sFlow version 5 datagram."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from("!" + form, data, at)
        at += struct.calcsize("!" + form)
        return out

    version, family = take("II")
    if version != 5 or family not in (1, 2):
        raise ValueError("not an sFlow version 5 datagram")
    agent = data[at : at + (4 if family == 1 else 16)]
    at += len(agent)
    _, sequence, uptime, number = take("4I")
    found = []
    for _ in range(number):
        kind, size = take("II")
        end = at + size
        if end > len(data):
            raise ValueError("the datagram is cut")
        if kind in (1, 3):  # flow sample, compact or expanded
            if kind == 1:
                _, _, rate, _, drops, _, _, records = take("8I")
            else:
                _, _, _, rate, _, drops, _, _, _, _, records = take("11I")
            if rate < 1:
                raise ValueError("the sampling rate is not positive")
            for _ in range(records):
                form, length = take("II")
                stop = at + length
                if stop > end:
                    raise ValueError("a record is cut")
                if form == 1:  # raw header
                    protocol, frame, _, held = take("4I")
                    if at + held > stop:
                        raise ValueError("a header is cut")
                    found.append((rate, drops, frame, protocol, data[at : at + held]))
                at = stop
        at = end
    return {"agent": agent.hex(), "sequence": sequence, "uptime": uptime}, found


def _explode_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["datagram", "agent", "sequence", "uptime", "rate", "drops", "frame_length", "link", "header", "error"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    for b in batches:
        rows = []
        for i, p in zip(b.column("datagram").to_pylist(), b.column("payload").to_pylist()):
            try:
                head, found = _samples(p or b"")
                rows += [(i, head["agent"], head["sequence"], head["uptime"], *f, None) for f in found]
            except (ValueError, struct.error) as e:
                rows.append((i, *[None] * 8, str(e)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def sflow_samples(datagrams: DataFrame) -> DataFrame:
    """One row for each sampled header of (datagram, payload), of any header protocol (``link``); a malformed datagram is a row with its error."""
    return datagrams.select(F.col("datagram").cast("long").alias("datagram"), "payload").mapInArrow(
        _explode_samples, "datagram long, agent string, sequence long, uptime long, rate long, drops long, frame_length long, link long, header binary, error string"
    )


def _number(data: Column, at: Column | int, size: int) -> Column:
    """Unsigned big-endian number at a 0-based byte offset."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    return F.conv(F.hex(F.substring(data, start, F.lit(size))), 16, 10).cast("long")


def decode_header(frame: Column, link: Column | None = None) -> dict[str, Column]:
    """Columns of a sampled frame: ethertype behind its VLAN tags, protocol, SYN, addresses, ports.

    ``link`` is the header protocol of the sample: 1 Ethernet (also without ``link``), 11 bare IPv4, 12
    bare IPv6. Tags of both kinds may be stacked. What can't be read has no protocol, address or port:
    other links and ethertypes, cut headers, an IPv4 version or header length that is none, and IPv6 with
    extension headers. Fragments after the first and frames that are cut have no ports.
    """
    link = F.lit(1) if link is None else link
    behind = F.hex(F.substring(frame, F.lit(13), F.length(frame)))
    tags = (F.length(F.regexp_extract(behind, "^((?:(?:8100|88A8)[0-9A-F]{4})*)", 1)) / 8).cast("int")
    wired = link == 1
    base = F.when(wired, 14 + 4 * tags).otherwise(0)
    kind = F.when(wired & (F.length(frame) >= base), _number(frame, 12 + 4 * tags, 2)).when(link == 11, 0x0800).when(link == 12, 0x86DD)
    v4, v6 = kind == 0x0800, kind == 0x86DD
    first = F.when(F.length(frame) > base, _number(frame, base, 1))
    head = F.when(v4, F.pmod(first, F.lit(16)) * 4).when(v6, F.lit(40)).cast("int")
    whole4 = v4 & (F.length(frame) >= base + 20) & (F.shiftright(first, 4) == 4) & (head >= 20) & (F.length(frame) >= base + head)
    whole6 = v6 & (F.length(frame) >= base + 40) & F.when(F.length(frame) >= base + 40, _number(frame, base + 6, 1)).isin(6, 17, 58)
    proto = F.when(whole4, _number(frame, base + 9, 1)).when(whole6, _number(frame, base + 6, 1))
    later = F.coalesce(whole4 & (F.pmod(_number(frame, base + 6, 2), F.lit(8192)) > 0), F.lit(False))
    at = base + head
    ports = proto.isin(6, 17) & ~later & (F.length(frame) >= at + 4)
    syn = (proto == 6) & ~later & (F.length(frame) >= at + 14) & (_number(frame, at + 13, 1).bitwiseAND(2) > 0)
    part = lambda o, n: F.hex(F.substring(frame, base + o + 1, F.lit(n)))
    return {
        "ethertype": kind, "protocol": proto, "fragment": later, "syn": F.coalesce(syn, F.lit(False)),
        "src": F.when(whole4, part(12, 4)).when(whole6, part(8, 16)), "dst": F.when(whole4, part(16, 4)).when(whole6, part(24, 16)),
        "src_port": F.when(ports, _number(frame, at, 2)), "dst_port": F.when(ports, _number(frame, at + 2, 2)),
    }
