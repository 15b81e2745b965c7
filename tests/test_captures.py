"""Binary files of many cells: every byte order and clock, wrong guesses, cuts, disorder."""

from __future__ import annotations

import hashlib
import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from netsift.sources import captures, readers

SMALL = {"cell": 16_384, "overlap": 4096}


def pcap(n, order="<", unit=1, rng=None, inner=b""):
    magic = {("<", 1): b"\xd4\xc3\xb2\xa1", (">", 1): b"\xa1\xb2\xc3\xd4", ("<", 1000): b"\x4d\x3c\xb2\xa1", (">", 1000): b"\xa1\xb2\x3c\x4d"}[order, unit]
    out, rows = [magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)], []
    for i in range(n):
        t, d = 1_700_000_000_000_000 + i * 777, inner or rng.randbytes(rng.choice([20, 60, 300, 1500]))
        out.append(struct.pack(order + "4I", t // 10**6, (t % 10**6) * unit, len(d), len(d)) + d)
        rows.append((t, d))
    return b"".join(out), rows


def pcapng(n, order, rng):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))

    option = lambda code, x: struct.pack(order + "HH", code, len(x)) + x + b"\0" * (-len(x) % 4)
    out, rows = [], []
    for section in range(2):
        out.append(block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)))
        out.append(block(1, struct.pack(order + "HHI", 1, 0, 0)))
        out.append(block(1, struct.pack(order + "HHI", 1, 0, 0) + option(9, bytes([9])) + option(14, struct.pack(order + "q", 100)) + option(0, b"")))
        for i in range(n):
            t, d = 1_700_000_000_000_000 + (section * n + i) * 777, rng.randbytes(rng.choice([20, 61, 300, 1500]))
            ticks = t if i % 2 == 0 else (t - 100_000_000) * 1000
            out.append(block(6, struct.pack(order + "5I", i % 2, ticks >> 32, ticks & 0xFFFFFFFF, len(d), len(d)) + d))
            rows.append((t, d))
            if i % 50 == 0:
                out.append(block(3, struct.pack(order + "I", 33) + b"x" * 33))
                rows.append((None, b"x" * 33))
            if i % 70 == 0:
                out.append(block(5, b"statistics"))
    return b"".join(out), rows


def log(n, rng):
    rows = [(1.7e9 + i / 4, rng.randbytes(rng.choice([0, 8, 200, 1400]))) for i in range(n)]
    return b"".join(struct.pack(">dI", t, len(d)) + d for t, d in rows), rows


@pytest.fixture()
def cut(spark):
    """Files are read in small ranges."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def read(spark, path, form, **more):
    got = captures.records(spark, f"file://{path}", form, **(SMALL | more)).orderBy("path", "number").collect()
    return [(r.time, bytes(r.data)) for r in got], [r.number for r in got], [r.number for r in got if r.late]


CASES = {
    "little": ("pcap", lambda r: pcap(900, rng=r)), "big": ("pcap", lambda r: pcap(900, ">", rng=r)), "nano": ("pcap", lambda r: pcap(900, "<", 1000, r)), "blocks": ("pcapng", lambda r: pcapng(400, "<", r)),
    "big blocks": ("pcapng", lambda r: pcapng(400, ">", r)), "log": ("datagrams", lambda r: log(1200, r)),
}


@pytest.mark.parametrize("name", CASES)
def test_files_of_many_cells(spark, tmp_path, cut, name):
    form, make = CASES[name]
    data, rows = make(random.Random(name))
    (tmp_path / "f").write_bytes(data)
    assert len(data) > 15 * SMALL["cell"]
    assert read(spark, tmp_path / "f", form, strict=True) == (rows, list(range(len(rows))), [])


def test_guesses_that_are_wrong_are_walked_again(spark, tmp_path, cut):
    """Frames that hold whole captures of tiny frames: inside them heads are plausible, yet none is a record."""
    inner = pcap(60, inner=b"\x01\x02\x03\x04")[0]
    data, rows = pcap(150, inner=inner + b"\0" * 3)
    guess = captures._guess(captures.Pcap, data[16_384 : 16_384 + 20_480], False)
    starts = {24 + i * (16 + len(inner) + 3) - 16_384 for i in range(151)}
    assert guess and guess[0] not in starts
    (tmp_path / "f").write_bytes(data)
    assert read(spark, tmp_path / "f", "pcap", strict=True)[0] == rows


def test_late_frames_across_cells(spark, tmp_path, cut):
    data, rows = pcap(900, rng=random.Random(2))
    starts, at = [], 24
    for _, d in rows:
        starts.append(at)
        at += 16 + len(d)
    seam = next(i for i, s in enumerate(starts) if s >= 2 * SMALL["cell"])  # the first frame of a cell
    data = bytearray(data)
    for i in (seam, 500):
        struct.pack_into("<I", data, starts[i], 1_600_000_000)
    (tmp_path / "f").write_bytes(data)
    assert read(spark, tmp_path / "f", "pcap")[2] == [seam, 500]
    with pytest.raises(Exception, match="out of order at frame"):
        read(spark, tmp_path / "f", "pcap", strict=True)


def test_faults(spark, tmp_path, cut):
    data, _ = pcap(300, rng=random.Random(3))
    blocks, _ = pcapng(100, "<", random.Random(3))
    broken = bytearray(blocks)
    broken[len(blocks) // 2 : len(blocks) // 2 + 2000] = b"\xff" * 2000
    cases = [
        ("pcap", data[:-5], "is cut"), ("pcap", data[:-1490], "is cut"), ("pcap", b"none", "no capture file"), ("pcap", b"", "no capture file"), ("pcapng", data, "no capture file"), ("pcapng", blocks[:-2], "is cut"), ("pcapng", bytes(broken), "f"), ("datagrams", b"\0" * 5, "is cut"),
        ("pcap", data[:24] + struct.pack("<4I", 1, 0, 30_000, 30_000) + b"\0" * 30_000 + data[24:], "too long"),
    ]
    for i, (form, content, message) in enumerate(cases):
        (tmp_path / f"f{i}").write_bytes(content)
        with pytest.raises(Exception, match=message):
            read(spark, tmp_path / f"f{i}", form)
    (tmp_path / "none").write_bytes(b"")
    assert read(spark, tmp_path / "none", "datagrams") == ([], [], [])
    (tmp_path / "head").write_bytes(data[:24])
    assert read(spark, tmp_path / "head", "pcap") == ([], [], [])


def test_digests(spark, tmp_path, cut):
    rng = random.Random(4)
    for i, content in enumerate([b"", b"\n", b"a\n\n", b"\r\n\r", rng.randbytes(400_000), rng.randbytes(3) + b"\n" * 200_000, b"\0" * 300_000]):
        (tmp_path / f"f{i}").write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in captures.digests(spark, f"file://{tmp_path}").collect()}
    assert got == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    listed = [(n, "0" if n == "f4" else h) for n, h in got.items() if n != "f2"] + [("gone", "1")]
    bad = readers.checksum_mismatches(spark, f"file://{tmp_path}", spark.createDataFrame(listed, "name string, sha256 string")).collect()
    assert sorted((r.name, r.expected is None, r.found is None) for r in bad) == [("f2", True, False), ("f4", False, False), ("gone", False, True)]


@pytest.mark.parametrize("name", ["src_pcap_job", "src_pcapng_job"])
def test_jobs_beyond_a_long_and_with_times_that_go_back(spark, tmp_path, name):
    """6,000 packets of one key, the later half begins again at the first time: captures are in time order, sums exact."""
    from netsift.plans.registry import QUERIES

    n, first = 6000, 1_704_067_200_000_000
    at = F.timestamp_micros(F.lit(first) + F.col("id") % (n // 2))
    e = spark.range(n).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(7).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(f"file://{tmp_path}/events.parquet")
    (r,) = QUERIES[name](spark, f"file://{tmp_path}").collect()
    assert (r.path, r.frames, r.id_sum, r.out_of_order) == ("capture-7-0", n, n * (n - 1) // 2, 0)
    assert int(r.time_sum) == sum(first + i % (n // 2) for i in range(n)) > 2**63


@pytest.fixture()
def late_broadcast(spark):
    """Joins are planned with shuffles and broadcast a small side once its size is known, so the other may be read without its keys."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, x in conf.items():
        spark.conf.set(k, x)
    yield
    for k in conf:
        spark.conf.unset(k)


def _events(spark, path, ids):
    """A file of events for each range of ids, of two users, a microsecond apart."""
    for lo, hi in ids:
        at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id"))
        e = spark.range(lo, hi).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        e.coalesce(1).write.mode("append").parquet(f"file://{path}/events.parquet")


@pytest.mark.parametrize("name", ["src_pcap_job", "src_pcapng_job"])
def test_jobs_whose_captures_come_from_several_files(spark, tmp_path, late_broadcast, name):
    from netsift.plans.registry import QUERIES

    _events(spark, tmp_path, [(i * 100, i * 100 + 100) for i in range(4)])
    rows = QUERIES[name](spark, f"file://{tmp_path}").orderBy("path").collect()
    assert [(r.path, r.frames, r.id_sum, r.out_of_order) for r in rows] == [(f"capture-{k}-0", 200, sum(range(k, 400, 2)), 0) for k in (0, 1)]


@pytest.mark.parametrize("name", ["src_pcap_job", "src_pcapng_job"])
def test_jobs_on_packets_that_come_twice(spark, tmp_path, name):
    """Packets with the first time and number of their capture come twice, its head once."""
    from netsift.plans.registry import QUERIES

    _events(spark, tmp_path, [(0, 100)] * 2)
    rows = QUERIES[name](spark, f"file://{tmp_path}").orderBy("path").collect()
    assert [(r.path, r.frames, r.id_sum, r.out_of_order) for r in rows] == [(f"capture-{k}-0", 100, 2 * sum(range(k, 100, 2)), 0) for k in (0, 1)]


@pytest.mark.parametrize("end", ["\n", "`\x00\x00\x00"])
def test_binary_files_are_not_dealt_to_several_tasks(spark, tmp_path, late_broadcast, end):
    """A key's records of four input files lie in one file, in order, behind one head."""
    from netsift.plans.sources import _binary_files

    tail = F.unhex(F.lit(end.encode().hex()))
    for i in range(4):
        d = spark.range(i * 100, i * 100 + 100).select((F.col("id") % 3).alias("flow_key"), (999 - F.col("id")).alias("packet_id"), F.unhex(F.lit("ff00")).alias("head"))
        d.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    d = spark.read.parquet(f"file://{tmp_path}/in").withColumn("record", F.concat(F.lpad(F.col("packet_id").cast("string"), 4, "0").cast("binary"), tail))
    root = _binary_files(d, "made", end, ["packet_id"])
    for k in range(3):
        (f,) = Path(root.removeprefix("file:"), f"flow_key={k}", "part=0").glob("*.txt")
        assert f.read_bytes() == b"\xff\x00" + b"".join(b"%04d" % p + end.encode() for p in sorted(999 - i for i in range(400) if i % 3 == k))
