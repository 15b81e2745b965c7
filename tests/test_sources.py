"""Readers of binary files and faulty inputs."""

from __future__ import annotations

import struct

import pytest

from netsift.sources import readers


def capture(frames, magic=b"\xd4\xc3\xb2\xa1", link=1):
    out = magic + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, link)
    for t, f in frames:
        out += struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(f), len(f)) + f
    return out


def test_pcap(spark, tmp_path):
    frames = [(1_000_000 + i, bytes([i]) * (i + 1)) for i in range(5)]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    got = readers.pcap(spark, f"file://{tmp_path}/a.pcap").orderBy("number").collect()
    assert [(r.epoch_us, bytes(r.frame)) for r in got] == frames
    (tmp_path / "b.pcap").write_bytes(capture(frames)[:-1])
    with pytest.raises(Exception, match="is cut"):
        readers.pcap(spark, f"file://{tmp_path}/b.pcap").collect()
    (tmp_path / "c.pcap").write_bytes(capture(frames, link=101))
    with pytest.raises(Exception, match="not Ethernet"):
        readers.pcap(spark, f"file://{tmp_path}/c.pcap").collect()


def test_datagram_log(spark, tmp_path):
    logged = [(1.5, b"abc"), (2.25, b""), (3.0, b"x" * 100)]
    (tmp_path / "d.log").write_bytes(b"".join(struct.pack("!dI", t, len(p)) + p for t, p in logged))
    got = readers.datagram_log(spark, f"file://{tmp_path}/d.log").orderBy("epoch").collect()
    assert [(r.epoch, bytes(r.payload)) for r in got] == logged
    (tmp_path / "e.log").write_bytes(b"\0" * 5)
    with pytest.raises(Exception, match="is cut"):
        readers.datagram_log(spark, f"file://{tmp_path}/e.log").collect()


def frame(kind, payload, tags=b""):
    return b"\0" * 12 + tags + struct.pack("!H", kind) + payload


def ipv4(first=0x45, proto=17, options=b"", fragment=0):
    return struct.pack("!BBHHHBBH4s4s", first, 0, 40, 0, fragment, 64, proto, 0, b"\x0a\0\0\1", b"\x0a\0\0\2") + options + struct.pack("!HH", 53, 99) + b"\0" * 16


def test_headers_that_are_read_and_those_that_are_not(spark):
    from pyspark.sql import functions as F

    v6 = lambda nxt: struct.pack("!IHBB", 6 << 28, 8, nxt, 64) + b"\1" * 32 + struct.pack("!HH", 53, 99) + b"\0" * 16
    single, service = b"\x81\0\0\5", b"\x88\xa8\0\7"
    cases = [
        (1, frame(0x0800, ipv4()), 17, 53), (1, frame(0x0800, ipv4(), single), 17, 53), (1, frame(0x0800, ipv4(), service), 17, 53), (1, frame(0x0800, ipv4(), service + single), 17, 53), (1, frame(0x0800, ipv4(), single * 5), 17, 53),
        (1, frame(0x0800, ipv4(0x46, options=b"\0" * 4)), 17, 53), (1, frame(0x0800, ipv4(0x42)), None, None), (1, frame(0x0800, ipv4(0x65)), None, None), (1, frame(0x0800, ipv4()[:19]), None, None), (1, frame(0x0800, ipv4(0x4F)[:30]), None, None),
        (1, frame(0x0800, ipv4(fragment=5)), 17, None), (1, frame(0x86DD, v6(17)), 17, 53), (1, frame(0x86DD, v6(58)), 58, None), (1, frame(0x86DD, v6(0)), None, None), (1, frame(0x86DD, v6(44)), None, None), (1, frame(0x0806, b"\0" * 40), None, None),
        (1, frame(0x0800, b"", single)[:16], None, None), (1, b"", None, None), (1, b"\0" * 13, None, None), (11, ipv4(), 17, 53), (12, v6(6), 6, 53), (7, ipv4(), None, None), (1, None, None, None),
    ]
    d = spark.createDataFrame([(i, link, bytearray(f) if f is not None else None) for i, (link, f, _, _) in enumerate(cases)], "i int, link long, f binary")
    c = readers.decode_header(F.col("f"), F.col("link"))
    got = {r.i: (r.p, r.s) for r in d.select("i", c["protocol"].alias("p"), c["src_port"].alias("s")).collect()}
    assert got == {i: (p, s) for i, (_, _, p, s) in enumerate(cases)}


def test_samples_of_other_links_and_of_no_rate(spark):
    def datagram(rate, link):
        raw = struct.pack("!4I", link, 100, 4, 4) + b"\x45\0\0\0"
        sample = struct.pack("!8I", 1, 1, rate, 0, 0, 0, 0, 1) + struct.pack("!2I", 1, len(raw)) + raw
        return struct.pack("!2I4s4I", 5, 1, b"\x0a\0\0\1", 0, 7, 9, 1) + struct.pack("!2I", 1, len(sample)) + sample

    d = spark.createDataFrame([(i, bytearray(datagram(r, k))) for i, (r, k) in enumerate([(64, 1), (64, 11), (1, 12), (0, 1)])], "datagram long, payload binary")
    got = {r.datagram: (r.rate, r.link, r.error is not None) for r in readers.sflow_samples(d).collect()}
    assert got == {0: (64, 1, False), 1: (64, 11, False), 2: (1, 12, False), 3: (None, None, True)}


def test_headers_and_empty_files(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns: b"):
        readers.check_header(["a"], ["a", "b"])
    (tmp_path / "f.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.flow_csv(spark, f"file://{tmp_path}/f.csv", "a int, b int")
    (tmp_path / "g.csv").write_text("a,b\n1,x\n")
    with pytest.raises(Exception):
        readers.flow_csv(spark, f"file://{tmp_path}/g.csv", "a int, b int").collect()
