"""Undirected tuples and the one-to-one join of two sources."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from netsift.operators import reconcile

FLOWS = "proto string, src string, dst string, sport int, dport int, label string, family string"
ARGS = ("proto", "src", "dst", "sport", "dport", "label", "family")


def test_tuples_in_either_direction(spark):
    rows = [
        ("TCP ", "a", "b", 1, 2, "Benign", "Benign"), ("tcp", "b", "a", 2, 1, "Malicious", "SYNFlood"), ("tcp", "b", "a", 1, 2, "Benign", "Benign"), ("udp", "a", "a", 9, 1, "Benign", "Benign"), ("udp", "a", "a", 1, 9, " Benign", "Benign "),
        ("icmp", "a", "b", 7, 8, "Malicious", "ICMPFlood"), ("icmp", "b", "a", None, None, "Malicious", "ICMPFlood"), ("icmp", "b", "a", 1, 1, None, "ICMPFlood"), ("tcp", "a", "b", None, 2, "Benign", "Benign"), ("arp", "a", "b", 1, 2, "Benign", "Benign"), (None, "a", "b", 1, 2, "Benign", "Benign"), ("udp", None, "b", 1, 2, "Benign", "Benign"),
    ]
    d = spark.createDataFrame(rows, FLOWS)
    got = {(r.kind, r.reason): r.n for r in reconcile.tuple_report(d, *ARGS).collect()}
    assert got == {("tuples", "tcp"): 2, ("ambiguous", "tcp"): 1, ("tuples", "udp"): 1, ("tuples", "icmp"): 1, ("ambiguous", "icmp"): 1, ("unjoined", "tcp:unknown_port"): 1, ("unjoined", "arp"): 1, ("unjoined", "no protocol"): 1, ("unjoined", "udp:unknown_address"): 1}
    t = {(r.tuple.proto, r.tuple.low.address, r.tuple.low.port): r for r in reconcile.labelled_tuples(d, *ARGS).collect()}
    assert t["udp", "a", 1].n == 2 and not t["udp", "a", 1].ambiguous and t["tcp", "a", 1].n == 2 and t["icmp", "a", None].n == 3
    assert reconcile.tuple_report(d.where("false"), *ARGS).collect() == []


RECORDS = "k long, src string, bytes long, dur double, start_us long, end_us long"
LABELS = "k long, src string, bytes long, dur double, shown string, label string, family string"


def record(k, src="a", size=10, dur=1.0, start=65_500_000, end=66_000_000):
    return (k, src, size, dur, start, end)


def label(k, src="a", size=10, dur=1.0, shown="1:05.5", verdict="Benign", family="Benign"):
    return (k, src, size, dur, shown, verdict, family)


def test_contradictions_and_the_strict_join(spark):
    records = [record(1), record(2, size=11), record(3, dur=1.1), record(4, start=99_000_000), record(5), record(5), record(6), record(8, end=1), record(9, end=None), record(10, src=" a "), record(11, src=None), record(12), record(None), record(13, dur=1.000001)]
    labels = [label(k) for k in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 13, 7, None)] + [label(12, verdict="Malicious", family="Benign")]
    a, b = spark.createDataFrame(records, RECORDS), spark.createDataFrame(labels, LABELS)
    kinds = lambda x, y: reconcile.contradictions(x, y, "k", ["src", "bytes"], ["dur"], {"start_us": "shown"}, ("start_us", "end_us"), "label", "family")
    found = kinds(a, b)
    got = sorted((r.k, r.kind, r.field or "") for r in found.collect())
    assert got == [(2, "field", "bytes"), (3, "duration", "dur"), (4, "interval", "end_us"), (4, "time", "start_us"), (5, "repeated_record", ""), (6, "missing_label", ""), (7, "missing_record", ""), (7, "repeated_label", ""), (8, "interval", "end_us"), (9, "interval", "end_us"), (11, "field", "src"), (12, "label", "label")]
    one = found.where("k = 2").collect()[0]
    assert (one.record, one.label) == ("11", "10")
    assert sorted(r.k for r in reconcile.labelled(a, b, "k", "label", "family", found, strict=False).collect()) == [1, 10, 13]
    with pytest.raises(Exception, match="12 contradictions, one of them: 11 field src"):
        reconcile.labelled(a, b, "k", "label", "family", found).collect()
    good = spark.createDataFrame([label(1, verdict="Malicious", family=" UDPFlood"), label(10)], LABELS)
    few = a.where(F.col("k").isin(1, 10))
    assert sorted((r.k, r.label, r.attack_family) for r in reconcile.labelled(few, good, "k", "label", "family", kinds(few, good)).collect()) == [(1, 1, "UDPFlood"), (10, 0, "Benign")]
    assert kinds(a.where("false"), b.where("false")).collect() == []
