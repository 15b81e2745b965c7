"""Files written from the views in the shared folder and read back by the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators import entropy, ordering, preparation
from netsift.sources import captures, readers
from netsift.sources.shared import shared_path, written
from netsift.sources.views import Views

from .base import query
from .entropy import SPINE
from .prepare import _PARTS, _PREPARED, part_averages, prepared


def _csv(df: DataFrame, tag: str, **options: object) -> str:
    path = shared_path(df.sparkSession, tag)
    df.write.options(header=True, **options).csv(path)
    return path


@query("src_flow_csv", "flows", "SELECT pos, src_addr, dport, proto, tot_bytes, dur, label FROM flows")
def src_flow_csv(v: Views) -> DataFrame:
    d = v.flows.select("pos", "src_addr", "dport", "proto", "tot_bytes", "dur", "label")
    return readers.flow_csv(v.spark, _csv(d, "flows"), "pos long, src_addr string, dport string, proto string, tot_bytes long, dur double, label string")


@query("src_flow_csv_projected", "flows", "SELECT CAST(pos AS VARCHAR) AS pos, CASE WHEN pos % 3 <> 0 THEN dport END AS dport FROM flows")
def src_flow_csv_projected(v: Views) -> DataFrame:
    d = v.flows.select("pos", "proto", F.when(F.col("pos") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "dport")).alias("dport"))
    path = _csv(d, "projected", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.projected_csv(v.spark, path, ["pos", "dport"], ["absent"])


@query("src_header_check", "flows", "SELECT 'missing columns: nothing_here' AS message, count(*) AS n_rows FROM flows")
def src_header_check(v: Views) -> DataFrame:
    try:
        readers.check_header(v.flows.columns, ["pos", "nothing_here"])
        message = ""
    except ValueError as e:
        message = str(e)
    return v.flows.agg(F.lit(message).alias("message"), F.count(F.lit(1)).alias("n_rows"))


@query("src_record_csv", "flows", "SELECT proto, count(*) AS n, CAST(sum(tot_bytes) AS BIGINT) AS bytes FROM flows WHERE pos % 10 <> 0 GROUP BY proto")
def src_record_csv(v: Views) -> DataFrame:
    line = F.concat_ws(",", F.concat(F.when(F.col("pos") % 10 == 0, "#").otherwise(""), F.col("pos").cast("string")), "proto", F.col("tot_bytes").cast("string"))
    path = shared_path(v.spark, "records")
    v.flows.select(line.alias("value")).write.text(path)
    r = readers.record_csv(v.spark, path, "pos long, proto string, tot_bytes long", header=False)
    return r.groupBy("proto").agg(F.count(F.lit(1)).alias("n"), F.sum("tot_bytes").alias("bytes"))


@query("src_flow_labels", "flow_labels", "SELECT CASE WHEN flow_key % 10 = 1 THEN 'interval' WHEN flow_key % 10 = 2 THEN 'label' WHEN flow_key % 10 = 3 THEN 'unjoinable' ELSE 'valid' END AS verdict, count(*) AS n FROM flow_labels GROUP BY 1")
def src_flow_labels(v: Views) -> DataFrame:
    k = F.col("flow_key") % 10
    d = v.flow_labels.select(
        (F.col("start_us") / 1e6).alias("start_epoch"), ((F.when(k == 1, F.col("start_us") - 1_000_000).otherwise(F.col("end_us"))) / 1e6).alias("end_epoch"), F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"),
        F.when(k == 3, F.lit(None)).otherwise(80).cast("int").alias("src_port"), F.lit(443).alias("dst_port"), F.lit("tcp").alias("protocol"), F.when(k == 2, 7).otherwise(F.col("label")).alias("label"), F.col("family").alias("attack_family"), F.col("flow_key").alias("offset"),
    )
    return readers.flow_labels(v.spark, _csv(d, "labels")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


_TL = """, t AS (SELECT flow_key, start_us, end_us, label, max(end_us) OVER (PARTITION BY flow_key ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM flow_labels)
SELECT flow_key % 2 = 0 AS verified, count(*) FILTER (WHERE flow_key % 2 = 1) AS unverified, count(*) FILTER (WHERE flow_key % 2 = 0 AND start_us < p) AS overlaps, count(*) AS n FROM t GROUP BY 1"""


@query("src_label_timeline", "flow_labels", _TL)
def src_label_timeline(v: Views) -> DataFrame:
    """One JSON file for each key: intervals of a key overlap where its labels do."""
    one = F.struct((F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"), "label", F.col("family").alias("attack_family"))
    g = v.flow_labels.groupBy("flow_key").agg(F.collect_list(one).alias("intervals"))
    path = shared_path(v.spark, "timeline")
    g.select((F.col("flow_key") % 2 == 0).alias("verified"), F.lit("made").alias("source"), F.lit("epoch").alias("time_basis"), "intervals", "flow_key").write.partitionBy("flow_key").json(path)
    t = readers.label_timeline(v.spark, path)
    return t.groupBy("verified").agg(F.count_if(F.col("fault") == "unverified").alias("unverified"), F.count_if(F.col("fault") == "overlap").alias("overlaps"), F.count(F.lit(1)).alias("n"))


@query("src_run_summaries", "trials", "SELECT scenario, count(*) AS runs, CAST(sum(n) AS BIGINT) AS n_rows, 0 AS unreadable FROM trials GROUP BY scenario")
def src_run_summaries(v: Views) -> DataFrame:
    path = shared_path(v.spark, "runs")
    v.trials.repartition("trial_id", "sampling_rate", "scenario").write.partitionBy("sampling_rate").option("maxRecordsPerFile", 1).json(path)
    r = readers.run_summaries(v.spark, path, "scenario string, trial_id long, n long")
    return r.groupBy("scenario").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("n_rows"), F.count_if(F.col("_corrupt").isNotNull()).alias("unreadable"))


@query("src_checksum_manifest", "", "SELECT 'changed' AS kind, 1 AS n UNION ALL SELECT 'missing', 1")
def src_checksum_manifest(v: Views) -> DataFrame:
    """A manifest of the files of orders in which one digest is wrong and one name has no file."""
    path = shared_path(v.spark, "checksums")
    v.table("orders").repartition(4, "o_orderkey").write.parquet(path)
    files = captures.digests(v.spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    one = files.agg(F.min("name").alias("_first"))  # one row
    m = files.crossJoin(F.broadcast(one)).select("name", F.when(F.col("name") == F.col("_first"), "0").otherwise(F.col("sha256")).alias("sha256"))
    m = m.unionByName(one.select(F.lit("gone.parquet").alias("name"), F.lit("1").alias("sha256")))
    bad = readers.checksum_mismatches(v.spark, path, m)
    return bad.groupBy(F.when(F.col("found").isNull(), "missing").otherwise("changed").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_windows", "flows", "SELECT session_id, count(*) AS windows FROM sp GROUP BY session_id", SPINE)
def sink_windows(v: Views) -> DataFrame:
    path = shared_path(v.spark, "windows")
    entropy.window_spine(v.once("sessions", lambda: ordering.sessions(v.flows)), 100, 50).write.partitionBy("session_id").parquet(path)
    return v.spark.read.parquet(path).groupBy(F.col("session_id").cast("long").alias("session_id")).agg(F.count(F.lit(1)).alias("windows"))


@query("sink_split_matrices", "flows", f"SELECT split, {_PARTS}, 0 AS differing FROM pp GROUP BY split", _PREPARED)
def sink_split_matrices(v: Views) -> DataFrame:
    """Saved with model and manifest and loaded; the raw rows through the loaded model give the saved rows again."""
    path = shared_path(v.spark, "prepared")
    prepared(v).save(path)
    p = preparation.Prepared.load(v.spark, path)
    raw = v.flows.select("pos", F.col("tot_bytes").cast("double").alias("a"), F.col("dur").alias("b"), F.col("dport").cast("double").alias("c"), "proto")
    again = p.model.transform(raw).select("pos", F.struct(*p.model.features).alias("again"))
    d = p.rows.join(again, "pos")
    return part_averages(d, p.model, F.count_if(~F.struct(*p.model.features).eqNullSafe(F.col("again"))).alias("differing"))


@query("sink_prediction_log", "predictions", """SELECT run_id, count(*) AS n, CAST(sum(idx) AS BIGINT) AS id_sum, count(*) AS resource_rows, min(observed_us) AS first_us, max(observed_us) AS last_us, max(available_us - observed_us) AS max_lag_us, count(*) FILTER (WHERE y_true IS NOT NULL AND (score >= 0.5) <> (y_true = 1)) AS errors FROM predictions GROUP BY run_id""")
def sink_prediction_log(v: Views) -> DataFrame:
    """Predictions, resources and errors of a stream in three tables."""
    from netsift.streaming import sinks, windows

    s = windows.table_stream(v.spark, v.sf_dir, "events")
    us, cents = F.unix_micros(F.col("ts").cast("timestamp")), F.round(F.col("value") * 100).cast("long")
    score = F.least(F.floor((cents * 3 + F.col("event_id") % 40 * 100) / 300), F.lit(100)).cast("double") / 100
    truth = F.when(F.col("event_id") % 11 != 0, (F.col("value") > 30).cast("int"))
    rows = s.select((F.col("user_id") % 3).alias("run_id"), F.col("event_id").alias("idx"), us.alias("observed_us"), (us + F.col("event_id") % 4 * 300_000_000).alias("done_us"), truth.alias("y_true"), score.alias("score"))
    wrong = F.col("y_true").isNotNull() & ((F.col("score") >= 0.5) != (F.col("y_true") == 1))
    tables = {"predictions": lambda b: b, "resources": lambda b: sinks.resources(b, "run_id", "observed_us", "done_us"), "errors": lambda b: b.where(wrong).select("run_id", "idx")}
    path = shared_path(v.spark, "log")
    sinks.logged(rows, path, tables).awaitTermination()
    read = lambda table, schema: sinks.read_log(v.spark, path, table, schema)
    p = read("predictions", "idx long, observed_us long, done_us long, y_true int, score double").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("id_sum"))
    r = read("resources", "n long, first_us long, last_us long, lag_sum_us long, max_lag_us long").groupBy("run_id").agg(F.sum("n").alias("resource_rows"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("max_lag_us").alias("max_lag_us"))
    e = read("errors", "idx long").groupBy("run_id").agg(F.count(F.lit(1)).alias("errors"))
    return p.join(r, "run_id").join(e, "run_id", "left").na.fill(0, ["errors"])


def _be(c: Column, n: int) -> Column:
    """A number as ``n`` bytes, highest first."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))


def _le(c: Column) -> Column:
    """A number as four bytes, lowest first."""
    return F.concat(*[_be(F.pmod(F.shiftright(c.cast("long"), 8 * i), F.lit(256)), 1) for i in range(4)])


def _binary_files(records: DataFrame, tag: str, end: str, order: list[str]) -> str:
    """A file for each key and million packet numbers: the head before its first record, then records in the order of ``order``.

    Each of ``record`` ends with the bytes ``end``, which Spark's text writer puts behind every row, so the
    file holds the records' bytes and nothing else. The window needs a file's records in one task; behind a
    join, adaptive execution may drop a repartition by its keys and deal a file's records to several tasks.
    """
    part = F.floor(F.col("packet_id") / 1_000_000).alias("part")
    d = records.select("flow_key", part, F.struct(*order).alias("_at"), "head", "record")
    d = d.withColumn("_no", F.row_number().over(Window.partitionBy("flow_key", "part").orderBy("_at")))
    whole = F.when(F.col("_no") == 1, F.concat("head", "record")).otherwise(F.col("record"))
    value = F.substring(whole, F.lit(1), F.length(whole) - len(end)).cast("string").alias("value")
    rows = d.sortWithinPartitions("flow_key", "part", "_no")
    path = shared_path(d.sparkSession, tag)
    rows.select(value, "flow_key", "part").write.option("lineSep", end).partitionBy("flow_key", "part").text(path)
    return path


def _captured(got: DataFrame) -> Column:
    """capture-<key>-<part> from the folders of a file."""
    named = lambda c: F.regexp_extract("path", f"{c}=([0-9]+)", 1)
    return F.concat_ws("-", F.lit("capture"), named("flow_key"), named("part"))


def frames(v: Views) -> DataFrame:
    """Ethernet frames of the packets: IPv4 with TCP (SYN where set) or UDP, a VLAN tag on every third."""
    be, k = _be, F.col("packet_id")
    tcp = F.col("protocol") == 6
    mac = F.unhex(F.lit("0" * 24))
    tag = F.when(k % 3 == 0, F.unhex(F.lit("81000005"))).otherwise(F.unhex(F.lit("")))
    ip = F.concat(F.unhex(F.lit("4500")), be(F.lit(40), 2), F.unhex(F.lit("0000")), be(F.when(k % 7 == 0, 5).otherwise(0), 2), F.unhex(F.lit("40")), be(F.col("protocol"), 1), F.unhex(F.lit("0000")), be(F.col("flow_key") + 167772160, 4), be(F.lit(167772161), 4))
    l4 = F.concat(be(F.pmod(k, F.lit(60000)), 2), be(F.lit(443), 2), F.unhex(F.lit("00" * 8)), F.unhex(F.lit("50")), be(F.when(F.col("syn"), 2).otherwise(16), 1), F.unhex(F.lit("00" * 6)))
    return v.packets.select("packet_id", "flow_key", "epoch_us", "protocol", F.concat(mac, tag, F.unhex(F.lit("0800")), ip, F.when(tcp | (F.col("protocol") == 17), l4).otherwise(F.unhex(F.lit("00")))).alias("frame"))


@query("proj_header_decode", "packets", "SELECT packet_id, 2048 AS ethertype, protocol, packet_id % 7 = 0 AS fragment, protocol = 6 AND syn AND packet_id % 7 <> 0 AS syn, CASE WHEN protocol IN (6, 17) AND packet_id % 7 <> 0 THEN packet_id % 60000 END AS src_port FROM packets")
def proj_header_decode(v: Views) -> DataFrame:
    c = readers.decode_header(F.col("frame"))
    return frames(v).select("packet_id", *[c[n].alias(n) for n in ("ethertype", "protocol", "fragment", "syn", "src_port")])


_JOB = "SELECT 'capture-' || flow_key || '-' || packet_id // 1000000 AS path, count(*) AS frames, CAST(sum(epoch_us) AS BIGINT) AS time_sum, CAST(sum(packet_id) AS BIGINT) AS id_sum, 0 AS out_of_order FROM packets GROUP BY 1"
_LF = "\n"
#: A capture holds its packets as they came by.
_TIME = ["epoch_us", "packet_id"]


def _job(got: DataFrame) -> DataFrame:
    """Frames carry their packet's number behind the header bytes.

    More than about 5,000 frames in a file have a sum of times beyond a BIGINT, which the SQL can't give; then, and
    only then, ``time_sum`` is a decimal.
    """
    number = F.conv(F.hex(F.substring("frame", F.length("frame") - 8, F.lit(8))), 16, 10).cast("long")
    each = got.groupBy(_captured(got).alias("path")).agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("epoch_us").cast("decimal(20,0)")).cast("decimal(38,0)").alias("time_sum"), F.sum(number).alias("id_sum"), F.count_if("late").alias("out_of_order"))
    each = written(each, "files")  # one row a file
    fits = each.where(~F.col("time_sum").between(-(2**63), 2**63 - 1)).isEmpty()
    return each.withColumn("time_sum", F.col("time_sum").cast("long")) if fits else each


def _numbered_frames(v: Views) -> DataFrame:
    return frames(v).withColumn("frame", F.concat("frame", _be(F.col("packet_id"), 8), F.unhex(F.lit("0A"))))


@query("src_pcap_job", "packets", _JOB)
def src_pcap_job(v: Views) -> DataFrame:
    """Captures built from the packets, one for each key, written as files and decoded again."""
    n, us = F.length("frame"), F.col("epoch_us")
    record = F.concat(_le(F.floor(us / 1_000_000)), _le(F.pmod(us, F.lit(1_000_000))), _le(n), _le(n), F.col("frame"))
    head = F.unhex(F.lit("d4c3b2a1" + "0200" + "0400" + "00" * 8 + "ffff0000" + "01000000"))
    path = _binary_files(_numbered_frames(v).select("flow_key", "epoch_us", "packet_id", head.alias("head"), record.alias("record")), "captures", _LF, _TIME)
    return _job(readers.pcap(v.spark, path))


@query("src_pcapng_job", "packets", _JOB)
def src_pcapng_job(v: Views) -> DataFrame:
    """The same as block captures: two interfaces, one counting nanoseconds, blocks of 96 bytes each."""
    size, k = "60000000", F.col("packet_id")
    comment, none = "01003c00" + "2e" * 60, "00000000"
    section = "0a0d0d0a" + size + "4d3c2b1a" + "01000000" + "ff" * 8 + comment + none + size
    interface = lambda digits: "01000000" + size + "01000000" + "00000400" + "09000100" + f"{digits:02x}000000" + comment + none + size
    ticks = F.when(k % 2 == 1, F.col("epoch_us") * 1000).otherwise(F.col("epoch_us"))
    body = F.rpad(F.col("frame"), F.lit(64), F.unhex(F.lit("00")))  # what follows the frame reads as the end of options
    n = F.length("frame")
    block = F.concat(F.unhex(F.lit("06000000" + size)), _le(F.pmod(k, F.lit(2))), _le(F.shiftright(ticks, 32)), _le(F.pmod(ticks, F.lit(2**32))), _le(n), _le(n), body, F.unhex(F.lit(size)))
    d = _numbered_frames(v).withColumn("frame", F.concat(F.substring("frame", F.lit(1), F.least(F.lit(55), F.length("frame") - 9)), F.substring("frame", F.length("frame") - 8, F.lit(9))))
    path = _binary_files(d.select("flow_key", "epoch_us", "packet_id", F.unhex(F.lit(section + interface(6) + interface(9))).alias("head"), block.alias("record")), "blocks", "`\x00\x00\x00", _TIME)
    return _job(readers.pcap(v.spark, path, "pcapng", strict=True))


@query("src_datagram_log", "packets", "SELECT 'capture-' || flow_key || '-' || packet_id // 1000000 AS path, count(*) + count(*) FILTER (WHERE packet_id % 11 = 0) AS datagrams, CAST(9 * count(*) AS BIGINT) AS bytes, 0 AS out_of_order FROM packets GROUP BY 1")
def src_datagram_log(v: Views) -> DataFrame:
    """Logs of length-prefixed datagrams (the packet's number as payload, an empty one before every 11th), decoded again."""
    k = F.col("packet_id")
    two = F.unhex(F.lit("4000000000000000"))  # 2.0 as a double
    record = F.concat(two, _be(F.lit(9), 4), _be(k, 8), F.unhex(F.lit("0A")))
    record = F.when(k % 11 == 0, F.concat(two, _be(F.lit(0), 4), record)).otherwise(record)
    path = _binary_files(v.packets.select("flow_key", "packet_id", F.unhex(F.lit("")).alias("head"), record.alias("record")), "logs", _LF, ["packet_id"])
    got = readers.datagram_log(v.spark, path)
    return got.groupBy(_captured(got).alias("path")).agg(F.count(F.lit(1)).alias("datagrams"), F.sum(F.length("payload").cast("long")).alias("bytes"), F.count_if("late").alias("out_of_order"))


@query("proj_sflow_explode", "packets", "SELECT packet_id AS datagram, CASE WHEN packet_id % 23 <> 0 THEN '0a000001' END AS agent, CASE WHEN packet_id % 23 <> 0 THEN packet_id END AS sequence, CASE WHEN packet_id % 23 <> 0 THEN 64 END AS rate, CASE WHEN packet_id % 23 <> 0 THEN CAST(length AS BIGINT) END AS frame_length, CASE WHEN packet_id % 23 <> 0 AND protocol IN (1, 6, 17) THEN protocol END AS protocol, packet_id % 23 = 0 AS malformed FROM packets WHERE protocol IN (1, 6, 17)")
def proj_sflow_explode(v: Views) -> DataFrame:
    """Datagrams with one sampled header each (expanded form on even packets, every 23rd cut), exploded and decoded."""
    k, n = F.col("packet_id"), F.length("frame")
    raw = F.concat(_be(F.lit(1), 4), _be(F.col("length"), 4), _be(F.lit(4), 4), _be(n, 4), F.col("frame"))
    record = F.concat(_be(F.lit(1), 4), _be(F.length(raw), 4), raw)
    four = lambda *xs: F.concat(*[_be(x if isinstance(x, Column) else F.lit(x), 4) for x in xs])
    compact = F.concat(four(1, 1, 64, 640, 2, 1, 2, 1), record)
    wide = F.concat(four(1, 0, 1, 64, 640, 2, 0, 1, 0, 2, 1), record)
    sample = F.when(k % 2 == 0, F.concat(four(3), four(F.length(wide)), wide)).otherwise(F.concat(four(1), four(F.length(compact)), compact))
    data = F.concat(four(5, 1), F.unhex(F.lit("0a000001")), four(0, k, 1000, 1), sample)
    data = F.when(k % 23 == 0, F.substring(data, F.lit(1), F.length(data) - 9)).otherwise(data)
    f = frames(v).join(v.packets.select("packet_id", "length"), "packet_id").where(F.col("protocol").isin(1, 6, 17))
    got = readers.sflow_samples(f.select(k.alias("datagram"), data.alias("payload")))
    protocol = readers.decode_header(F.col("header"), F.col("link"))["protocol"]
    return got.select("datagram", "agent", "sequence", "rate", "frame_length", protocol.alias("protocol"), F.col("error").isNotNull().alias("malformed"))
