"""Sessions, blocks, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators import ordering, splits
from netsift.sources.views import Views

from .base import BLOCKS, SESSIONS, query


@query("ord_position", sql="SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def ord_position(v: Views) -> DataFrame:
    e = v.table("events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    # ties of the time stamp are broken by the id inside the order key
    key = F.col("us").cast("decimal(38,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("event_id")
    return ordering.position(e.withColumn("k", key.cast("decimal(38,0)")), "k").select("event_id", "pos")


@query("ses_rank_reset", "flows", "SELECT pos, session_id FROM s", SESSIONS)
def ses_rank_reset(v: Views) -> DataFrame:
    return ordering.sessions(v.flows).select("pos", "session_id")


@query("ses_rank_gaps", "flows", """SELECT session_id, count(*) FILTER (WHERE d > 1) AS gaps, count(*) AS n_rows
FROM (SELECT session_id, rank_no - lag(rank_no) OVER (PARTITION BY session_id ORDER BY pos) AS d FROM s) GROUP BY session_id""", SESSIONS)
def ses_rank_gaps(v: Views) -> DataFrame:
    return ordering.rank_gaps(v.flows)


@query("ses_offset_blocks", "flows", "SELECT pos, block FROM b", BLOCKS)
def ses_offset_blocks(v: Views) -> DataFrame:
    return ordering.capture_blocks(v.flows).select("pos", "block")


@query("ses_base_station", "flows", """SELECT pos, CAST(sum(CASE WHEN row_idx < pr THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS BIGINT) AS station
FROM (SELECT *, lag(row_idx) OVER (ORDER BY pos) AS pr FROM flows)""")
def ses_base_station(v: Views) -> DataFrame:
    return ordering.base_stations(v.flows).select("pos", "station")


@query("ses_contiguous_runs", "flows", """SELECT pos, CAST(sum(CASE WHEN rn > 1 AND dport IS DISTINCT FROM pd THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS BIGINT) AS run
FROM (SELECT pos, dport, lag(dport) OVER (ORDER BY pos) AS pd, row_number() OVER (ORDER BY pos) AS rn FROM flows)""")
def ses_contiguous_runs(v: Views) -> DataFrame:
    return ordering.contiguous_runs(v.flows, "pos", "dport").select("pos", "run")


_SPLIT = BLOCKS + """,
k AS (SELECT *, row_number() OVER (PARTITION BY block, label ORDER BY pos) - 1 AS rn, count(*) OVER (PARTITION BY block, label) AS k FROM b),
sp AS (SELECT *, CASE WHEN rn < floor(k * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN rn < floor(k * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split FROM k)"""


def _split(v: Views, **more: object) -> DataFrame:
    return splits.block_label_split(v.once("blocks", lambda: ordering.capture_blocks(v.flows)), **more)


@query("split_block_label", "flows", "SELECT pos, block, split FROM sp", _SPLIT)
def split_block_label(v: Views) -> DataFrame:
    return _split(v).select("pos", "block", "split")


@query("split_rotate", "flows", """SELECT pos, CASE WHEN r < floor(k * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN r < floor(k * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, ((rn - CAST(floor(k * CAST(0.3 AS DOUBLE)) AS BIGINT)) % k + k) % k AS r FROM k)""", _SPLIT)
def split_rotate(v: Views) -> DataFrame:
    return _split(v, rotate=0.3).select("pos", "split")


@query("split_purge", "flows", """SELECT pos, CASE WHEN rn < a AND rn >= a - 20 OR rn >= a AND rn < b AND rn >= b - 20 THEN 'purged' ELSE split END AS split
FROM (SELECT *, floor(k * CAST(0.7 AS DOUBLE)) AS a, floor(k * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS b FROM sp)""", _SPLIT)
def split_purge(v: Views) -> DataFrame:
    return _split(v, purge=20).select("pos", "split")


@query("split_validate", "flows", "SELECT split, count(*) AS n_rows, count(DISTINCT label) AS labels FROM sp GROUP BY split", _SPLIT)
def split_validate(v: Views) -> DataFrame:
    return _split(v).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("labels"))


_PARTS = ", ".join(f"count(*) FILTER (WHERE split = '{s}' AND label {o} 'Malicious') AS {s}_{c}" for s in ("train", "val", "test") for c, o in (("benign", "<>"), ("malicious", "=")))


@query("split_manifest", "flows", f"""SELECT block, count(*) AS n_rows, count(*) FILTER (WHERE label = 'Malicious') AS n_malicious,
coalesce(array_to_string(list_sort(list(DISTINCT attack_type) FILTER (WHERE label = 'Malicious')), '|'), '') AS attacks, {_PARTS} FROM sp GROUP BY block""", _SPLIT)
def split_manifest(v: Views) -> DataFrame:
    return splits.split_manifest(_split(v))


_HOLD = BLOCKS + """,
h AS (SELECT *, CASE WHEN block IN (1, 3) THEN 'unseen' WHEN row_number() OVER (PARTITION BY block ORDER BY pos) - 1 < floor(count(*) OVER (PARTITION BY block) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS side FROM b)"""


def _hold(v: Views) -> DataFrame:
    return splits.block_holdout(v.once("blocks", lambda: ordering.capture_blocks(v.flows)), [1, 3])


@query("split_block_holdout", "flows", "SELECT pos, side FROM h", _HOLD)
def split_block_holdout(v: Views) -> DataFrame:
    return _hold(v).select("pos", "side")


@query("split_isolation", "flows", """SELECT block, count(*) FILTER (WHERE side = 'unseen') AS n_unseen, count(*) FILTER (WHERE side <> 'unseen') AS n_dev,
count(*) FILTER (WHERE side = 'unseen') > 0 AND count(*) FILTER (WHERE side <> 'unseen') > 0 AS leaks, (count(*) FILTER (WHERE side = 'unseen') > 0) = (block IN (1, 3)) AS as_configured FROM h GROUP BY block""", _HOLD)
def split_isolation(v: Views) -> DataFrame:
    return splits.isolation(_hold(v), [1, 3])


@query("split_holdout_manifest", "flows", """SELECT block, CASE WHEN block IN (1, 3) THEN 'unseen' ELSE 'dev' END AS side, count(*) AS n_rows,
100.0::DOUBLE * count(*) FILTER (WHERE label = 'Malicious') / count(*) AS malicious_pct, array_to_string(list_sort(list(DISTINCT attack_type)), '|') AS attacks FROM h GROUP BY block""", _HOLD)
def split_holdout_manifest(v: Views) -> DataFrame:
    d = _hold(v).withColumn("side", F.when(F.col("side") == "unseen", "unseen").otherwise("dev"))
    pct = 100.0 * F.count_if(F.col("label") == "Malicious") / F.count(F.lit(1))
    return d.groupBy("block", "side").agg(F.count(F.lit(1)).alias("n_rows"), pct.alias("malicious_pct"), F.array_join(F.array_sort(F.collect_set("attack_type")), "|").alias("attacks"))


@query("split_metadata_align", "flows", "SELECT split, attack_type, count(*) AS n_rows, count(*) FILTER (WHERE (label = 'Malicious') <> (attack_type <> 'Benign')) AS misaligned FROM sp GROUP BY split, attack_type", _SPLIT)
def split_metadata_align(v: Views) -> DataFrame:
    off = (F.col("label") == "Malicious") != (F.col("attack_type") != "Benign")
    return _split(v).groupBy("split", "attack_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(off).alias("misaligned"))


_HASH = "CAST(('0x' || substr(md5('42:' || CAST({} AS VARCHAR)), 1, 8)) AS BIGINT)"


@query("smp_stratified", "flows", f"""SELECT pos, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format('pos')}, pos) AS rn, count(*) OVER (PARTITION BY label) AS k, count(*) OVER () AS n FROM flows)
WHERE rn <= greatest(1, least(round_even(CAST(1000 AS DOUBLE) * k / n, 0), k))""")
def smp_stratified(v: Views) -> DataFrame:
    return splits.stratified_sample(v.flows, 1000).select("pos", "label")


@query("smp_bernoulli", "packets", f"SELECT packet_id, length FROM packets WHERE {_HASH.format('packet_id')} % 10 = 0")
def smp_bernoulli(v: Views) -> DataFrame:
    return splits.bernoulli_sample(v.packets, 10, "packet_id").select("packet_id", "length")


@query("smp_warmup_prefix", "predictions", "SELECT run_id, idx, CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY idx) <= 100 THEN 'warmup' ELSE 'evaluation' END AS phase FROM predictions WHERE y_true IS NOT NULL")
def smp_warmup_prefix(v: Views) -> DataFrame:
    return splits.warmup_prefix(v.predictions, 100, F.col("y_true").isNotNull(), "idx", "run_id").select("run_id", "idx", "phase")


@query("smp_even_downsample", "predictions", """SELECT run_id, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM predictions)
WHERE n <= 100 OR i IN (SELECT DISTINCT i FROM (SELECT 1)) AND list_contains(list_transform(range(100), lambda j: CAST(round_even(j * (n - 1) / CAST(99 AS DOUBLE), 0) AS BIGINT)), i)""")
def smp_even_downsample(v: Views) -> DataFrame:
    return splits.even_downsample(v.predictions, 100, "idx", "run_id").select("run_id", "idx", "score")


@query("smp_stride_thin", "predictions", "SELECT run_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY run_id) // 200) AS k FROM predictions) WHERE i % k = 0")
def smp_stride_thin(v: Views) -> DataFrame:
    return splits.stride_thin(v.predictions, 200, "idx", "run_id").select("run_id", "idx")


@query("smp_disjoint_slices", "flows", """SELECT attack_type, plan, take, CAST(sum(take) OVER (PARTITION BY attack_type ORDER BY plan) - take AS BIGINT) AS skip
FROM (SELECT attack_type, pos // 500 AS plan, count(*) AS take FROM flows GROUP BY 1, 2)""")
def smp_disjoint_slices(v: Views) -> DataFrame:
    plans = v.flows.groupBy("attack_type", F.floor(F.col("pos") / 500).alias("plan")).agg(F.count(F.lit(1)).alias("take"))
    return splits.disjoint_slices(plans, ["attack_type"], "plan", "take")


@query("smp_block_select", "flows", """, p AS (SELECT attack_type, plan, 20 AS take, 60 * (row_number() OVER (PARTITION BY attack_type ORDER BY plan) - 1) AS skip FROM (SELECT DISTINCT attack_type, pos // 500 AS plan FROM flows)),
r AS (SELECT pos, attack_type, row_number() OVER (PARTITION BY attack_type ORDER BY pos) - 1 AS rn FROM flows)
SELECT r.pos, p.attack_type, p.plan, (r.rn - p.skip) / CAST(100 AS DOUBLE) AS at_s FROM r JOIN p ON r.attack_type = p.attack_type AND r.rn >= p.skip AND r.rn < p.skip + p.take""")
def smp_block_select(v: Views) -> DataFrame:
    """20 packets of a family after each plan's skip, retimed at 100 packets a second: a rank join, not a range join."""
    from pyspark.sql import Window

    plans = v.flows.select("attack_type", F.floor(F.col("pos") / 500).alias("plan")).distinct()
    skip = 60 * (F.row_number().over(Window.partitionBy("attack_type").orderBy("plan")) - 1)
    wanted = plans.withColumn("skip", skip).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("rn", F.col("skip") + F.col("i"))
    r = v.flows.select("pos", "attack_type", (F.row_number().over(Window.partitionBy("attack_type").orderBy("pos")) - 1).alias("rn"))
    return r.join(wanted, ["attack_type", "rn"]).select("pos", "attack_type", "plan", (F.col("i") / 100).alias("at_s"))


@query("lim_first_n", "flows", "SELECT pos, label FROM flows WHERE pos < 500")
def lim_first_n(v: Views) -> DataFrame:
    return v.flows.where("pos < 500").select("pos", "label")
