"""Deterministic network views over the driver's tables.

The SQL is shared: ``{US}`` is the only part that differs between Spark and the oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .shared import written

SPARK_US, DUCK_US = "unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"

VIEWS = {
    "flows": """
SELECT event_id AS pos, event_id % 2500 + 1 AS rank_no, (event_id % 2500) * 7 AS offset_no, event_id % 5000 AS row_idx,
  concat('10.0.0.', CAST(user_id % 40 AS STRING)) AS src_addr,
  CASE WHEN CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) % 4 = 0 THEN NULL ELSE CAST(CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) % 12 AS STRING) END AS dport,
  CASE event_type WHEN 'click' THEN 'tcp' WHEN 'view' THEN 'udp' WHEN 'purchase' THEN 'icmp' WHEN 'signup' THEN 'sctp' ELSE 'arp' END AS proto,
  CAST(round(value * 100) AS BIGINT) AS tot_bytes, event_id * 7919 % 59 + 1 AS tot_pkts, round(value / 100, 4) AS dur,
  CASE WHEN event_id % 2500 BETWEEN 600 AND 1499 AND event_type <> 'view' THEN 'Malicious' ELSE 'Benign' END AS label,
  CASE WHEN NOT (event_id % 2500 BETWEEN 600 AND 1499 AND event_type <> 'view') THEN 'Benign' WHEN user_id % 3 = 0 THEN 'UDPFlood' WHEN user_id % 3 = 1 THEN 'SYNFlood' ELSE 'ICMPFlood' END AS attack_type
FROM events""",
    "packets": """
SELECT event_id AS packet_id, {US} AS epoch_us, user_id % 40 AS flow_key, CAST(round(value * 10) AS INT) + 42 AS length,
  CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 17 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 6 ELSE 58 END AS protocol,
  event_type = 'signup' AS syn, 1 AS sample_rate FROM events""",
    "flow_labels": """
SELECT user_id % 40 AS flow_key, {US} AS start_us, {US} + 43200000000 AS end_us,
  CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS label, CASE user_id % 3 WHEN 0 THEN 'Benign' WHEN 1 THEN 'SYNFlood' ELSE 'UDPFlood' END AS family
FROM events""",
    "predictions": """
SELECT user_id % 3 AS run_id, event_id AS idx, {US} AS observed_us, {US} + (event_id % 4) * 300000000 AS available_us,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN value > 30 THEN 1 ELSE 0 END AS y_true,
  CAST(least(CAST(floor((CAST(round(value * 100) AS BIGINT) * 3 + event_id % 40 * 100) / 300) AS BIGINT), 100) AS DOUBLE) / 100 AS score, event_id < 300 AS warmup, value AS x1, CAST(length(props) AS DOUBLE) AS x2 FROM events""",
    "vectors": """
SELECT l_quantity AS f1, l_discount AS f2, l_tax AS f3, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CAST(year(l_shipdate) AS INT) AS block FROM lineitem""",
    "trials": """
SELECT l_returnflag AS scenario, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 WHEN 4 THEN 10 WHEN 5 THEN 20 ELSE 50 END AS sampling_rate,
  l_suppkey % 3 + 1 AS trial_id, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc_sum, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty_sum, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3""",
}
_TABLE = {"vectors": "lineitem", "trials": "lineitem"}


class Views:
    """``v.flows``, ``v.packets``, ... and the plain tables by name, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._written: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What several passes of a query read, written once."""
        if name not in self._written:
            self._written[name] = written(make(), name)
        return self._written[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        table = _TABLE.get(name, "events")
        sql = VIEWS[name].replace("{US}", SPARK_US).replace(f"FROM {table}", f"FROM {{{table}}}", 1)
        return self.spark.sql(sql.replace("{US}", SPARK_US), **{table: self.table(table)})

    @cached_property
    def flows(self) -> DataFrame:
        return self._view("flows")

    @cached_property
    def packets(self) -> DataFrame:
        return self._view("packets")

    @cached_property
    def flow_labels(self) -> DataFrame:
        return self._view("flow_labels")

    @cached_property
    def predictions(self) -> DataFrame:
        return self._view("predictions")

    @cached_property
    def vectors(self) -> DataFrame:
        return self._view("vectors")

    @cached_property
    def trials(self) -> DataFrame:
        return self._view("trials")


def oracle_with(*views: str, more: str = "") -> str:
    """The WITH clause for an oracle query over the given views."""
    parts = [f"{v} AS ({VIEWS[v].replace('{US}', DUCK_US)})" for v in views]
    return "WITH " + ",\n".join(parts + ([more] if more else [])) + "\n"
