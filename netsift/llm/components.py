"""Connected components by alternating large-star and small-star steps on an edge table.

Every step is a join (vertices with very many edges are broadcast) and an aggregate; the driver only asks whether any vertex is left to move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over (u, v), u > v. Small: neighbours below u; large: neighbours above u."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    if small:
        moved = joined(edges, least, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each v is its component's smallest id."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in a link the smallest id that it reaches.

    Ids without a link are absent. Repeated links, loops and an empty table are allowed.
    """
    edges = written(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    while not _stars(edges):
        edges = written(_star(written(_star(edges, False), "large"), True), "small")
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
