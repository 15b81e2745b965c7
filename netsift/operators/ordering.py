"""Order as data: positions, resets, runs, without a window over all rows in one task.

A position column is cut into ranges by bounds taken from the data. Windows run inside a range; one
row for each range carries what the next ranges need (last value, sum) and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.sources.shared import written

#: Ranges that a position column is cut into: at least so many, and at least the session's shuffle partitions.
RANGES = 64


def _ranges(df: DataFrame) -> int:
    """Grows with the cluster: who sets thousands of shuffle partitions gets thousands of ranges."""
    return max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _below(bounds: Column, x: Column, most: int) -> Column:
    """How many of the ascending ``bounds`` (at most ``most``) lie below ``x``: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, w: F.when(F.get(bounds, at + w - 1) < x, at + w).otherwise(at))


def ranged(df: DataFrame, pos: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: the number of bounds below the position (at most ``ranges``)."""
    ranges = ranges or _ranges(df)
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = df.agg(F.coalesce(F.percentile_approx(pos, shares, max(10_000, 4 * ranges)), F.array().cast(f"array<{df.schema[pos].dataType.simpleString()}>")).alias("_bounds"))
    # one row with at most ``ranges`` numbers
    return df.crossJoin(F.broadcast(bounds)).withColumn("_range", _below(F.col("_bounds"), F.col(pos), ranges)).drop("_bounds")


def _inside(pos: str) -> Window:
    return Window.partitionBy("_range").orderBy(pos)


def neighbours(df: DataFrame, pos: str, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
    """Columns of the row before and of the row after in position order, across ranges.

    ``before`` and ``after`` name the new columns and the columns that they hold. ``_range`` stays.
    """
    before, after = before or {}, after or {}
    d = df if "_range" in df.columns else ranged(df, pos)
    ends = d.groupBy("_range").agg(*[F.max_by(c, pos).alias(f"_p_{o}") for o, c in before.items()], *[F.min_by(c, pos).alias(f"_n_{o}") for o, c in after.items()])
    w = Window.orderBy("_range")
    carry = ends.select("_range", *[F.lag(f"_p_{o}").over(w).alias(f"_p_{o}") for o in before], *[F.lead(f"_n_{o}").over(w).alias(f"_n_{o}") for o in after])
    d = d.join(F.broadcast(carry), "_range")  # one row for each range
    inside = _inside(pos)
    first, last = F.row_number().over(inside) == 1, F.lead(F.lit(1)).over(inside).isNull()
    for o, c in before.items():
        d = d.withColumn(o, F.when(first, F.col(f"_p_{o}")).otherwise(F.lag(c).over(inside)))
    for o, c in after.items():
        d = d.withColumn(o, F.when(last, F.col(f"_n_{o}")).otherwise(F.lead(c).over(inside)))
    return d.drop(*[f"_p_{o}" for o in before], *[f"_n_{o}" for o in after])


def previous(df: DataFrame, pos: str, value: str, out: str) -> DataFrame:
    """The value of the row before in position order, across ranges."""
    return neighbours(df, pos, before={out: value})


def running_sums(df: DataFrame, pos: str, values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """For each name the sum of its column over all rows up to this one in position order, across ranges."""
    d = df if "_range" in df.columns else ranged(df, pos)
    d = d.withColumns({f"_n_{o}": c for o, c in values.items()})
    sums = d.groupBy("_range").agg(*[F.sum(f"_n_{o}").alias(f"_s_{o}") for o in values])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("_range", *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_c_{o}") for o in values])
    d = d.join(F.broadcast(carry), "_range")
    for o in values:
        here = F.sum(f"_n_{o}").over(_inside(pos).rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_c_{o}")
        d = d.withColumn(o, here if inclusive else here - F.col(f"_n_{o}"))
    return d.drop(*[f"{x}{o}" for o in values for x in ("_n_", "_c_")])


def running_sum(df: DataFrame, pos: str, value: str | Column, out: str, inclusive: bool = True) -> DataFrame:
    return running_sums(df, pos, {out: F.col(value) if isinstance(value, str) else value}, inclusive)


def running_within(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], inclusive: bool = True, totals: dict[str, str] | None = None) -> DataFrame:
    """For each name the sum of its column over the rows of the same group up to this one, in the order of ``order``.

    The first column of ``order`` is a number and is cut into ranges, so no task sorts a whole group. What
    a range takes over from the ranges before it is a row of its own that comes first in it: rows meet it
    without a join. ``totals`` names columns for the sums over whole groups. Null groups are groups.
    """
    d = ranged(df.drop("_range"), order[0]).withColumns({f"_v_{o}": c for o, c in values.items()}).withColumn("_row", F.lit(True))
    sums = d.groupBy(*by, "_range").agg(*[F.sum(f"_v_{o}").alias(f"_v_{o}") for o in values])
    group = Window.partitionBy(*by)  # at most one row a range
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = {f"_t_{t}": F.sum(f"_v_{o}").over(group) for o, t in (totals or {}).items()}
    carry = sums.withColumns({**whole, **{f"_c_{o}": F.sum(f"_v_{o}").over(before) for o in values}})
    carry = carry.select(*by, "_range", *whole, *[F.col(f"_c_{o}").alias(f"_v_{o}") for o in values], F.lit(False).alias("_row"))
    upto = Window.partitionBy(*by, "_range").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for o in values:
        here = F.coalesce(F.sum(f"_v_{o}").over(upto), F.lit(0))
        out[o] = here if inclusive else here - F.coalesce(f"_v_{o}", F.lit(0))
    out |= {t: F.first(f"_t_{t}").over(upto) for t in (totals or {}).values()}
    u = d.unionByName(carry, allowMissingColumns=True).withColumns(out).where("_row")
    return u.drop("_row", "_range", *whole, *[f"_v_{o}" for o in values])


def numbered(df: DataFrame, by: list[str], order: list[str], out: str, total: str | None = None) -> DataFrame:
    """0-based number of each row inside its group, and the number of the group's rows."""
    return running_within(df, by, order, {out: F.lit(1).cast("long")}, inclusive=False, totals={out: total} if total else None)


_SCANS = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}


def scan_within(df: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """For each name the sum, max, min or last known value of a column over the rows of the group up to this one, or before it.

    As ``running_within``: the first of ``order`` is a number that is cut into ranges, a range begins with a row
    that holds the summary of the group's ranges before. Sums of nothing are 0, others null. A ``_range`` that
    ``df`` has already (``ranged`` by the same column) is used and stays, so several scans cut once.
    """
    given = "_range" in df.columns
    d = (df if given else ranged(df, order[0])).withColumns({f"_v_{o}": c for o, (_, c) in values.items()}).withColumn("_row", F.lit(True))
    newest = lambda o: F.max(F.when(F.col(f"_v_{o}").isNotNull(), F.struct(*order, F.col(f"_v_{o}").alias("_x"))))["_x"]
    whole = d.groupBy(*by, "_range").agg(*[(newest(o) if kind == "last" else _SCANS[kind](f"_v_{o}")).alias(f"_v_{o}") for o, (kind, _) in values.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carry = whole.select(*by, "_range", *[_SCANS[kind](f"_v_{o}").over(before).alias(f"_v_{o}") for o, (kind, _) in values.items()], F.lit(False).alias("_row"))
    upto = Window.partitionBy(*by, "_range").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    found = {o: _SCANS[kind](f"_v_{o}").over(upto) for o, (kind, _) in values.items()}
    out = {o: F.coalesce(c, F.lit(0)) if values[o][0] == "sum" else c for o, c in found.items()}
    u = d.unionByName(carry, allowMissingColumns=True).withColumns(out).where("_row")
    return u.drop("_row", *([] if given else ["_range"]), *[f"_v_{o}" for o in values])


def streaks(df: DataFrame, by: list[str], order: list[str], hit: Column, out: str, anew: Column | None = None) -> DataFrame:
    """How many rows in a row, up to each, were hits: 0 for others, counted from the row itself where ``anew``.

    Every range sums itself up as (rows, whether a streak broke in it, hits at its end); one row for each group
    and range carries the streak into the next, over any number of ranges without a break. No window holds
    more than a group's rows of one range. A null hit is none.
    """
    hit = F.coalesce(hit, F.lit(False))
    d = ranged(df.drop("_range"), order[0]).withColumn("_h", hit.cast("long"))
    d = d.withColumn("_b", (~hit | F.coalesce(anew, F.lit(False)) if anew is not None else ~hit).cast("long"))
    d = d.withColumn("_g", F.sum("_b").over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    here = F.sum("_h").over(Window.partitionBy(*by, "_range", "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    d = written(d.withColumn("_s", here), "streaks")
    ends = d.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.max("_b").alias("_broke"), F.max(F.struct(*order, "_s"))["_s"].alias("_end"))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # one row a range
    rows = F.sum("_n").over(upto)
    ends = ends.withColumn("_upto", rows).withColumn("_base", F.coalesce(F.last(F.when(F.col("_broke") == 1, F.col("_upto") - F.col("_end")), ignorenulls=True).over(upto), F.lit(0)))
    carry = ends.select(*by, "_range", F.coalesce(F.lag(F.col("_upto") - F.col("_base")).over(Window.partitionBy(*by).orderBy("_range")), F.lit(0)).alias("_carry"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_range"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    j = d.alias("d").join(carry.alias("c"), on).select("d.*", "_carry")
    return j.withColumn(out, F.col("_s") + F.when(F.col("_g") == 0, F.col("_carry")).otherwise(0)).drop("_h", "_b", "_g", "_s", "_carry", "_range")


#: Rows of a series that one chunk holds, unless more are looked back at.
CHUNK = 16_384


def chunked(df: DataFrame, number: str, back: int, repeat: Column | None = None) -> DataFrame:
    """``df`` with ``_chunk``, the number cut into equal parts, and ``_own``; the last ``back`` rows of a chunk come again in the next, not ``_own``.

    Frames of at most ``back`` rows then lie inside (series, ``_chunk``). Only rows of ``repeat`` come again.
    """
    size = max(CHUNK, 4 * back)
    home = F.floor(F.col(number) / size)
    again = F.pmod(F.col(number), F.lit(size)) >= size - back
    if repeat is not None:
        again = again & repeat
    d = df.withColumn("_home", home).withColumn("_chunk", F.explode(F.when(again, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    return d.withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_home")


def position(df: DataFrame, order: str, out: str = "pos") -> DataFrame:
    """0-based number of each row in the order of ``order`` (distinct values)."""
    return running_sum(df, order, F.lit(1).cast("long"), out, inclusive=False).drop("_range")


def resets(df: DataFrame, pos: str, value: str, out: str, strict: bool, first: int) -> DataFrame:
    """Number of the run: a new one where the value falls (``strict``) or does not rise.

    One pass counts inside ranges; whether a range begins with a new run is decided on the row that
    stands for it. A null value neither falls nor is fallen from.
    """
    falls = lambda a, b: F.coalesce(b < a if strict else b <= a, F.lit(False)).cast("long")
    inside, in_order = _inside(pos), Window.orderBy("_range")
    d = ranged(df, pos)
    d = d.withColumn("_new", falls(F.lag(value).over(inside), F.col(value)))  # none for the first row of a range
    ends = d.groupBy("_range").agg(F.min_by(value, pos).alias("_f"), F.max_by(value, pos).alias("_l"), F.sum("_new").alias("_s"))
    ends = ends.withColumn("_at", falls(F.lag("_l").over(in_order), F.col("_f")))
    so_far = F.sum(F.col("_at") + F.col("_s")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    d = d.join(F.broadcast(ends.select("_range", so_far.alias("_c"))), "_range")  # one row for each range
    here = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, F.col("_c") + here + first).drop("_new", "_c", "_range")


def sessions(df: DataFrame, pos: str = "pos", rank: str = "rank_no", out: str = "session_id") -> DataFrame:
    """A new session where the rank does not rise; 1-based."""
    return resets(df, pos, rank, out, strict=False, first=1)


def capture_blocks(df: DataFrame, pos: str = "pos", offset: str = "offset_no", out: str = "block") -> DataFrame:
    """A new capture block where the offset falls; 0-based."""
    return resets(df, pos, offset, out, strict=True, first=0)


def base_stations(df: DataFrame, pos: str = "pos", index: str = "row_idx", out: str = "station") -> DataFrame:
    return resets(df, pos, index, out, strict=True, first=0)


def contiguous_runs(df: DataFrame, pos: str, key: str, out: str = "run") -> DataFrame:
    """Runs of equal keys (nulls are equal); a key that comes back opens a new run; 0-based."""
    d = previous(df, pos, key, "_prev")
    d = d.withColumn("_any", F.lit(1).cast("long"))
    d = running_sum(d, pos, F.col("_any"), "_at")
    change = (F.col("_at") > 1) & ~F.col(key).eqNullSafe(F.col("_prev"))
    return running_sum(d, pos, change.cast("long"), out).drop("_prev", "_any", "_at", "_range")


def rank_gaps(df: DataFrame, pos: str = "pos", rank: str = "rank_no") -> DataFrame:
    """For each session the steps of the rank above one."""
    s = previous(sessions(df, pos, rank), pos, rank, "_prev")
    # the first step of a session is none: it does not rise
    step = F.col(rank) - F.col("_prev")
    return s.withColumn("_step", step).groupBy("session_id").agg(F.count_if(F.col("_step") > 1).alias("gaps"), F.count(F.lit(1)).alias("n_rows"))
