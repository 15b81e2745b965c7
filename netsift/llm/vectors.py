"""Vectors as numpy matrices: which take part, and how they come out of Arrow and pandas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null, not empty, not all zero, every component finite."""
    e = F.col(column)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def doubles(df: DataFrame, column: str = "embedding") -> Column:
    return F.col(column).cast("array<double>")
