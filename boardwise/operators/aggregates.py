"""Aggregates that hold whatever the order of rows: latest, first and rated values, and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered_rows


def nulls_last(*keys: str) -> Column:
    """Key by which a null counts as greatest."""
    return F.struct(*[x for k in keys for x in (F.col(k).isNull().alias(f"{k}_null"), F.col(k).alias(k))])


def latest(value: str | Column, *keys: str) -> Column:
    """Value of the last row by keys, null or not. With keys that tell all rows apart, partial aggregation is exact."""
    return F.max_by(value, nulls_last(*keys))


def latest_known(value: str | Column, *keys: str) -> Column:
    """Value of the last row by keys that has one."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.when(v.isNotNull(), F.struct(*keys)))


def first_by(value: str, *keys: str) -> Column:
    return F.min_by(value, nulls_last(*keys))


def rating(method: str, value: str, *keys: str) -> Column:
    methods = {"Latest": lambda: latest(value, *keys), "Avg": lambda: F.avg(value), "Max": lambda: F.max(value)}
    if method not in methods:
        raise ValueError(f"unknown rating method {method!r}")
    return methods[method]()


def rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int"))


def pages(df: DataFrame, order: Sequence[tuple[str, bool]], first: int, rest: int) -> DataFrame:
    """Page numbers of sorted rows: `first` on the first page, `rest` on each other."""
    out = numbered_rows(df, order).withColumn("row", F.col("row").cast("int"))
    return out.withColumn("page", F.when(F.col("row") <= first, 1).otherwise(F.ceil((F.col("row") - first) / rest) + 1).cast("int"))


def stacked_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation over all usable values of several columns."""
    long = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v")).where("v is not null and not isnan(v)")
    return long.agg(F.avg("v").alias("mean"), F.when(F.count("v") > 1, F.nullif(F.stddev_pop("v"), F.lit(0.0))).alias("sd"))


def merged_stats(parts: DataFrame) -> DataFrame:
    """One row: mean and population deviation of all values, from parts with their count n, mean and m2 (the sum of squared deviations)."""
    n, centre = F.sum("n"), F.lit(1500.0)  # any fixed centre, near the values so that little cancels out
    mean = F.sum(F.col("n") * F.col("mean")) / n
    m2 = F.sum("m2") + F.sum(F.col("n") * (F.col("mean") - centre) ** 2) - n * (mean - centre) ** 2
    return parts.agg(mean.alias("mean"), F.when(n > 1, F.nullif(F.sqrt(F.greatest(m2, F.lit(0.0)) / n), F.lit(0.0))).alias("sd"))
