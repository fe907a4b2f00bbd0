"""Ranks, medians and numbers of rows over tables of any size, without a task that has all rows.

Equal values are counted first, so ties are one row however many they are. What is left is dealt by ranges; a range starts
at the number of rows in those ahead of it, and within it a running sum goes on from there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed

#: Rows up to which one task ranks them, by a plain window.
FEW = 5000
#: Values of a measure up to which their ranks are sent to all tasks.
SENT = 100_000


def ordered(*keys: tuple[str, bool]) -> list[Column]:
    """Sort keys as (column, descending), nulls last."""
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys]


def _key(c: Column, down: bool) -> tuple[Column, Column]:
    """(k, v), by which a measure's values sort upwards, NaN as the greatest and nulls last."""
    v = c.cast("double")
    k = F.when(v.isNull(), 2).when(F.isnan(v), -1 if down else 1).otherwise(0)
    return k, F.when(k == 0, -v if down else v).otherwise(0.0)


def _measured(df: DataFrame, measures: Sequence[tuple[Column, bool]]) -> DataFrame:
    """A row for each measure: m, its place in measures, and its value's (k, v)."""
    keys = [_key(c, down) for c, down in measures]
    return df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("m"), k.alias("k"), v.alias("v")) for i, (k, v) in enumerate(keys)])))


def _placed(values: DataFrame) -> DataFrame:
    """m, k, v, n and before: how many rows of values (m, k, v) each distinct one has, and how many of the same m sort before it."""
    keys = ["m", "k", "v"]
    counts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    kept = checkpointed(counts.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    ahead = Window.partitionBy("m").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("m", "range").agg(F.sum("n").alias("size")).select("m", "range", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))  # a row a task and measure
    within = Window.partitionBy("m", "range").orderBy("k", "v").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("sum", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), ["m", "range"]).select(*keys, "n", (F.col("start") + F.col("sum")).alias("before"))


def ranks(df: DataFrame, key: str, measures: Mapping[str, tuple[Column, bool]], n: int | None = None) -> DataFrame:
    """df with a rank for each of measures: (value, descending); equal values have the same one, nulls the last.

    key tells df's rows apart, and one may be null. All measures are ranked in one pass, by counts of their values. Their
    ranks are joined to the rows by value, a measure after the other: by broadcast where values are few, and otherwise each in
    stages of its own, so that a task sorts its rows once at a time. n: how many rows df has; a few are ranked by windows.
    """
    if n is not None and n <= FEW:
        return df.withColumns({name: F.rank().over(Window.orderBy(c.desc_nulls_last() if down else c.asc_nulls_last())) for name, (c, down) in measures.items()})
    placed = checkpointed(_placed(_measured(df, [*measures.values()]))).select("m", "k", "v", (F.col("before") + 1).cast("int").alias("rank"))
    values, kept = {r["m"]: r["count"] for r in placed.groupBy("m").count().collect()}, df.columns  # a row a measure
    for i, (name, (c, down)) in enumerate(measures.items()):
        of = placed.where(F.col("m") == i).select(F.col("k").alias("_k"), F.col("v").alias("_v"), F.col("rank").alias(name))
        k, v = _key(c, down)
        df = df.withColumns({"_k": k, "_v": v}).join(F.broadcast(of) if values.get(i, 0) <= SENT else of, ["_k", "_v"]).select(*kept, name)
        kept = [*kept, name]
    return df


def medians(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """One row: the exact median of each column's values that aren't null, the mean of the two middle ones of an even number; null without any."""
    placed = checkpointed(_placed(_measured(df, [(c, False) for c in columns.values()]).where("k < 2")))
    halves = placed.groupBy("m").agg(F.sum("n").alias("all")).select(F.col("m").alias("_m"), F.expr("(all - 1) div 2").alias("low"), F.expr("all div 2").alias("high"))
    at = placed.join(F.broadcast(halves), F.col("m") == F.col("_m"))  # a row a measure
    holds = lambda c: (F.col("before") <= F.col(c)) & (F.col(c) < F.col("before") + F.col("n"))
    v = F.when(F.col("k") == 1, float("nan")).otherwise(F.col("v"))
    middle = at.where(holds("low") | holds("high"))
    of = lambda i, c: F.max(F.when((F.col("m") == i) & holds(c), v))
    return middle.agg(*[((of(i, "low") + of(i, "high")) / 2.0).alias(name) for i, name in enumerate(columns)])


def numbered_rows(df: DataFrame, order: Sequence[tuple[str, bool]], name: str = "row", n: int | None = None) -> DataFrame:
    """Adds the number of each row in sorted order, to a table of any size; equal keys are numbered in any order.

    Ranges of keys are sorted apart, in as many tasks as there are shuffle partitions, and each starts at the number of rows
    in the ranges ahead of it. What each task sorted is kept, so that counts and rows agree. n: how many rows df has; a few
    are numbered by a window.
    """
    if n is not None and n <= FEW:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*ordered(*order))))
    dealt = df.repartitionByRange(*ordered(*order)).withColumn("range", F.spark_partition_id())
    kept = checkpointed(dealt.select("range", F.struct(*df.columns).alias("own"), F.struct(*[F.col(c) for c, _ in order]).alias("keys")))
    sizes = kept.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row a task
    starts = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*[F.desc_nulls_last(f"keys.{c}") if down else F.asc_nulls_last(f"keys.{c}") for c, down in order]))
    return kept.withColumn("row", within).join(F.broadcast(starts), "range").select("own.*", (F.col("row") + F.col("start")).alias(name))


def listed(df: DataFrame, order: Sequence[tuple[str, bool]], n: int, name: str = "Rank") -> DataFrame:
    """The first n rows in sorted order, of which each task sends n at most, numbered from 1."""
    first = df.orderBy(*ordered(*order)).limit(n)
    keys = [x for c, down in order for x in ((F.col(c).isNull()), (-F.col(c) if down else F.col(c)))]
    rows = first.agg(F.array_sort(F.collect_list(F.struct(*[x.alias(f"_{i}") for i, x in enumerate(keys)], F.struct(*df.columns).alias("own")))).alias("rows"))
    return rows.select(F.posexplode("rows").alias("at", "row")).select("row.own.*", (F.col("at") + 1).alias(name))
