import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from boardwise.operators import ranges as N


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(8)
    draw = lambda: r.choice([None, float("nan"), 0.0, -0.0, float("inf"), 1.5, 1.5, r.uniform(-3, 3), float(r.randrange(4))])
    rows = [(None if i == 7 else f"k{i}", draw(), 5.0 if i % 3 else r.random(), r.randrange(3)) for i in range(997)]
    return rows, spark.createDataFrame(rows, "key string, a double, hot double, few int").repartition(5)


def order(v, down):
    """Places of values upwards or downwards, as Spark sorts: NaN is the greatest, nulls are last."""
    return (1, 0.0, 0.0) if v is None else (0, (-1.0 if down else 1.0) if math.isnan(v) else 0.0, 0.0 if math.isnan(v) else (-v if down else v) + 0.0)


@pytest.mark.parametrize("n", [None, 997])
@pytest.mark.parametrize("parts", ["1", "7"])
def test_ranks_with_ties_over_the_borders_of_ranges(spark, values, n, parts):
    rows, df = values
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.key: r[4:] for r in N.ranks(df, "key", {"x": (F.col("a"), True), "y": (F.col("a"), False), "z": (F.col("hot"), True), "w": (F.col("few"), False)}, n).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, (at, down) in enumerate([(1, True), (1, False), (2, True), (3, False)]):
        keys = sorted(order(r[at], down) for r in rows)
        first = {}
        for place, k in enumerate(keys, 1):
            first.setdefault(k, place)
        assert {r[0]: got[r[0]][i] for r in rows} == {r[0]: first[order(r[at], down)] for r in rows}


@pytest.mark.parametrize("size", [0, 1, 2, 3, 996, 997])
def test_medians(spark, values, size):
    rows, df = values
    some = spark.createDataFrame(rows[:size], df.schema)
    got = N.medians(some, {"hot": F.col("hot"), "few": F.col("few"), "none": F.lit(None).cast("double"), "a": F.when(~F.isnan("a"), F.col("a"))}).first()
    middle = lambda v: statistics.median(v) if v else None
    assert tuple(got) == (middle([r[2] for r in rows[:size]]), middle([r[3] for r in rows[:size]]), None, middle([r[1] for r in rows[:size] if r[1] is not None and not math.isnan(r[1])]))
    assert str(N.medians(some, {"a": F.col("a")}).first().a) == str(some.agg(F.median("a")).first()[0])


@pytest.mark.parametrize("n", [None, 997])
def test_numbers_and_lists(values, n):
    rows, df = values
    got = sorted((r.n, r.hot, r.key) for r in N.numbered_rows(df, [("hot", True), ("key", False)], "n", n).collect())
    want = sorted(((r[2], r[0]) for r in rows), key=lambda x: (-x[0], x[1] is None, x[1] or ""))
    assert [(h, k) for _, h, k in got] == want and [g[0] for g in got] == list(range(1, 998))
    top = N.listed(df, [("hot", True), ("key", False)], 20)
    assert [(r.Rank, r.hot, r.key) for r in top.orderBy("Rank").collect()] == [(i, *w) for i, w in enumerate(want[:20], 1)]
    assert N.listed(df.limit(0), [("hot", True)], 5).count() == 0


def test_no_task_has_all_rows(spark):
    """A large pool's plan has windows by range alone; counts of ties come before they are dealt."""
    df = spark.range(20000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 4000).alias("v"))
    plan = N.ranks(df, "key", {"r": (F.col("v"), True)}, 20000)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan


def test_measures_of_few_values_rank_rows_where_they_are(spark):
    df = spark.range(6000).selectExpr("id", "if(id % 9 = 0, null, id % 50) AS a", "if(id % 11 = 0, double('NaN'), double(id % 7)) AS b")
    out = N.ranks(df, "id", {"by_a": (F.col("a"), True), "by_b": (F.col("b"), False)})
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()  # rows aren't shuffled
    plain = N.ranks(df, "id", {"by_a": (F.col("a"), True), "by_b": (F.col("b"), False)}, n=1)
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_a_measure_of_many_values_is_joined_by_value(spark, monkeypatch):
    monkeypatch.setattr(N, "SENT", 10)
    df = spark.range(6000).selectExpr("if(id = 5, null, id) AS id", "id % 3000 AS a", "id % 4 AS b")
    of = {"by_a": (F.col("a"), True), "by_b": (F.col("b"), False)}
    assert sorted(map(str, N.ranks(df, "id", of).collect())) == sorted(map(str, N.ranks(df, "id", of, n=1).collect()))
