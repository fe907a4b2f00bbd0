import datetime as dt

import pytest
from pyspark.sql import functions as F

from boardwise.plans import report, views
from boardwise.plans.params import Report
from boardwise.sources import store

SF = "/root/testdata/sf0.001"
PLAIN = dict(top_n=50, min_sessions=2, min_skill_z=-95, strata="All")


@pytest.fixture(scope="module")
def boards(spark):
    return views.boards(spark, SF).where("event_id % 40 <> 7 or Date is null")


@pytest.fixture(scope="module")
def laid(spark, boards, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    odd = boards.limit(3).withColumns({"Date": F.lit(None).cast("timestamp_ntz"), "event_id": F.col("event_id") + 10**6})
    store.write_store(boards.unionByName(odd), path, 4)
    return store.Store(spark, path, 4), boards.unionByName(odd)


def rows(df):
    return sorted((str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect()))


@pytest.mark.parametrize(
    "p",
    [
        Report(**PLAIN), Report(entity="Pairs", **PLAIN), Report(**PLAIN | {"method": "Max", "mode": "Local Only"}), Report(**PLAIN | {"entity": "Pairs", "method": "Avg", "mode": "Online Only"}),
        Report(**PLAIN | {"date_from": dt.datetime(2024, 1, 9), "strata": "0-299"}), Report(**PLAIN | {"date_from": dt.datetime(2024, 1, 9, 13, 5), "moment": "Rating at Start of Session"}),
        Report(**PLAIN | {"entity": "Pairs", "date_from": dt.datetime(2024, 1, 20, 7, 30), "strata": "0-749"}), Report(**PLAIN | {"date_from": dt.datetime(2030, 1, 1)}),
    ],
    ids=range(8),
)
def test_merged_parts_give_the_boards_report(laid, p):
    own, boards = laid
    assert rows(own.report(p, 1400.0)) == rows(report.report(boards, p, 1400.0))


def test_crossover_and_details(laid):
    own, boards = laid
    for p in (Report(**PLAIN), Report(**PLAIN | {"entity": "Pairs", "method": "Max"})):
        assert rows(own.report(p, 1400.0, own, 1400.0)) == rows(report.report(boards, p, 1400.0, boards, 1400.0))
    for p, ids in ((Report(**PLAIN | {"mode": "Local Only"}), {"player": "p3"}), (Report(**PLAIN | {"entity": "Pairs", "date_from": dt.datetime(2024, 1, 5, 3)}), {"pair": "p24-p3"}), (Report(**PLAIN), {"player": "nobody"})):
        assert rows(own.detail(p, **ids)) == rows(report.detail(boards, p, **ids))
    with pytest.raises(ValueError):
        own.detail(Report(**PLAIN))
    with pytest.raises(ValueError):
        own.report(Report(**PLAIN | {"moment": "Rating at Event End"}))


def read(df):
    """What a DataFrame's scans list: their folders, and the filters that choose among them and within files."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "FileScan" in line]


def test_scans_are_pruned(laid):
    own, _ = laid
    scans = read(own.of_player("p3"))
    assert len(scans) == 1 and "PartitionFilters: [isnotnull(bucket" in scans[0] and "EqualTo(player,p3)" in scans[0]
    assert len(set(own.of_player("p3").select(F.input_file_name()).distinct().rdd.map(lambda r: r[0].split("/bucket=")[1][0]).collect())) == 1
    days = own.boards(dt.datetime(2024, 1, 20)).select(F.input_file_name().alias("f")).distinct().collect()
    assert days and min(r.f.split("/day=")[1][:10] for r in days) == "2024-01-20"
    p = Report(**PLAIN | {"date_from": dt.datetime(2024, 1, 9)})
    leader = own._pool_parts(p)
    assert all("/parts/" in f for f in leader.inputFiles())  # boards aren't read
    edge = own._pool_parts(Report(**PLAIN | {"date_from": dt.datetime(2024, 1, 9, 12)}))
    assert "PartitionFilters: [isnotnull(day" in [x for x in read(edge) if "Player_ID_N" in x][0]


def test_the_layout_deals_as_many_tasks_as_it_has_rows_for_and_hashes_groups(spark, boards, tmp_path, monkeypatch):
    key, seen, parts = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", [], store.states.player_parts
    monkeypatch.setattr(store, "SORTED_ROWS", 200)
    monkeypatch.setattr(store.states, "player_parts", lambda *a: (seen.append(spark.conf.get(key)), parts(*a))[1])
    before = spark.conf.get(key)
    store.write_store(boards, str(tmp_path), 2)
    files = spark.read.parquet(f"{tmp_path}/seats").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 10  # 4 shuffle partitions and 2 buckets gave 6 at most
    assert seen and set(seen) == {str(store.GROUPS)} and spark.conf.get(key) == before
    assert spark.read.parquet(f"{tmp_path}/boards").count() == boards.count()


def test_a_report_has_laid_out_what_it_reads_alone(spark, boards, tmp_path):
    path, p = str(tmp_path), Report(**PLAIN | {"date_from": dt.datetime(2024, 1, 9, 13, 5)})
    own = store.Store(spark, path, 2)
    made = lambda: {str(x.relative_to(tmp_path).parent) for x in tmp_path.rglob("_SUCCESS")}
    store.write_boards(boards, path)
    store.write_for(p, spark, path, 2)
    assert made() == {"boards", "parts/moment=0/players"}  # neither a copy by player nor other parts, which it doesn't read
    assert rows(own.report(p, 1400.0)) == rows(report.report(boards, p, 1400.0))
    pairs = Report(**PLAIN | {"entity": "Pairs", "moment": "Rating at Start of Session"})
    store.write_for(pairs, spark, path, 2, detail=True)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    assert made() == {"boards", "parts/moment=0/players", "seats", "parts/moment=1/pairs_scale"}
    assert rows(own.detail(pairs, pair="p24-p3")) == rows(report.detail(boards, pairs, pair="p24-p3"))
    store.write_for(p, spark, path, 2)
    store.write_for(pairs, spark, path, 2, detail=True)
    assert {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")} == before
