import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boardwise.operators import components, history
from boardwise.sources import dataset

from .test_history_landing import plain_fold

SCHEMA = "series_id int, date string, tournament_id string, row_seq int, player1_id string, player2_id string, scratch_percentage double, handicap_percentage double"
NOW = dt.datetime(2024, 5, 1, 12)


def sessions(seed=1, days=14, clubs=6, pools=(0, 1, None)):
    """Rows of several sessions a day in each pool; most players stay in their club, a few visit others."""
    r, rows = random.Random(seed), []
    for pool in pools:
        for d in range(days):
            for club in range(clubs):
                names = [f"{pool}-{club}-{i}" for i in range(8)] + ([f"{pool}-{(club + 1) % clubs}-0"] if d % 5 == 4 else [])
                for seq in range(4):
                    a, b = r.sample(names, 2)
                    rows.append((pool, f"2024-01-{1 + d:02d}T20", f"t{pool}-{d:02d}-{club}", seq, a, b if r.random() < 0.95 else None, r.uniform(30, 70), r.choice([None, r.uniform(30, 75)])))
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"player1_name": F.concat(F.lit("N "), "player1_id"), "player2_name": F.col("player2_id")})


def rated(df):
    names = ["series_id", "date", "tournament_id", "row_seq", "player1_id", *history.OUT]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def full(spark, rows, **more):
    return rated(history.fold(frame(spark, rows), by=["series_id"], **more))


def test_components_are_those_of_a_search(spark):
    r = random.Random(4)
    pairs = [(r.randrange(400), r.randrange(500)) for _ in range(420)] + [(1000 + i, 1000 + i // 2 * 2 + k) for i in range(20) for k in (0, 2)]
    near = {}
    for s, p in pairs:
        near.setdefault(("s", s), set()).add(("p", p))
        near.setdefault(("p", p), set()).add(("s", s))
    want = {}
    for start in sorted(k for k in near if k[0] == "s"):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start[1]
                todo += near[x]
    got = components.components(spark.createDataFrame(pairs, "s long, p long"))
    assert {r.s: r.label for r in got.collect()} == {k[1]: v for k, v in want.items() if k[0] == "s"}
    assert components.components(spark.createDataFrame([], "s long, p long")).count() == 0


@pytest.mark.parametrize("window_rows", [1, 10**9])
def test_windows_of_unconnected_sessions_equal_the_plain_fold(spark, tmp_path, monkeypatch, window_rows):
    monkeypatch.setattr(history, "FEW_ROWS", 0)
    rows = sessions(days=4)
    history.fold_windows(history.with_percentages(frame(spark, rows)), f"{tmp_path}/f", ["series_id"], window_rows=window_rows)
    got = spark.read.parquet(f"{tmp_path}/f/results")
    assert rated(got) == full(spark, rows)
    plain = plain_fold([x[1:] for x in rows if x[0] == 0])
    assert {(r.tournament_id, r.row_seq): (r.player1_scratch_elo_after, r.player2_handicap_elo_after, r.scratch_pair_elo) for r in got.where("series_id = 0").collect()} == plain
    assert not (tmp_path / "f" / "input").exists()


def test_few_rows_are_one_window_whatever_their_days(spark, tmp_path):
    rows = sessions(days=3, clubs=2)
    named = frame(spark, rows).withColumn("player2_name", F.when(F.col("row_seq") > 1, F.col("player2_name")))
    history.fold_windows(history.with_percentages(named), f"{tmp_path}/f", ["series_id"], window_rows=1)
    assert [p.name for p in (tmp_path / "f" / "results").iterdir()] == ["window=0"]  # days don't wait for each other's jobs
    got = spark.read.parquet(f"{tmp_path}/f/results")
    assert rated(got) == full(spark, rows)
    want = {}
    for r in sorted(got.collect(), key=lambda r: r.fold_seq):
        for i in (1, 2):
            if p := r[f"player{i}_id"]:
                games = want.get((r.series_id, r.fold_day, p), [()])[-1]
                want[r.series_id, r.fold_day, p] = [r[f"player{i}_scratch_raw"], r[f"player{i}_handicap_elo_after"], r[f"player{i}_name"], (*games, r.scratch_percentage)]
    states = spark.read.parquet(f"{tmp_path}/f/states").collect()
    assert {(r.series_id, r.day, r.player_id): [r.scratch, r.handicap_elo, r.player_name, r.games] for r in states} == {k: [*v[:3], len(v[3])] for k, v in want.items()}
    for r in states:
        games = want[r.series_id, r.day, r.player_id][3]
        mean = sum(games) / len(games)
        assert (r.n, r["mean"], r.m2) == pytest.approx((len(games), mean, sum((x - mean) ** 2 for x in games)), abs=1e-8)


def test_a_day_of_one_pool_is_folded_by_several_tasks(spark):
    df = frame(spark, sessions(days=4, pools=(0,)))
    own = history.coupled(df.where("date < '2024-01-05'"))
    assert own.select("coupled").distinct().count() == 6  # clubs that nobody visited yet
    stream = history._stream(history.with_percentages(own), ["coupled"], "row_seq", None)
    assert stream.groupBy(F.spark_partition_id()).count().count() > 1


def test_windows_hold_about_as_many_rows():
    days = [(f"2024-01-{d:02d}", n) for d, n in enumerate([5, 5, 5, 40, 1, 1, 30], 1)]
    assert history.windows(days[::-1], 12) == [("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-03"), ("2024-01-04", "2024-01-04"), ("2024-01-05", "2024-01-06"), ("2024-01-07", "2024-01-07")]


def changed(rows, day, how):
    if how == "late":
        return rows + [(0, f"2024-01-{day:02d}T09", "late", 0, "0-1-1", "0-2-1", 61.0, None)]
    if how == "changed":
        return [x[:6] + (x[6] + 1,) + x[7:] if x[1][8:10] == f"{day:02d}" and x[2].endswith("-3") else x for x in rows]
    return [x for x in rows if not (x[1][8:10] == f"{day:02d}" and x[2].endswith("-3"))]


@pytest.mark.parametrize("how", ["late", "changed", "gone"])
def test_builds_go_on_from_the_first_day_that_differs(spark, tmp_path, monkeypatch, how):
    read, fold = [], history.fold
    monkeypatch.setattr(history, "FEW_ROWS", 0 if how == "late" else 10**6)
    monkeypatch.setattr(history, "fold", lambda r, *a, **k: (read.append(r.agg(F.count(F.lit(1)), F.min("date")).first()), fold(r, *a, **k))[1])
    rows, path = sessions(), str(tmp_path)
    build = lambda x, hour, **k: dataset.extend(frame(spark, x), path, "k", NOW + dt.timedelta(hours=hour), ["series_id"], window_rows=600, **k)
    early = [x for x in rows if x[1] < "2024-01-11"]
    v, start = build(early, 0)
    assert start is None and sum(n for n, _ in read) == len(early) and rated(dataset.folded(spark, v)) == full(spark, early)
    read.clear()
    v, start = build(rows, 1)
    assert start == "2024-01-11" and sum(n for n, _ in read) == len([x for x in rows if x[1] >= "2024-01-11"]) and min(d for _, d in read) >= "2024-01-11"
    assert rated(dataset.folded(spark, v)) == full(spark, rows)
    read.clear()
    other = changed(rows, 6, how)
    v, start = build(other, 2)
    assert start == "2024-01-06" and len(v.parts) == 2 and sum(n for n, _ in read) == len([x for x in other if x[1] >= "2024-01-06"])
    assert rated(dataset.folded(spark, v)) == full(spark, other)
    people = {r.player_id: r for r in spark.read.parquet(f"{v.folder}/players").collect()}
    for r in history.snapshot(fold(frame(spark, other), by=["series_id"])).collect():
        got = people[r.player_id]
        assert (got.player_name, got.scratch_elo, got.handicap_elo, got.games_played) == (r.player_name, r.scratch_elo, r.handicap_elo, r.games_played)
        assert got.avg_percentage == pytest.approx(r.avg_percentage, abs=1e-9) and got.stdev_percentage == pytest.approx(r.stdev_percentage, abs=1e-9)
    if how != "late":
        return
    read.clear()
    same, start = build(other, 3)
    assert start is None and not read and same.parts == v.parts
    later, start = build(other, 4, options="other")
    assert start is None and sum(n for n, _ in read) == len(other) and len(later.parts) == 1
    shown = dataset.read(spark, path, "k", "players").agg(F.avg("scratch_elo"), F.stddev_pop("scratch_elo")).first()
    assert shown[0] == pytest.approx(1500, abs=0.1) and shown[1] == pytest.approx(400, abs=0.1)
    assert dataset.read(spark, path, "k", "results").count() == len(other)


def test_initial_ratings_and_short_chains(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dataset, "PARTS", 2)
    rows, path = sessions(days=5, clubs=2, pools=(0,)), str(tmp_path)
    initial = spark.createDataFrame([(0, "0-1-1", 1500.0, 1400.0), (0, "late", 1000.0, 1000.0)], "series_id int, player_id string, scratch double, handicap double")
    for d in range(1, 6):
        own = [x for x in rows if x[1] < f"2024-01-{d + 1:02d}"] + [(0, f"2024-01-{d:02d}T21", "z", 0, "late", "0-0-1", 40.0, None)] * (d == 4)
        v, _ = dataset.extend(frame(spark, own), path, "k", NOW, ["series_id"], initial=initial)
        assert len(v.parts) <= 3 and rated(dataset.folded(spark, v)) == full(spark, own, initial=initial)
    dataset.prune(spark, path, "k", 1)
    assert rated(dataset.folded(spark, dataset.current(spark, path, "k"))) == full(spark, own, initial=initial)


def test_prune_leaves_what_is_not_its_own(spark, tmp_path):
    one, path = spark.createDataFrame([("a",)], "tournament_id string"), str(tmp_path)
    for k in range(4):
        dataset.write_whole(one, one, path, "k", NOW + dt.timedelta(hours=k))
    other = dataset.write_whole(one, one, path, "other", NOW)
    running = dataset.claim(spark, path, "k", NOW - dt.timedelta(hours=9))
    one.write.parquet(f"{path}/k/{running}/results")
    foreign = ["values.parquet", "v2", "version-notes", "v20240101T000000000000"]
    for f in foreign:
        one.write.parquet(f"{path}/k/{f}")
        one.write.parquet(f"{path}/{f}")
    gone = dataset.prune(spark, path, "k", 2)
    assert gone == ["v20240501T120000000000", "v20240501T130000000000"] and dataset.prune(spark, path, "k", 2) == []
    assert {p.name for p in Path(path, "k").iterdir()} == {"claims", "meta", running, *foreign, "v20240501T140000000000", "v20240501T150000000000"}
    assert {p.name for p in Path(path).iterdir()} == {"k", "other", *foreign} and dataset.read(spark, path, "other", "results").count() == 1
    assert other.name == "v20240501T120000000000"


def test_the_last_of_builds_at_one_time_is_the_newest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dataset.random, "randint", lambda a, b, steps=iter([900, 5, 7, 3]): next(steps))
    one, path = spark.createDataFrame([("a",)], "tournament_id string"), str(tmp_path)
    for _ in range(4):
        last = dataset.write_whole(one, one, path, "k", NOW)
        assert dataset.current(spark, path, "k").name == last.name
    assert dataset.prune(spark, path, "k", 1) == ["v20240501T120000000000", "v20240501T120000000900", "v20240501T120000000905"]
    assert dataset.write_whole(one, one, path, "k", NOW).name == dataset.current(spark, path, "k").name > last.name


def test_builds_at_the_same_time_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path, rows = str(tmp_path), sessions(days=3, clubs=2)
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda k: dataset.extend(frame(spark, rows[: len(rows) - k]), path, "k", NOW, ["series_id"])[0], range(4)))
    assert len({v.name for v in made}) == 4 == len(dataset.versions(spark, path, "k"))
    for k, v in enumerate(made):
        assert rated(dataset.folded(spark, v)) == full(spark, rows[: len(rows) - k])


def test_older_datasets_are_read_until_the_key_has_one(spark, tmp_path):
    one, path = spark.createDataFrame([("old", "2024-04-30")], "tournament_id string, date string"), str(tmp_path)
    one.write.parquet(f"{path}/v20240430T120000000000/results")
    Path(path, "meta").mkdir(exist_ok=True)
    Path(path, "meta", "part.json").write_text('{"built_at":"2024-05-01T10:00:00","version":"v20240430T120000000000"}\n')
    assert dataset.read(spark, path, "public", "results").first().tournament_id == "old" and dataset.current(spark, path, "public", ()) is None
    assert not dataset.needs_rebuild(spark, path, "public", one, NOW)
    dataset.write_whole(one.where("false"), one, path, "private", NOW)
    assert dataset.read(spark, path, "public", "results", ("private", None)).count() == 0
    dataset.write_whole(one.selectExpr("'new' AS tournament_id", "date"), one, path, "public", NOW)
    assert dataset.read(spark, path, "public", "results", ("private", None)).first().tournament_id == "new"
