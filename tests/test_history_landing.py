import datetime as dt
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from boardwise.operators import history
from boardwise.operators import results as Q
from boardwise.sources import dataset, landing


def plain_fold(rows):
    """Rows (date, tid, seq, p1, p2, scratch, handicap) to (scratch after 1, handicap after 2, scratch pair), by (tid, seq)."""
    s, h, out = {}, {}, {}
    for key in sorted({(r[0], r[1]) for r in rows}):
        own = sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: r[2])
        full = [r for r in own if r[3] and r[4]]
        mean = lambda d: sum((d.get(r[3], 1200) + d.get(r[4], 1200)) / 2 for r in full) / len(full) if full else 1200.0  # noqa: B023,E731
        ms, mh = mean(s), mean(h)
        scale = lambda m: 1.0 if m >= 1200 else max(0.7, 1 + 0.15 * (m - 1200) / 6)
        step = lambda x, pct, m: x + 32 * scale(m) * (pct / 100 - 1 / (1 + 10 ** ((m - x) / 400)))
        show = lambda x: round(min(3500.0, max(0.0, 2 * x)), 1)
        for _, tid, seq, a, b, sp, hp in own:
            for p in (a, b):
                if p:
                    s[p] = step(s.get(p, 1200), sp, ms)
                    h[p] = step(h.get(p, 1200), sp if hp is None else hp, ms if hp is None else mh)
            out[tid, seq] = (show(s[a]) if a else None, show(h[b]) if b else None, show((s[a] + s[b]) / 2) if a and b else None)
    return out


@pytest.fixture(scope="module")
def results(spark):
    r = random.Random(1)
    rows = []
    for pool in range(3):
        for t in range(50):
            for seq in range(6):
                a, b = r.sample([f"{pool}-{i}" for i in range(12)], 2)
                rows.append((pool, f"2024-{1 + t // 25:02d}-{1 + t % 25 // 2:02d}T20", f"t{pool}-{t:02d}", seq, a, b if seq else None, r.uniform(30, 70), r.choice([None, r.uniform(30, 75)])))
    r.shuffle(rows)
    schema = "series_id int, date string, tournament_id string, row_seq int, player1_id string, player2_id string, scratch_percentage double, handicap_percentage double"
    return rows, spark.createDataFrame(rows, schema).repartition(5).withColumns({"player1_name": F.col("player1_id"), "player2_name": F.col("player2_id")})


def test_fold_equals_a_plain_loop(results):
    rows, df = results
    got = {(r.tournament_id, r.row_seq): (r.player1_scratch_elo_after, r.player2_handicap_elo_after, r.scratch_pair_elo) for r in history.fold(df, by=["series_id"]).collect()}
    want = {}
    for pool in range(3):
        want |= plain_fold([x[1:] for x in rows if x[0] == pool])
    assert got == want
    together = {(r.tournament_id, r.row_seq): r.player1_scratch_elo_after for r in history.fold(df).collect()}
    assert together == {k: v[0] for k, v in want.items()}  # pools share no player and no session


def test_fold_leaves_out_the_future_and_takes_a_start(spark, results):
    _, df = results
    early = history.fold(df, by=["series_id"], today="2024-01-03")
    assert early.agg(F.max("date")).first()[0] <= "2024-01-03T20"
    start = spark.createDataFrame([(0, "0-1", 1500.0, 1400.0)], "series_id int, player_id string, scratch double, handicap double")
    first = history.fold(df, by=["series_id"], initial=start).where("player1_id = '0-1'").orderBy("date", "tournament_id", "row_seq").first()
    assert first.player1_scratch_elo_before >= 2900 and first.player1_handicap_elo_before >= 2700


def test_fold_of_missing_values_and_repeated_rows(spark):
    schema = "date string, tournament_id string, row_seq int, player1_id string, player2_id string, percentage double, pe_bonus string, scratch_percentage double, handicap_percentage double, own int"
    rows = [
        ("2024-01-01", "t", 1, "a", "b", 60.0, "40", None, None, 1), ("2024-01-01", "t", 1, "a", "b", 60.0, "40", None, None, 1), (None, "u", 1, "c", "", None, "x", None, None, 2),
        ("2024-01-02", "v", 1, None, "a", 0.0, None, None, 61.0, 3), ("2024-01-02", "v", 2, "b", "c", 55.0, None, 44.0, None, 4),
    ]
    df = spark.createDataFrame(rows, schema)
    got = history.fold(df, today="2024-02-01").collect()
    assert sorted(r.own for r in got) == [1, 1, 2, 3, 4]
    assert {r.own: r.scratch_percentage for r in got} == {1: 56.0, 2: 50.0, 3: 50.0, 4: 44.0}
    twice = sorted(r.player1_scratch_elo_after for r in got if r.own == 1)
    assert 2400 < twice[0] < twice[1]  # each counts, on the rating after the other
    alone = next(r for r in got if r.own == 2)
    assert alone.scratch_pair_elo is None and alone.player1_scratch_elo_before == 2400.0 and alone.player2_scratch_elo_after is None
    start = spark.createDataFrame([("a", 1500.0, 1400.0)], "player_id string, scratch double, handicap double")
    assert max(r.player1_scratch_elo_before for r in history.fold(df, initial=start).collect() if r.own == 1) > 2990
    assert history.fold(df.limit(0)).count() == 0 and set(history.fold(df).columns) == {*df.columns, "club_percentage", "iv_bonus", *history.OUT}


def test_snapshot_and_standard_scale(results):
    _, df = results
    rated = history.fold(df, by=["series_id"])
    people = history.snapshot(rated)
    scaled, shown = history.standardized(rated, people)
    mean, sd = shown.agg(F.avg("scratch_elo"), F.stddev_pop("scratch_elo")).first()
    assert abs(mean - 1500) < 0.1 and abs(sd - 400) < 0.1 and scaled.columns == rated.columns
    assert people.agg(F.sum("games_played")).first()[0] == 2 * 900 - 150


def test_repeated_result_tables_give_one_summary(spark, results):
    _, df = results
    rated = history.fold(df, by=["series_id"]).withColumns({"iv_bonus": F.lit(0.0), "pair_id": F.concat_ws("_", "player1_id", "player2_id")})
    a, b = (sorted(map(str, Q.players(x).collect())) for x in (rated, rated.orderBy(F.rand(3))))
    assert a == b


PUBLIC = [
    {"rank": 1, "sessionScore": 66.3, "peBonus": 90, "simultaneousId": "05802079", "team": {"id": 7, "player1": {"id": 1, "migrationId": 11, "firstName": "A", "lastName": "B"}, "player2": {"id": 2, "migrationId": None, "firstName": "C", "lastName": None}}},
    {"sessionScore": None, "totalScore": "55.5", "peBonus": 0, "team": {"id": 8, "player1": {"id": 3}, "player2": {"id": 4}}},
    {"sessionScore": 1, "team": {"player1": {"id": 5}}},
]
PRIVATE = {"teams": [
    {"id": 1, "percent": 57.3, "PE_bonus": 90, "players": [{"id": 1, "firstname": "A", "lastname": "B"}, {"id": 2}], "organization": {"id": 9, "name": "Club", "code": "1"}},
    {"id": 2, "percent": "x", "players": [{"id": 3}, {"id": 4}]}, {"id": 3, "percent": 60, "percentWithoutHandicap": "51.5", "players": [{"id": 5}, {"id": 6}]}, {"id": 4, "players": [{"id": 7}]},
]}


def test_payloads(spark):
    raw = spark.createDataFrame([("t", 3, json.dumps(PUBLIC)), ("u", 386, json.dumps(PUBLIC[1:2])), ("v", 3, "no json")], "tournament_id string, series_id int, payload string")
    got = [(r.tournament_id, r.player1_id, r.player2_id, r.player2_name, round(r.scratch_percentage, 6), r.handicap_percentage, r.club_code) for r in landing.public_results(raw).orderBy("tournament_id", "row_seq").collect()]
    assert got == [("t", "11", "2", "C", 57.3, 66.3, "5802079"), ("t", "3", "4", "", 55.5, None, None), ("u", "3", "4", "", 55.5, 55.5, None)]
    raw = spark.createDataFrame([("t", 386, json.dumps(PRIVATE)), ("u", 3, json.dumps(PRIVATE))], "tournament_id string, series_id int, payload string")
    got = [(r.tournament_id, round(r.scratch_percentage, 6), r.handicap_percentage) for r in landing.private_results(raw).orderBy("tournament_id", "row_seq").collect()]
    assert got == [("t", 57.3, 66.3), ("t", 0.0, 0.0), ("t", 51.5, 60.0), ("u", 48.3, 57.3), ("u", 0.0, None), ("u", 51.5, 60.0)]


def test_sidecars_datasets_and_boards(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"player": {"prior_anchor": 1510.0}, "pair": {"prior_anchor": "x"}}')
    assert [landing.anchor(spark, str(tmp_path / f), k) for f, k in (("a.json", "player"), ("a.json", "pair"), ("a.json", "other"), ("none.json", "player"))] == [1510.0, None, None, None]
    now, path = dt.datetime(2024, 5, 2, 12), f"{tmp_path}/set"
    listed = spark.createDataFrame([("a", "2024-05-01"), ("b", "2024-06-01")], "tournament_id string, date string")
    assert dataset.needs_rebuild(spark, path, "k", listed, now)
    dataset.write_whole(spark.createDataFrame([("a",)], "tournament_id string"), spark.createDataFrame([("p",)], "player_id string"), path, "k", now)
    assert not dataset.needs_rebuild(spark, path, "k", listed, now) and dataset.needs_rebuild(spark, path, "k", listed, now + dt.timedelta(hours=21))
    assert dataset.needs_rebuild(spark, path, "k", listed.union(spark.createDataFrame([("c", "2024-05-01")], listed.schema)), now)
    spark.createDataFrame([("2024-01-02T00:00:00", 5, 1)], "Date string, session_id long, extra int").write.parquet(f"{tmp_path}/boards")
    b = landing.boards(spark, f"{tmp_path}/boards", ["Date", "session_id", "absent"])
    assert b.dtypes == [("Date", "timestamp_ntz"), ("session_id", "string")] and b.first().session_id == "5"


def test_build_job(spark, tmp_path):
    from boardwise.plans import build

    spark.createDataFrame([("t", 3, json.dumps(PUBLIC)), ("u", 386, json.dumps(PUBLIC[:2])), ("late", 3, json.dumps(PUBLIC))], "tournament_id string, series_id int, payload string").write.parquet(f"{tmp_path}/in/payloads.parquet")
    spark.createDataFrame([("t", "2024-05-01", "One"), ("u", "2024-05-02", "Two"), ("late", "2024-06-01", "Later")], "tournament_id string, date string, tournament_name string").write.parquet(f"{tmp_path}/in/sessions.parquet")
    args = ["--landing", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--if-stale", "--now", "2024-05-03T12:00:00"]
    assert build.main(args, spark) and not build.main(args, spark)
    rows = dataset.read(spark, f"{tmp_path}/out", "public", "results").orderBy("date", "row_seq").collect()
    assert [(r.tournament_id, r.pair_id, r.pair_name) for r in rows] == [("t", "11_2", "A B - C"), ("t", "3_4", " - "), ("u", "11_2", "A B - C"), ("u", "3_4", " - ")]
    people = {r.player_id: r for r in dataset.read(spark, f"{tmp_path}/out", "public", "players").collect()}
    assert people["11"].games_played == 2 and people["11"].scratch_elo == people["2"].scratch_elo > 1500 > people["3"].scratch_elo - 1000
    values = spark.createDataFrame([("11", 60.0), ("2", 40.0)], "player_id string, iv double")
    got = build.with_player_values(dataset.read(spark, f"{tmp_path}/out", "public", "results").select("player1_id", "player2_id"), values).collect()
    assert sorted(str(r.pair_iv) for r in got) == ["100.0", "100.0", "None", "None"]
    spark.createDataFrame([("5802079", "Club A")], "code string, label string").write.parquet(f"{tmp_path}/in/clubs.parquet")
    values.write.parquet(f"{tmp_path}/in/values.parquet")
    for day in (4, 5, 6):
        assert build.main([*args[:4], "--now", f"2024-05-0{day}T12:00:00", "--limit", "3"], spark)
    got = dataset.read(spark, f"{tmp_path}/out", "public-values", "results").where("tournament_id = 't'").orderBy("row_seq").collect()
    assert [(r.club_name, r.pair_iv) for r in got] == [("Club A", 100.0), (None, None)]
    kept = [p.name for p in (tmp_path / "out" / "public-values" / "meta").iterdir() if p.suffix == ".json"]
    assert sorted(p.name for p in (tmp_path / "out" / "public-values").iterdir() if p.name.startswith("v")) == sorted(x[:-5] for x in kept) and len(kept) <= 3


def test_envelopes_and_reports_of_files(spark, tmp_path):
    from boardwise.plans import build, report, views
    from boardwise.plans.params import Report

    now = dt.datetime(2024, 5, 3, 12)
    (tmp_path / "in" / "envelopes").mkdir(parents=True)
    for k, (age, data) in enumerate([(5, PUBLIC[:1]), (1, PUBLIC[1:2]), (90, PUBLIC)]):
        (tmp_path / "in" / "envelopes" / f"{k}.json").write_text(json.dumps({"timestamp": now.timestamp() - 3600 * age, "identifier": "old" if k == 2 else "t", "series_id": 3, "data": json.dumps(data)}))
    spark.createDataFrame([("t", "2024-05-01", "One"), ("old", "2024-05-01", "Two")], "tournament_id string, date string, tournament_name string").write.parquet(f"{tmp_path}/in/sessions.parquet")
    raw, _ = build.landed(spark, f"{tmp_path}/in", now, 24, None)
    assert [(r.tournament_id, json.loads(r.payload)) for r in raw.collect()] == [("t", PUBLIC[1:2])]
    b = views.boards(spark, "/root/testdata/sf0.001")
    b.where("strata_bucket <> 'open'").write.parquet(f"{tmp_path}/club")
    b.where("strata_bucket = 'open'").write.parquet(f"{tmp_path}/tournament")
    (tmp_path / "club.json").write_text('{"player": {"prior_anchor": 1400.0}}')
    p = Report(top_n=20, min_sessions=3, min_skill_z=-95, strata="All")
    paths = {e: f"{tmp_path}/{e}" for e in ("club", "tournament")}
    got, plain = (report.report_of_files(spark, paths, p, x) for x in (str(tmp_path), None))
    want = report.report(spark.read.parquet(paths["club"]), p, 1400.0, spark.read.parquet(paths["tournament"]))
    assert got.collect() == want.collect() != plain.collect() and "Tournament_Elo" in got.columns
    files = landing.BoardFiles(f"file://{tmp_path}/", "{event}", (("fs.file.impl.disable.cache", "true"),))
    assert report.report_of_files(spark, files, p, str(tmp_path)).collect() == want.collect()
    assert files.schema(spark, "Club") == spark.read.parquet(paths["club"]).schema and files.boards(spark, "club", ["Date", "absent"]).columns == ["Date"]
    with pytest.raises(FileNotFoundError):
        files.schema(spark, "none")


def test_pages_of_session_lists(spark, tmp_path):
    page = lambda ids, more: json.dumps({"items": [{"id": i, "date": "2024-05-01", "label": f"L{i}"} for i in ids], "pagination": {"has_next_page": more}})
    rows = [
        (5.0, 1, 1, page([1, 2], True)), (9.0, 1, 1, page([1, 2, 3], True)), (5.0, 1, 2, page([4], False)), (5.0, 1, 3, page([5], True)),  # page 2 is the last
        (5.0, 2, 1, page([6], True)), (5.0, 2, 3, page([7], False)), (5.0, 3, 2, page([8], False)),  # a page is missing
        (5.0, 4, 1, json.dumps([{"id": 9, "date": None, "name": "N"}, {"date": "x"}])), (5.0, 5, 1, page([10], True)), (5.0, 5, 2, "error"), (5.0, 5, 3, page([11], True)), (5.0, None, 1, page([12], False)),
    ]
    df = spark.createDataFrame(rows, "timestamp double, series_id int, page int, data string")
    ids = lambda x: sorted((int(r.tournament_id), r.series_id or 0) for r in x.collect())
    want = [(1, 1), (2, 1), (3, 1), (4, 1), (6, 2), (9, 4), (10, 5), (12, 0)]
    assert ids(landing.sessions_of_pages(df)) == want and ids(landing.sessions_of_pages(df, limit=1)) == [(1, 1), (6, 2), (9, 4), (10, 5), (12, 0)]
    young = landing.sessions_of_pages(df, max_age_hours=1, now=dt.datetime.fromtimestamp(3600 + 7))
    assert ids(young) == [(1, 1), (2, 1), (3, 1), (6, 2), (9, 4), (10, 5), (12, 0)]  # of series 1 one page is young; others have old ones alone
    names = {r.tournament_id: (r.date, r.tournament_name) for r in landing.sessions_of_pages(df).collect()}
    assert names["4"] == ("2024-05-01", "L4") and names["9"] == (None, "N") and landing.sessions_of_pages(df.limit(0)).count() == 0
    from boardwise.plans import build

    (tmp_path / "pages").mkdir()
    for k, (t, series, number, data) in enumerate(rows):
        (tmp_path / "pages" / f"{k}.json").write_text(json.dumps({"timestamp": t, "series_id": series, "page": number, "data": data}))
    spark.createDataFrame([("1", 3, "[]")], "tournament_id string, series_id int, payload string").write.parquet(f"{tmp_path}/payloads.parquet")
    assert sorted(int(r.tournament_id) for r in build.landed(spark, str(tmp_path), dt.datetime(2024, 5, 3), None, None)[1].collect()) == [i for i, _ in want]


def largest_task(df):
    """Rows that the task with most of them has."""
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_no_task_of_a_fold_sorts_a_pool_of_whole_rows(spark):
    df = history.with_percentages(spark.range(3000).selectExpr("'2024-01-' || lpad(id % 28 + 1, 2, '0') AS date", "'t' || id % 56 AS tournament_id", "id AS row_seq", "'a' || id % 11 AS player1_id", "nullif('b' || id % 7, 'b3') AS player2_id", "double(id % 60 + 20) AS scratch_percentage", "if(id % 3 = 0, null, double(id % 50 + 30)) AS handicap_percentage"))
    assert largest_task(history._stream(df, [], "row_seq", None)) < 1500
    packs = history._packs(df, [], "row_seq")
    assert packs.count() < 3000 / 20 and packs.selectExpr("sum(size(a))", "max(size(a))").first() == (3000, 54)
    rows = [(r.date, r.tournament_id, r.row_seq, r.player1_id, r.player2_id, r.scratch_percentage, r.handicap_percentage) for r in df.collect()]
    got = {(r.tournament_id, r.row_seq): (r.player1_scratch_elo_after, r.player2_handicap_elo_after, r.scratch_pair_elo) for r in history.fold(df).collect()}
    assert got == plain_fold(rows)


def test_packs_and_batches_that_end_within_a_session(spark, monkeypatch):
    rows = [(f"2024-01-0{1 + k // 400}", f"t{k // 400}", k, f"p{k % 9}", None if k % 13 == 0 else f"q{k % 8}", float(k % 60 + 20), None if k % 3 else float(k % 50 + 30)) for k in range(1200)]
    df = spark.createDataFrame(rows, "date string, tournament_id string, row_seq int, player1_id string, player2_id string, scratch_percentage double, handicap_percentage double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rated = history.fold(df, trace=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.tournament_id, r.row_seq): (r.player1_scratch_elo_after, r.player2_handicap_elo_after, r.scratch_pair_elo) for r in rated} == plain_fold(rows)
    assert {r.row_seq: r.fold_seq for r in rated} == {k: k for k in range(1200)}


def test_a_snapshot_aggregates_by_hash_before_it_sorts(spark):
    schema = "date string, tournament_id string, row_seq int, player1_id string, player1_name string, player2_id string, player2_name string, scratch_percentage double, player1_scratch_elo_after double, player2_scratch_elo_after double"
    rows = [
        ("2024-01-02", "t", 2, "a", "A", "b", "B", 40.0, 1.0, 2.0), ("2024-01-02", "t", 7, "b", None, "a", "A2", 50.0, 3.0, 4.0), (None, "z", 9, "a", "old", "", "", 60.0, 5.0, None),
        ("2024-01-02", "t", None, "c", "C", "c", "C2", 70.0, 6.0, 7.0), ("2024-01-02", "s", 99, "b", "x", None, None, 30.0, 8.0, None),
    ]
    df = spark.createDataFrame(rows, schema).withColumns({f"player{i}_handicap_elo_after": F.col(f"player{i}_scratch_elo_after") + 100 for i in (1, 2)})
    people = history.snapshot(df)
    got = {r.player_id: (r.player_name, r.scratch_elo, r.handicap_elo, r.games_played, r.avg_percentage) for r in people.collect()}
    assert got == {"a": ("A2", 4.0, 104.0, 3, 50.0), "b": (None, 3.0, 103.0, 3, 40.0), "c": ("C2", 7.0, 107.0, 2, 70.0)}
    assert {r.player_id: r.stdev_percentage for r in people.collect()} == pytest.approx({"a": 10.0, "b": 10.0, "c": 0.0})
    assert re.findall(r"(\w+)Aggregate\(", people._jdf.queryExecution().executedPlan().toString())[-1] == "Hash"


def test_a_large_session_is_rated_in_chunks_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(history, "PACK", 8)
    monkeypatch.setattr(history, "CHUNK", 40)
    monkeypatch.setattr(history, "TASK_ROWS", 300)
    n = 1500
    place = lambda k: None if k < 300 else 7 if k < 500 else k
    odd = [(None if k < 1400 else "2024-01-02", f"t{k // 1400}", place(k), f"p{k * 7 % 90:02d}", None if k % 13 == 0 else f"q{k % 80:02d}", float(k % 60 + 20), None if k % 3 else float(k % 50 + 30), k) for k in range(n)]
    schema = "date string, tournament_id string, row_seq int, player1_id string, player2_id string, scratch_percentage double, handicap_percentage double, own int"
    df = history.with_percentages(spark.createDataFrame(odd, schema).repartition(3))
    assert largest_task(history._packs(df, [], "row_seq", n)) < 60 and largest_task(history._stream(df, [], "row_seq", history._starts(df, [], "row_seq", None, n), n)) < 600
    low = lambda x: (x is not None, x or "")
    order = lambda r: (low(r[0]), r[1], (r[2] is not None, r[2] or 0), r[3], low(r[4]), r[5], (r[6] is not None, r[6] or 0.0))
    ordered = sorted(odd, key=order)
    want = plain_fold([(r[0] or "", r[1], k, *r[3:7]) for k, r in enumerate(ordered)])
    got = {r.own: r for r in history.fold(df, trace=True).collect()}
    assert len(got) == n and sorted(r.fold_seq for r in got.values()) == list(range(n))
    shown = lambda r: (r.player1_scratch_elo_after, r.player2_handicap_elo_after, r.scratch_pair_elo)
    values = lambda r: r[:7]
    for key, same in itertools.groupby(enumerate(ordered), key=lambda x: values(x[1])):
        same = list(same)
        assert sorted(map(str, (shown(got[r[7]]) for _, r in same))) == sorted(str(want[r[1], k]) for k, r in same), key
