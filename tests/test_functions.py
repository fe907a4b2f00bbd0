import datetime as dt

import pytest
from pyspark.sql import functions as F

from boardwise.functions import ratings as R
from boardwise.functions import text as T
from boardwise.operators import aggregates as A
from boardwise.operators import filters
from boardwise.plans.params import Report, coerced
from boardwise.plans.report import ad_hoc


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_titles_scales_and_steps(spark):
    x = [(2600.0,), (2599.0,), (2400.0,), (2300.0,), (2200.0,), (2000.0,), (1800.0,), (1600.0,), (1400.0,), (1399.0,), (None,)]
    names = ["SGM", "GM", "IM", "FM", "CM", "Expert", "Advanced", "Intermediate", "Novice", "Beginner", "Beginner"]
    assert [r[0] for r in values(spark, x, "x double", R.title(F.col("x")))] == names
    assert values(spark, [(1200.0,), (1400.0,), (2000.0,), (-5.0,)], "x double", R.doubled_scale(F.col("x"))) == [(2400.0,), (2800.0,), (3500.0,), (0.0,)]
    assert values(spark, [(1200.0,), (1194.0,), (1188.0,), (float("nan"),), (1100.0,)], "x double", F.round(R.strength_scale(F.col("x")), 9)) == [(1.0,), (0.85,), (0.7,), (1.0,), (0.7,)]
    assert values(spark, [(1200.0, 1200.0)], "a double, b double", R.expected_score(F.col("a"), F.col("b")), R.elo_step(F.col("a"), F.lit(60.0), F.col("b"), F.lit(1.0))) == [(0.5, pytest.approx(1203.2))]
    assert values(spark, [(10, 2000.0)], "n int, x double", R.to_int(R.shrunk(F.col("x"), F.col("n"), 1500.0, 50)), R.shrunk(F.col("x"), F.col("n"), 1500.0, 0)) == [(1583, 2000.0)]
    z = R.zscore_chess(F.col("x"), F.lit(0.0), F.col("s"))
    assert values(spark, [(0.0, 1.0), (2.75, 1.0), (5.0, 0.0), (99.0, 1.0), (None, 1.0)], "x double, s double", z) == [(1500.0,), (2600.0,), (1500.0,), (3500.0,), (0.0,)]


def test_rounding_is_that_of_scaled_binary_values(spark):
    assert values(spark, [(154.105,), (130.515,), (65.115,)], "x double", R.fixed_round(F.col("x"), 2)) == [(154.1,), (130.51,), (65.11,)]
    assert values(spark, [(2.5,), (3.5,), (2.7,)], "x double", R.to_int(F.col("x"))) == [(2,), (4,), (3,)]


def test_pair_ids_go_by_text(spark):
    out = values(spark, [("9", "10"), ("a", None)], "a string, b string", R.pair_id(F.col("a"), F.col("b")), R.pair_id(F.col("a"), F.col("b"), "_"))
    assert out == [("10-9", "10_9"), (None, None)]
    assert values(spark, [(2450.0, 1700.0), (None, 2600.0)], "a double, b double", R.lower_title(F.col("a"), F.col("b"))) == [("Intermediate",), ("Beginner",)]


def test_strata(spark):
    club = {"MP Limits: 1,500/750": "0-1500", "MP Limits: None/300": "open", None: "open", "299": "0-299", "2500": "other-restricted"}
    assert values(spark, [(k,) for k in club], "x string", T.strata_bucket(T.club_top_limit(F.col("x")))) == [(v,) for v in club.values()]
    other = {"NLM": "0-499-nlm", "0-750": "0-749", "0-1500/NLM": "0-1500", "none": "open", "2500": "other-restricted", "": "open", None: "open", "NLM/2000": "other-restricted"}
    c = F.col("x")
    assert values(spark, [(k,) for k in other], "x string", T.strata_bucket(T.tournament_top_limit(c), T.tournament_is_nlm(c))) == [(v,) for v in other.values()]
    assert (T.label_bucket("All"), T.label_bucket("0-749"), T.label_bucket("?")) == (None, "0-749", "open")


def test_dates():
    today = dt.date(2026, 11, 26)
    assert T.date_bounds("Current season", today) == (dt.date(2026, 7, 1), today)
    assert T.date_bounds("Previous season", today) == (dt.date(2025, 7, 1), dt.date(2026, 5, 31))
    assert T.date_bounds("Last 2 years", today) == (today - dt.timedelta(days=730), None) and T.date_bounds("All time", today) == (None, None)
    assert (T.next_refresh(dt.date(2026, 1, 14)), T.next_refresh(dt.date(2026, 12, 15))) == (dt.date(2026, 1, 15), dt.date(2027, 1, 15))


def test_timestamps_and_texts(spark):
    rows = [("2024-01-02 03:04:05",), ("2024-01-02T03:04:05.250",), ("2024-01-02",), ("02.01.2024",), (None,)]
    got = [r[0] for r in values(spark, rows, "x string", T.parse_timestamp(F.col("x")))]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 250000), dt.datetime(2024, 1, 2), None, None]
    page = "1 NS DUPONT Anne MARTIN Luc 61.23% 2 EW DUPONT Paul BERNARD Eve 48.10%"
    assert values(spark, [(page, "Anne DUPONT - Luc MARTIN"), (page, "A DUPONT - E BERNARD"), (page, "X Y - Z W")], "p string, n string", T.nearest_percentage(F.col("p"), T.surnames(F.col("n"))[0], T.surnames(F.col("n"))[1])) == [(61.23,), (48.1,), (None,)]
    html = "<p>a<script>x<1</script>b <b>c</b></p>\n<STYLE>q</STYLE> d"
    assert values(spark, [(html, "00058")], "h string, c string", T.html_text(F.col("h")), T.without_leading_zeros(F.col("c"))) == [("a b c d", "58")]


def test_parameters():
    assert Report().gate == 0.5 and Report(min_skill_z=-90).gate is None
    for bad in ({"top_n": 0}, {"method": "Sum"}, {"moment": "Expected Rating"}, {"event": "x"}, {"prior_sessions": 1001}):
        with pytest.raises(ValueError):
            Report(**bad)
    assert Report(entity="Pairs", moment="Expected Rating").column == "Elo_E_Pair_{}"
    assert [coerced(x, 7, 0, 50, 5) for x in ("12", "13", "999", None, "x")] == [10, 15, 50, 7, 7]


def test_filters_and_ad_hoc_sql(spark):
    df = spark.createDataFrame([(1, False, 0.5), (2, None, None), (3, True, 1.2), (4, False, float("nan"))], "i int, is_virtual_game boolean, Pct_NS double")
    assert [r.i for r in filters.boards(df, mode="Local Only").collect()] == [1] and [r.i for r in filters.boards(df, mode="Online Only").collect()] == [2]
    with pytest.raises(ValueError):
        filters.boards(df, bucket="open")
    for text, n in (("SELECT i WHERE i > 2", 2), ("WHERE i = 1", 1), ("select count(*) c from self", 1), ("LIMIT 3", 3), ("SELECT extract(year FROM current_date()) y, i WHERE i < 3", 2), ("SELECT i, ' from x' t", 4)):
        assert ad_hoc(df, text).count() == n


def test_latest_and_first_values_do_not_follow_row_order(spark):
    rows = [(1, 1, 10.0), (1, 3, None), (1, 2, 20.0), (1, None, 5.0)]
    for data in (rows, rows[::-1]):
        df = spark.createDataFrame(data, "k int, t int, v double").repartition(3)
        r = df.groupBy("k").agg(A.latest("v", "t").alias("a"), A.latest_known("v", "t").alias("b"), A.first_by("v", "t").alias("c")).first()
        assert (r.a, r.c) == (5.0, 10.0) and r.b == 20.0
    with pytest.raises(ValueError):
        A.rating("Sum", "v")


def test_ad_hoc_gives_a_callers_view_back(spark):
    from boardwise.plans import report

    spark.range(3).createOrReplaceTempView("self")
    assert report.ad_hoc(spark.range(5), "WHERE id > 1").count() == 3 and spark.table("self").count() == 3
    spark.catalog.dropTempView("self")
    assert report.ad_hoc(spark.range(5), "SELECT max(id) AS m").first().m == 4 and not spark.catalog.tableExists("self")


def plain_nearest(page, a, b):
    import re

    text, names, best = page.upper(), [a.upper(), b.upper()], None
    for place, m in enumerate(re.finditer(r"[0-9]{1,2}\.[0-9]{2}%", text)):
        low = max(0, m.start() - 100)
        around = text[low : m.end() + 20]
        at = [around.rfind(n) for n in names]
        if min(at) >= 0:
            own = (max(m.start() - low - x for x in at), place, float(m[0][:-1]))
            best = own if best is None else min(best, own)
    return best and best[2]


def test_nearest_percentage_in_time_that_goes_with_the_page(spark):
    import random
    import time

    r = random.Random(3)
    words = ["ANN", "Bob", "x" * 40, " ", "51.20%", "7.00%", "99.99%99.98%", "12.3%", "é", "."]
    pages = ["".join(r.choice(words) for _ in range(r.choice([0, 3, 30, 300]))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, page string")
    got = {x.k: x.v for x in df.select("k", T.nearest_percentage(F.col("page"), F.lit("ann"), F.lit("bob")).alias("v")).collect()}
    assert got == {k: plain_nearest(p, "ann", "bob") for k, p in enumerate(pages)}

    def took(n):
        page = "".join(f"Ann A{k}X Bob B{k}X {k % 90 + 10}.{k % 100:02d}% of all " for k in range(n))
        one = spark.createDataFrame([(page,)], "page string").select(T.nearest_percentage(F.col("page"), F.lit("A7X"), F.lit("B7X")).alias("v"))
        start = time.perf_counter()
        assert one.first().v == 17.07
        return time.perf_counter() - start

    took(1000)
    assert took(100_000) < 30 * max(took(10_000), 0.2)
