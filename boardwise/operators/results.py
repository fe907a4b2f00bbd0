"""Reports on tournament results, one row a pair and tournament."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions import text as T
from ..shared import checkpointed
from . import aggregates as A
from .ranges import listed, medians

#: Order of results in time; row_seq is a result's place in its tournament.
ORDER = ("date", "tournament_id", "row_seq")


def used_pct(handicap: bool) -> Column:
    return F.coalesce("handicap_percentage", "scratch_percentage") if handicap else F.col("scratch_percentage")


def player_rows(results: DataFrame, handicap: bool) -> DataFrame:
    """One row a player and result, by one pass over the results."""
    track = "handicap" if handicap else "scratch"
    seats = [
        F.struct(
            F.col(f"player{i}_id").alias("player_id"), F.col(f"player{i}_name").alias("player_name"), F.col(f"player{i}_scratch_elo_after").alias("scratch_elo"),
            F.col(f"player{i}_handicap_elo_after").alias("handicap_elo"), F.col(f"player{i}_{track}_elo_after").alias("elo_rating"),
        )
        for i in (1, 2)
    ]
    return results.select(*ORDER, "scratch_percentage", "handicap_percentage", "iv_bonus", F.inline(F.array(*seats)))


def players(results: DataFrame, handicap: bool = False) -> DataFrame:
    """Players with their last ratings and mean percentages."""
    last = lambda c: A.latest_known(c, *ORDER)
    return player_rows(results, handicap).groupBy("player_id").agg(
        last("player_name").alias("player_name"), R.fixed_round(last("scratch_elo"), 1).alias("scratch_elo"),
        R.fixed_round(last(F.coalesce("handicap_elo", "scratch_elo")), 1).alias("handicap_elo"), R.fixed_round(last("elo_rating"), 1).alias("elo_rating"),
        F.count(F.lit(1)).alias("games_played"), R.fixed_round(F.avg("scratch_percentage"), 2).alias("avg_scratch_pct"), R.fixed_round(F.avg(used_pct(True)), 2).alias("avg_handicap_pct"),
        R.fixed_round(F.avg("iv_bonus"), 1).alias("avg_iv_bonus"), R.fixed_round(F.avg(used_pct(handicap)), 2).alias("avg_percentage"), R.fixed_round(F.stddev_samp(used_pct(handicap)), 2).alias("stdev_percentage"),
    )


def _display(c: Column) -> Column:
    return R.fixed_round(R.clamp(c, 0.0, R.DISPLAY_MAX), 0).cast("int")


def _columns() -> list[Column]:
    names = {"Avg_Scratch": "avg_scratch_pct", "Avg_Handicap": "avg_handicap_pct", "Avg_IV_Bonus": "avg_iv_bonus", "Pct_Stdev": "stdev_percentage"}
    return [R.fixed_round(F.col(c), 1).alias(n) for n, c in names.items()] + [F.col("games_played").cast("int").alias("Games")]


def top_players(people: DataFrame, top_n: int = 100, min_games: int = 5, handicap: bool = False, prior: float = 0) -> DataFrame:
    """By rating shrunk towards the median of those with enough games. Titles go by the shrunk scratch rating."""
    name, title = ("HC_Player_Elo", "Scratch_Title") if handicap else ("Player_Elo", "Title")
    pool = checkpointed(people.where(F.col("games_played") >= min_games))
    anchors = medians(pool, {"anchor": F.col("elo_rating"), "scratch_anchor": F.col("scratch_elo")})
    n = F.col("games_played")
    out = pool.crossJoin(F.broadcast(anchors)).withColumns({
        "raw": _display(F.col("elo_rating")), "published": _display(R.shrunk(F.col("elo_rating"), n, F.col("anchor"), prior)), "scratch": _display(R.shrunk(F.col("scratch_elo"), n, F.col("scratch_anchor"), prior)),
    })
    out = listed(out, [("published", True), ("games_played", True), ("player_name", False), ("player_id", False)], top_n)
    return out.select(
        "Rank", F.col("published").alias(name), F.col("raw").alias(f"{name}_Raw"), R.title(F.col("scratch")).alias(title), F.col("player_id").alias("Player_ID"), F.col("player_name").alias("Player_Name"), *_columns(),
    ).orderBy("Rank")


def top_pairs(results: DataFrame, top_n: int = 100, min_games: int = 5, handicap: bool = False, prior: float = 0, people: DataFrame | None = None) -> DataFrame:
    """By last rating, shrunk towards the median. Titles: with people, the lower one of the pair's players, else the rating's."""
    name, title = ("HC_Pair_Elo", "Scratch_Title") if handicap else ("Pair_Elo", "Title")
    last = lambda c: A.latest_known(c, *ORDER)
    elo = "handicap_pair_elo" if handicap else "scratch_pair_elo"
    pool = results.groupBy("pair_id").agg(
        last("pair_name").alias("pair_name"), last("player1_id").alias("player1_id"), last("player2_id").alias("player2_id"), last("scratch_pair_elo").alias("scratch_elo"), last(elo).alias("elo"),
        F.avg("scratch_percentage").alias("avg_scratch_pct"), F.avg(used_pct(True)).alias("avg_handicap_pct"), F.avg("iv_bonus").alias("avg_iv_bonus"), F.stddev_samp(used_pct(handicap)).alias("stdev_percentage"), F.count(F.lit(1)).alias("games_played"),
    ).where(F.col("games_played") >= min_games)
    n, pool = F.col("games_played"), checkpointed(pool)
    anchors = medians(pool, {"anchor": F.col("elo"), "scratch_anchor": F.col("scratch_elo")})
    out = pool.crossJoin(F.broadcast(anchors)).withColumns({
        "raw": _display(F.col("elo")), "published": _display(R.shrunk(F.col("elo"), n, F.col("anchor"), prior)), "scratch": _display(R.shrunk(F.col("scratch_elo"), n, F.col("scratch_anchor"), prior)),
    })
    own_title = R.title(F.col("scratch"))
    if people is not None:
        people = checkpointed(people.select("player_id", "games_played", "scratch_elo"))
        out = out.crossJoin(F.broadcast(medians(people.where(F.col("games_played") >= min_games), {"people_anchor": F.col("scratch_elo")})))
        for i in (1, 2):
            one = people.select(F.col("player_id").alias(f"player{i}_id"), F.col("games_played").alias(f"n{i}"), F.col("scratch_elo").alias(f"s{i}"))
            out = out.join(one, f"player{i}_id", "left")
        shrunk = [_display(R.shrunk(F.coalesce(f"s{i}", F.lit(0.0)), F.coalesce(f"n{i}", F.lit(0)), F.col("people_anchor"), prior)) for i in (1, 2)]
        own_title = R.lower_title(*shrunk)
    out = listed(out.withColumn("title", own_title), [("published", True), ("games_played", True), ("pair_name", False), ("pair_id", False)], top_n)
    return out.select(
        "Rank", F.col("published").alias(name), F.col("raw").alias(f"{name}_Raw"), F.col("title").alias(title), F.col("pair_id").alias("Pair_ID"), F.col("pair_name").alias("Pair_Name"), *_columns(),
    ).orderBy("Rank")


def player_metrics(people: DataFrame, min_games: int) -> DataFrame:
    """One row: players with enough games, their mean games, their best rating."""
    out = people.where(F.col("games_played") >= min_games)
    return out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("games_played"), F.lit(0.0)).alias("mean_games"), F.coalesce(F.max("elo_rating"), F.lit(0.0)).alias("best"))


def pair_metrics(results: DataFrame, min_games: int, handicap: bool = False) -> DataFrame:
    each = results.groupBy("pair_id").agg(F.count(F.lit(1)).alias("games"), F.avg("handicap_pair_elo" if handicap else "scratch_pair_elo").alias("elo")).where(F.col("games") >= min_games)
    return each.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("games"), F.lit(0.0)).alias("mean_games"), F.coalesce(F.max("elo"), F.lit(0.0)).alias("best"))


def _result_columns() -> list[Column]:
    return [
        F.col("rank").try_cast("int").alias("Rank"), R.fixed_round(F.col("scratch_percentage"), 2).alias("Scratch_Pct"), R.fixed_round(F.col("handicap_percentage"), 2).alias("Handicap_Pct"), R.fixed_round(F.col("pair_elo"), 0).cast("int").alias("Pair_Elo"),
    ]


def tournament_opponents(results: DataFrame, tournament: str, pair: str | None = None) -> DataFrame:
    own = results.where(F.col("tournament_id") == tournament)
    own = own if pair is None else own.where(F.col("pair_id") != pair)
    return own.select(F.col("pair_name").alias("Pair"), *_result_columns()).orderBy(F.asc_nulls_first("Rank"), "Pair")


def of_entity(results: DataFrame, player: str | None = None, pair: str | None = None) -> DataFrame:
    return results.where((F.col("player1_id") == player) | (F.col("player2_id") == player)) if player is not None else results.where(F.col("pair_id") == pair)


def entity_history(results: DataFrame, player: str | None = None, pair: str | None = None, handicap: bool = False) -> DataFrame:
    """Tournaments of a player or pair, latest first. A player's ratings are those of the seat that they had."""
    own = of_entity(results, player, pair)
    track = "handicap" if handicap else "scratch"
    seat = F.col("player1_id") == player if player is not None else None
    if seat is not None:
        before, after = (F.when(seat, F.col(f"player1_{track}_elo_{t}")).otherwise(F.col(f"player2_{track}_elo_{t}")) for t in ("before", "after"))
    else:
        before, after = F.lit(None).cast("double"), F.col(f"{track}_pair_elo")
    return own.select(
        F.substring("date", 1, 10).alias("Date"), F.col("tournament_id").alias("Event_ID"), F.col("row_seq").alias("Seq"), F.col("tournament_name").alias("Tournament"), F.col("pair_name").alias("Partner"), F.col("club_name").alias("Club"),
        R.fixed_round(used_pct(handicap), 2).alias("Pct_Used"), *_result_columns()[:3], R.fixed_round(before, 0).cast("int").alias("Elo_Before"), R.fixed_round(after, 0).cast("int").alias("Elo_After"),
        (R.fixed_round(after, 0) - R.fixed_round(before, 0)).cast("int").alias("Elo_Delta"),
    ).orderBy(F.desc("Date"), "Event_ID", "Partner")


def partner_summary(history: DataFrame) -> DataFrame:
    """By pair name; Last_Elo is the latest."""
    out = history.groupBy("Partner").agg(
        F.count(F.lit(1)).alias("Tournaments"), R.rounded_mean("Pct_Used", 2).alias("Avg_Pct"), R.fixed_round(F.avg("Rank"), 1).alias("Avg_Rank"), F.max_by("Elo_After", F.struct("Date", "Event_ID", "Seq")).alias("Last_Elo"),
    )
    return out.orderBy(F.desc("Tournaments"), "Partner")


def club_summary(results: DataFrame, pair: str) -> DataFrame:
    out = results.where(F.col("pair_id") == pair).groupBy(F.col("club_name").alias("Club")).agg(
        F.count(F.lit(1)).alias("Tournaments"), R.fixed_round(F.avg("scratch_percentage"), 2).alias("Avg_Scratch_Pct"), R.fixed_round(F.avg("handicap_percentage"), 2).alias("Avg_Handicap_Pct"), R.fixed_round(F.avg("rank"), 1).alias("Avg_Rank"),
    )
    return out.orderBy(F.desc("Tournaments"), "Club")


def opponents(results: DataFrame, player: str | None = None, pair: str | None = None) -> DataFrame:
    """All others' results in the tournaments that the entity played, latest first."""
    own = of_entity(results, player, pair).select("tournament_id").distinct()
    others = (F.col("player1_id") != player) & (F.col("player2_id") != player) if player is not None else F.col("pair_id") != pair
    rows = results.where(others).join(own, "tournament_id", "left_semi")
    return rows.select(F.col("tournament_id").alias("Event_ID"), F.substring("date", 1, 10).alias("Date"), F.col("pair_name").alias("Opponent"), *_result_columns()).orderBy(F.desc("Date"), "Event_ID", F.asc_nulls_first("Rank"), "Opponent")


def opponent_comparison(results: DataFrame, player: str | None = None, pair: str | None = None) -> DataFrame:
    """By opponent: their means and the entity's own in the same tournaments. Of several own results in one, the first."""
    mine = of_entity(results, player, pair).groupBy(F.col("tournament_id").alias("Event_ID")).agg(
        *[F.min_by(c, "row_seq").cast("double").alias(n) for c, n in (("rank", "My_Rank"), ("scratch_percentage", "My_Scratch"), ("handicap_percentage", "My_Handicap"), ("pair_elo", "My_Elo"))]
    )
    both = opponents(results, player, pair).join(mine, "Event_ID", "left")
    mean = lambda c, n, name: R.rounded_mean(c, n).alias(name)
    out = both.groupBy("Opponent").agg(
        F.count(F.lit(1)).alias("Events"), mean("Rank", 1, "Opp_Avg_Rank"), mean("Scratch_Pct", 2, "Opp_Avg_Scratch"), mean("Handicap_Pct", 2, "Opp_Avg_Handicap"), mean("Pair_Elo", 0, "Opp_Avg_Elo"),
        mean("My_Rank", 1, "My_Avg_Rank"), mean("My_Scratch", 2, "My_Avg_Scratch"), mean("My_Handicap", 2, "My_Avg_Handicap"), mean("My_Elo", 0, "My_Avg_Elo"),
    )
    return out.orderBy(F.desc("Events"), "Opponent")


def reconciled(history: DataFrame, pages: DataFrame, handicap: bool = False, templates: dict[int, str] | None = None) -> DataFrame:
    """history (Date, Tournament, Partner, Scratch_Pct, Handicap_Pct, Pct_Used) with both percentages of a day's result pages.

    pages: (url, text) as landed, two a day, for scratch (an address ending in s) and handicap (in h); templates: addresses by
    weekday without that letter. Rows of those weekdays take both values if both pages have the pair, and the scratch page's
    address as Organization_URL; other rows stay as they are, and no page is read for a row without a pair's two names.
    """
    page = T.dated_page(F.try_to_timestamp(F.substring("Date", 1, 10), F.lit("yyyy-MM-dd")).cast("date"), templates or {})
    texts = pages.groupBy("url").agg(F.max("text").alias("text"))
    both = history.withColumn("_page", page)
    for kind in "sh":
        one = texts.select(F.col("url").alias(f"_url_{kind}"), F.col("text").alias(f"_text_{kind}"))
        both = both.join(one, F.concat("_page", F.lit(kind)) == F.col(f"_url_{kind}"), "left")
    names = T.surnames(F.col("Partner"))
    first, second = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    found = both.withColumns({f"_{k}": R.fixed_round(T.nearest_percentage(F.col(f"_text_{k}"), first, second), 2) for k in "sh"})
    ok = F.col("_s").isNotNull() & F.col("_h").isNotNull()
    out = found.withColumns({
        "Scratch_Pct": F.when(ok, F.col("_s")).otherwise(F.col("Scratch_Pct")), "Handicap_Pct": F.when(ok, F.col("_h")).otherwise(F.col("Handicap_Pct")),
        "Organization_URL": F.when(ok, F.col("_url_s")),
    })
    used = F.coalesce("Handicap_Pct", "Scratch_Pct") if handicap else F.col("Scratch_Pct")
    return out.withColumn("Pct_Used", used).select(*history.columns, "Organization_URL")
