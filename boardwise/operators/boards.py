"""Reports on board results: leaderboards, crossover with the other event type, and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..plans.params import MOMENTS, Report
from ..shared import checkpointed
from . import aggregates as A
from . import filters
from .ranges import listed, numbered_rows
from .ranges import ranks as ranked

SIDES = {"NS": ("N", "S"), "EW": ("E", "W")}
PARTNER = {"N": "S", "S": "N", "E": "W", "W": "E"}
FLAGS = ["Is_Par_Suit", "Is_Par_Contract", "Is_Sacrifice", "DD_Tricks_Diff"]
OPTIONAL = {"Round": "int", "Board": "int"}
ORDER = ("Date", "session_id", "Round", "Board")


def seat_rows(boards: DataFrame, rating: str, more: Sequence[str] = ()) -> DataFrame:
    """One row a seat with a player and a usable rating; boards are read once. more: columns of boards to carry along."""
    b = filters.with_optional(boards, OPTIONAL)
    seats = [F.struct(F.col(f"Player_ID_{p}").alias("Player_ID"), F.col(f"Player_Name_{p}").alias("Player_Name"), F.col(f"MasterPoints_{p}").alias("MasterPoints"), F.col(rating.format(p)).cast("double").alias("Elo")) for p in "NESW"]
    return b.select(*ORDER, *FLAGS, *more, F.inline(F.array(*seats))).where(F.col("Player_ID").isNotNull() & R.usable(F.col("Elo")))


def side_rows(boards: DataFrame, rating: str, seat_rating: str | None, more: Sequence[str] = ()) -> DataFrame:
    """One row a side with a usable pair rating. A pair with an unknown player has a null id, and is one group."""
    b = filters.with_optional(boards, OPTIONAL)
    sides = []
    for side, (p, q) in SIDES.items():
        a, c = F.col(f"Player_ID_{p}"), F.col(f"Player_ID_{q}")
        mp, mq = (F.coalesce(F.col(f"MasterPoints_{x}"), F.lit(0.0)) for x in (p, q))
        rp, rq = (F.lit(None).cast("double") if seat_rating is None else F.col(seat_rating.format(x)).cast("double") for x in (p, q))
        sides.append(F.struct(
            R.pair_id(a, c).alias("Pair_IDs"), R.pair_name(a, c, F.col(f"Player_Name_{p}"), F.col(f"Player_Name_{q}")).alias("Pair_Names"),
            F.col(rating.format(side)).cast("double").alias("Elo"), ((mp + mq) / 2.0).alias("Avg_MPs"), F.sqrt(mp * mq).alias("Geo_MPs"),
            F.when(R.usable(rp) & R.usable(rq), (rp + rq) / 2.0).alias("Avg_Player_Elo"),
        ))
    return b.select(*ORDER, *FLAGS, *more, F.inline(F.array(*sides))).where(R.usable(F.col("Elo")))


def _published(pool: DataFrame, p: Report, anchor: float | None) -> DataFrame:
    """Raw and shrunk ratings as integers; a null rating counts as 0."""
    prior = p.prior_sessions if anchor is not None else 0
    return pool.withColumns({
        "Raw": R.to_int(F.coalesce("Elo", F.lit(0.0))), "Published": R.to_int(F.coalesce(R.shrunk(F.col("Elo"), F.col("Sessions"), anchor, prior), F.lit(0.0))),
    })


def _ranked_and_gated(pool: DataFrame, p: Report, key: str, order: list[tuple[str, bool]], ranks: dict[str, str]) -> DataFrame:
    """The first rows of the pool that pass the skill gate, ranked from 1, with ranks and scales over the whole pool.

    The pool, one row an entity, is computed once. Means are ranked to nine places, as the order of summing changes what is
    behind them.
    """
    skill = ["Par_Suit_Rate", "Par_Contract_Rate", "DD_Tricks_Diff_Avg"]
    pool = checkpointed(pool)
    s = pool.agg(
        F.avg(F.col("Published").cast("double")).alias("mean"), F.stddev_pop(F.col("Published").cast("double")).alias("sd"), F.count(F.lit(1)).alias("n"),
        *[f(m).alias(f"{m}_{n}") for m in skill for n, f in (("mean", F.avg), ("sd", F.stddev_pop))],
    ).first().asDict()
    n, known = s.pop("n"), {c: F.lit(v).cast("double") for c, v in s.items()}
    out = numbered_rows(pool, order, "Pool_Rank", n)
    out = ranked(out, key, {name: (R.fixed_round(F.col(c), 9), True) for name, c in ranks.items()}, n)
    mean_rank = (F.col("Pool_Rank") + F.col("Par_Suit_Rank") + F.col("Par_Contract_Rank") + F.col("DD_Tricks_Diff_Rank")) / 4.0
    out = ranked(out, key, {"Quality_Rank": (mean_rank, False)}, n)
    z = R.mean_skill_z([(F.col(m), known[f"{m}_mean"], known[f"{m}_sd"]) for m in skill])
    scale = lambda c: R.zscore_chess(F.col(c), known["mean"], known["sd"]).cast("int")
    out = out.withColumns({"Z": z, "Score": scale("Published"), "Raw_Score": scale("Raw")})
    if p.gate is not None:
        out = out.where(F.col("Z") >= p.gate)
    return listed(out, [("Pool_Rank", False)], p.top_n).withColumns({"Title": R.title(F.col("Score")), "Skill_Z": R.fixed_round(F.col("Z"), 3)})


def _rates() -> list[Column]:
    return [A.rate("Is_Par_Suit").alias("Par_Suit_Rate"), A.rate("Is_Par_Contract").alias("Par_Contract_Rate"), A.rate("Is_Sacrifice").alias("Sacrifice_Rate"), F.avg("DD_Tricks_Diff").alias("DD_Tricks_Diff_Avg")]


def _rate_columns() -> list[Column]:
    out: list[Column] = ["Quality_Rank"]  # type: ignore[list-item]
    for name in ("Par_Suit", "Par_Contract", "Sacrifice"):
        out += [R.fixed_round(F.col(f"{name}_Rate") * 100, 1).alias(f"{name}_Rate_Pct"), F.col(f"{name}_Rank")]
    return out + [R.fixed_round(F.col("DD_Tricks_Diff_Avg"), 2).alias("DD_Tricks_Diff_Avg"), F.col("DD_Tricks_Diff_Rank")]


RATE_RANKS = {"Par_Suit_Rank": "Par_Suit_Rate", "Par_Contract_Rank": "Par_Contract_Rate", "Sacrifice_Rank": "Sacrifice_Rate", "DD_Tricks_Diff_Rank": "DD_Tricks_Diff_Avg"}


def player_pool(boards: DataFrame, p: Report) -> DataFrame:
    """A row a player: last name, most masterpoints, rating by the report's method, sessions and rates."""
    return seat_rows(boards, p.column).groupBy("Player_ID").agg(
        A.latest("Player_Name", *ORDER).alias("Player_Name"), F.max("MasterPoints").alias("MasterPoints"),
        A.rating(p.method, "Elo", *ORDER).alias("Elo"), F.countDistinct("session_id").alias("Sessions"), *_rates(),
    )


def pair_pool(boards: DataFrame, p: Report) -> DataFrame:
    return side_rows(boards, p.column, MOMENTS[p.moment][0]).groupBy("Pair_IDs").agg(
        A.latest("Pair_Names", *ORDER).alias("Pair_Names"), A.rating(p.method, "Elo", *ORDER).alias("Elo"),
        F.avg("Avg_MPs").alias("Avg_MPs"), F.avg("Geo_MPs").alias("Geo_MPs"), F.avg("Avg_Player_Elo").alias("Avg_Player_Elo"), F.countDistinct("session_id").alias("Sessions"), *_rates(),
    )


def top_players(boards: DataFrame, p: Report, anchor: float | None = None) -> DataFrame:
    """Players by published rating. Everything after the grouping works on one row a player."""
    return players_of_pool(player_pool(boards, p), p, anchor)


def players_of_pool(pool: DataFrame, p: Report, anchor: float | None = None) -> DataFrame:
    """The leaderboard of a player_pool."""
    pool = _published(pool.where(F.col("Sessions") >= p.min_sessions), p, anchor)
    out = _ranked_and_gated(pool, p, "Player_ID", [("Published", True), ("MasterPoints", True), ("Player_ID", False)], {"MasterPoint_Rank": "MasterPoints"} | RATE_RANKS)
    return out.select(
        F.col("Rank").alias("Player_Elo_Rank"), F.col("Score").alias("Player_Elo_Score"), F.col("Raw_Score").alias("Player_Elo_Raw"), F.col("Score").alias("Player_Elo_Published"),
        "Title", "Skill_Z", "Player_ID", "Player_Name", R.to_int(F.col("MasterPoints")).alias("MasterPoints"), "MasterPoint_Rank", F.col("Sessions").cast("int").alias("Sessions_Played"), *_rate_columns(),
    ).orderBy("Player_Elo_Rank")


def top_pairs(boards: DataFrame, p: Report, anchor: float | None = None) -> DataFrame:
    return pairs_of_pool(pair_pool(boards, p), p, anchor)


def pairs_of_pool(pool: DataFrame, p: Report, anchor: float | None = None) -> DataFrame:
    """The leaderboard of a pair_pool."""
    pool = _published(pool.where(F.col("Sessions") >= p.min_sessions), p, anchor)
    ranks = {"Avg_Elo_Rank": "Avg_Player_Elo", "Avg_MPs_Rank": "Avg_MPs", "Geo_MPs_Rank": "Geo_MPs"} | RATE_RANKS
    out = _ranked_and_gated(pool, p, "Pair_IDs", [("Published", True), ("Avg_MPs", True), ("Pair_IDs", False)], ranks)
    return out.select(
        F.col("Rank").alias("Pair_Elo_Rank"), F.col("Score").alias("Pair_Elo_Score"), F.col("Raw_Score").alias("Pair_Elo_Raw"), F.col("Score").alias("Pair_Elo_Published"), "Title", "Skill_Z",
        "Avg_Elo_Rank", "Pair_IDs", "Pair_Names", R.to_int(F.col("Avg_MPs")).alias("Avg_MPs"), "Avg_MPs_Rank", "Geo_MPs_Rank", F.col("Sessions").cast("int").alias("Sessions"), *_rate_columns(),
    ).orderBy("Pair_Elo_Rank")


def leaderboard(boards: DataFrame, p: Report, anchor: float | None = None) -> DataFrame:
    return (top_players if p.entity == "Players" else top_pairs)(boards, p, anchor)


def with_crossover(board: DataFrame, other: DataFrame, p: Report, anchor: float | None = None) -> DataFrame:
    """Adds to a leaderboard its entities' sessions and rating in the other event type.

    Only rows of the leaderboard's entities are aggregated, and they are the scale's population, board by board. The
    last rating goes by date, session and board, without the round.
    """
    board = checkpointed(board)  # of top_n rows at most, and read twice
    entity = "Player_ID" if p.entity == "Players" else "Pair_IDs"
    rows = seat_rows(other, p.column) if p.entity == "Players" else side_rows(other, p.column, None)
    own = rows.select(entity, "Date", "session_id", "Board", "Elo").join(board.select(entity), entity, "left_semi")
    each = own.groupBy(entity).agg(
        F.countDistinct("session_id").alias("sessions"), A.rating(p.method, "Elo", "Date", "session_id", "Board").alias("_raw"), F.count("Elo").alias("n"), F.avg("Elo").alias("mean"), (F.count("Elo") * F.var_pop("Elo")).alias("m2"),
    )
    return crossover_of(board, each, p, anchor)


def crossover_of(board: DataFrame, each: DataFrame, p: Report, anchor: float | None = None) -> DataFrame:
    """with_crossover from a row an entity: sessions, _raw rating, and count, mean and squared deviations of its ratings."""
    entity = "Player_ID" if p.entity == "Players" else "Pair_IDs"
    other_name = "Tournament" if p.event == "club" else "Club"
    count = f"{other_name}_{'Sessions_Played' if p.entity == 'Players' else 'Sessions'}"
    each = checkpointed(each.withColumnRenamed("sessions", count))  # of the leaderboard's entities at most, and read twice
    stats = A.merged_stats(each)
    each = each.drop("n", "mean", "m2").crossJoin(F.broadcast(stats))  # one row
    score = R.zscore_chess(R.shrunk(F.col("_raw"), F.col(count), anchor, p.prior_sessions if anchor is not None else 0), F.col("mean"), F.col("sd"))
    each = each.select(entity, count, score.cast("long").alias(f"{other_name}_Elo"))
    after = "Sessions_Played" if p.entity == "Players" else "Sessions"
    at = board.columns.index(after) + 1
    order = [*board.columns[:at], count, f"{other_name}_Elo", *board.columns[at:]]
    return board.join(each, entity, "left").fillna({count: 0}).select(order).orderBy(f"{p.entity[:-1]}_Elo_Rank")


def _history(parts: list[Column], boards: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Boards of one entity with before and after on the scale of all seats' (sides') ratings on these boards, or of stats (mean, sd)."""
    rows = boards.select("Date", F.col("session_id").alias("Session"), "Round", "Board", F.inline(F.array(*parts))).where("keep").drop("keep")
    stats = A.stacked_stats(boards, columns) if stats is None else stats
    out = rows.crossJoin(F.broadcast(stats))
    for c in ("Elo_Before", "Elo_After"):
        plain = R.fixed_round(F.col(c), 0)
        scaled = R.fixed_round(R.clamp(F.lit(R.DISPLAY_MEAN) + (F.col(c) - F.col("mean")) / F.col("sd") * R.DISPLAY_SD, 0.0, R.DISPLAY_MAX), 0)
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.when(F.col("sd").isNull(), plain).otherwise(scaled)).cast("int"))
    out = out.withColumns({"Elo_Delta": F.col("Elo_After") - F.col("Elo_Before"), "Title": F.when(F.col("sd").isNotNull(), R.title(F.col("Elo_After")))}).drop("mean", "sd")
    return out.orderBy(F.desc_nulls_first("Date"), F.desc_nulls_first("Session"), F.asc_nulls_first("Round"), F.asc_nulls_first("Board"))


def _pct(side: str) -> Column:
    p = F.col("Pct_NS").cast("double")
    return R.fixed_round((p if side == "NS" else 1 - p) * 100, 1).alias("Pct")


def _optional(boards: DataFrame, c: str) -> Column:
    return F.col(c).cast("double") if c in boards.columns else F.lit(None).cast("double")


def player_history(boards: DataFrame, player: str, rating: str = "Elo_R_{}", stats: DataFrame | None = None) -> DataFrame:
    b, parts = filters.with_optional(boards, OPTIONAL), []
    for side, seats in SIDES.items():
        other = SIDES["EW" if side == "NS" else "NS"]
        for s in seats:
            after = F.col(rating.format(s)).cast("double")
            parts.append(F.struct(
                F.lit(s).alias("Seat"), F.col(f"Player_Name_{PARTNER[s]}").alias("Partner"), F.concat(F.col(f"Player_Name_{other[0]}"), F.lit(" - "), F.col(f"Player_Name_{other[1]}")).alias("Opponents"),
                _pct(side), _optional(b, f"Elo_R_{s}_Before").alias("Elo_Before"), after.alias("Elo_After"), R.fixed_round(_optional(b, f"Field_Stdev_{side}_Player"), 1).alias("Field_Stdev"),
                F.coalesce((F.col(f"Player_ID_{s}") == player) & R.usable(after), F.lit(False)).alias("keep"),
            ))
    return _history(parts, b, [rating.format(s) for s in "NESW"], stats)


def pair_history(boards: DataFrame, pair: str, rating: str = "Elo_R_{}", stats: DataFrame | None = None) -> DataFrame:
    """Of a pair, whichever of its players sits where."""
    b, parts = filters.with_optional(boards, OPTIONAL), []
    x, y = pair.split("-", 1)
    for side, (p, q) in SIDES.items():
        other = SIDES["EW" if side == "NS" else "NS"]
        after = F.col(rating.format(side)).cast("double")
        a, c = F.col(f"Player_ID_{p}"), F.col(f"Player_ID_{q}")
        parts.append(F.struct(
            F.lit(side).alias("Side"), F.concat(F.col(f"Player_Name_{other[0]}"), F.lit(" - "), F.col(f"Player_Name_{other[1]}")).alias("Opponents"), _pct(side),
            _optional(b, f"Elo_R_{side}_Before").alias("Elo_Before"), after.alias("Elo_After"), R.fixed_round(_optional(b, f"Field_Stdev_{side}"), 1).alias("Field_Stdev"),
            F.coalesce((((a == x) & (c == y)) | ((a == y) & (c == x))) & R.usable(after), F.lit(False)).alias("keep"),
        ))
    return _history(parts, b, [rating.format(s) for s in SIDES], stats)


def opponent_breakdown(history: DataFrame, session: str) -> DataFrame:
    """By opponents within a session, in the order of play."""
    keys = ("Round", "Board")
    own = history.where(F.col("Session") == session)
    out = own.groupBy("Opponents").agg(
        F.count(F.lit(1)).alias("Boards"), R.fixed_round(F.avg("Pct"), 1).alias("Avg_Pct"), A.first_by("Elo_Before", *keys).alias("Elo_Start"), A.latest("Elo_After", *keys).alias("Elo_End"), F.min(A.nulls_last(*keys)).alias("_first"),
    )
    return out.withColumn("Elo_Delta", F.col("Elo_End") - F.col("Elo_Start")).orderBy("_first").drop("_first")


def opponent_summary(history: DataFrame) -> DataFrame:
    out = history.groupBy("Opponents").agg(
        F.count(F.lit(1)).alias("Boards"), F.countDistinct("Session").alias("Sessions"), R.fixed_round(F.avg("Pct"), 1).alias("Avg_Pct"), R.fixed_round(F.avg("Elo_Delta"), 1).alias("Avg_Elo_Delta"),
    )
    return out.orderBy(F.desc("Boards"), "Opponents")
