"""Mergeable parts of the reports on boards: a row an entity, day, mode of play and stratum.

A report with any filter merges the parts that pass it, so it doesn't read boards. Every value of a leaderboard's pool has a
part that adds up exactly: sums with counts, the value with its place in the order of play, and the sessions themselves, as
one may have boards on several days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.params import MOMENTS, Report
from . import aggregates as A
from . import boards as B
from . import filters

#: What parts are kept by, besides their entity.
BY = ["day", "is_virtual_game", "strata_bucket"]
_KINDS = {"is_virtual_game": "boolean", "strata_bucket": "string"}
#: Order of play for the other event type's last rating.
CROSS = ("Date", "session_id", "Board")


def with_day(boards: DataFrame) -> DataFrame:
    return filters.with_optional(boards, _KINDS).withColumn("day", F.col("Date").cast("date"))


def _parts(rows: DataFrame, entity: str, last: list[str], values: list[Column]) -> DataFrame:
    order, cross = A.nulls_last(*B.ORDER), A.nulls_last(*CROSS)
    flags = [x for c in B.FLAGS for x in (F.sum(F.col(c).cast("double")).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]
    return rows.groupBy(entity, *BY).agg(
        F.max_by(F.struct("Elo", *last), order).alias("last"), F.max(order).alias("at"), F.max_by("Elo", cross).alias("cross"), F.max(cross).alias("cross_at"), F.max("Elo").alias("most"),
        F.sum("Elo").alias("sum"), F.count("Elo").alias("n"), F.avg("Elo").alias("mean"), (F.count("Elo") * F.var_pop("Elo")).alias("m2"), F.collect_set("session_id").alias("sessions"), *values, *flags,
    )


def _mean_parts(c: str) -> list[Column]:
    return [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]


def player_parts(boards: DataFrame, rating: str) -> DataFrame:
    """Parts of valid boards for one moment's ratings."""
    return _parts(B.seat_rows(with_day(filters.boards(boards)), rating, BY), "Player_ID", ["Player_Name"], [F.max("MasterPoints").alias("MasterPoints")])


def pair_parts(boards: DataFrame, rating: str, seat_rating: str | None) -> DataFrame:
    values = [x for c in ("Avg_MPs", "Geo_MPs", "Avg_Player_Elo") for x in _mean_parts(c)]
    return _parts(B.side_rows(with_day(filters.boards(boards)), rating, seat_rating, BY), "Pair_IDs", ["Pair_Names"], values)


def scale_parts(boards: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean and squared deviations of all usable ratings of several columns."""
    rows = with_day(filters.boards(boards)).select(*BY, F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v")).where("v is not null and not isnan(v)")
    return rows.groupBy(*BY).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.count("v") * F.var_pop("v")).alias("m2"))


def _mean(c: str) -> Column:
    return F.sum(f"{c}_sum") / F.nullif(F.sum(f"{c}_n"), F.lit(0))


def _sessions(parts: DataFrame, entity: str) -> DataFrame:
    """Sessions of each entity, each once however many days and strata it has boards of."""
    return parts.select(F.col(entity).alias("_entity"), F.explode("sessions").alias("s")).groupBy("_entity").agg(F.countDistinct("s").alias("Sessions"))


def _merged(parts: DataFrame, p: Report, entity: str, values: list[Column]) -> DataFrame:
    elo = {"Latest": F.max_by("last.Elo", "at"), "Avg": F.sum("sum") / F.sum("n"), "Max": F.max("most")}[p.method]
    name = "Player_Name" if entity == "Player_ID" else "Pair_Names"
    rates = [_mean(c).alias(n) for c, n in zip(B.FLAGS, ("Par_Suit_Rate", "Par_Contract_Rate", "Sacrifice_Rate", "DD_Tricks_Diff_Avg"))]
    pool = parts.groupBy(entity).agg(F.max_by(f"last.{name}", "at").alias(name), *values, elo.alias("Elo"), *rates)
    return pool.join(_sessions(parts, entity), F.col(entity).eqNullSafe(F.col("_entity"))).drop("_entity")


def merged_pool(parts: DataFrame, p: Report) -> DataFrame:
    """player_pool or pair_pool of parts that pass a report's filters."""
    if p.entity == "Players":
        return _merged(parts, p, "Player_ID", [F.max("MasterPoints").alias("MasterPoints")])
    return _merged(parts, p, "Pair_IDs", [_mean(c).alias(c) for c in ("Avg_MPs", "Geo_MPs", "Avg_Player_Elo")])


def merged_crossover(parts: DataFrame, board: DataFrame, p: Report) -> DataFrame:
    """What crossover_of needs, of the board's entities alone."""
    entity = "Player_ID" if p.entity == "Players" else "Pair_IDs"
    own = parts.join(board.select(entity), entity, "left_semi")
    raw = {"Latest": F.max_by("cross", "cross_at"), "Avg": F.sum("sum") / F.sum("n"), "Max": F.max("most")}[p.method]
    n, mean = F.sum("n"), F.sum("sum") / F.sum("n")
    m2 = F.sum("m2") + F.sum(F.col("n") * (F.col("mean") - 1500.0) ** 2) - n * (mean - 1500.0) ** 2
    each = own.groupBy(entity).agg(raw.alias("_raw"), n.alias("n"), mean.alias("mean"), m2.alias("m2"))
    return each.join(_sessions(own, entity), F.col(entity) == F.col("_entity")).drop("_entity").withColumnRenamed("Sessions", "sessions")


def moments_of(boards: DataFrame) -> list[str]:
    """The moments whose rating columns the boards have."""
    has = set(boards.columns)
    return [m for m, (seat, side) in MOMENTS.items() if (seat is None or {seat.format(s) for s in "NESW"} <= has) and {side.format(s) for s in B.SIDES} <= has]
