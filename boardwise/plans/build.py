"""Builds the tournament dataset from landed payloads: spark-submit build.py --landing DIR --out DIR [--if-stale].

Sessions that were folded before stay as they are, up to the first day that differs."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwise.functions import ratings as R
from boardwise.operators import filters, history
from boardwise.sources import dataset, landing

OPTIONAL = {"club_name": "string", "club_id": "string", "tournament_name": "string"}


def identified(results: DataFrame) -> DataFrame:
    """With pair_id and pair_name in the text order of the players' ids; without both ids, the team's and in given order."""
    a, b = F.col("player1_id"), F.col("player2_id")
    both = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    given = F.concat(F.coalesce("player1_name", F.lit("")), F.lit(" - "), F.coalesce("player2_name", F.lit("")))
    return results.withColumns({
        "pair_id": F.when(both, R.pair_id(a, b, "_")).otherwise(F.coalesce("team_id", F.concat_ws("-", a, b))),
        "pair_name": F.when(both & ~(a < b), F.concat(F.coalesce("player2_name", F.lit("")), F.lit(" - "), F.coalesce("player1_name", F.lit("")))).otherwise(given),
    })


def with_player_values(results: DataFrame, values: DataFrame) -> DataFrame:
    """With both players' values (player_id, iv) and their sum; null where a value is unknown."""
    for i in (1, 2):
        one = values.select(F.col("player_id").alias(f"player{i}_id"), F.col("iv").alias(f"player{i}_current_iv"))
        results = results.join(one, f"player{i}_id", "left")
    return results.withColumn("pair_iv", F.col("player1_current_iv") + F.col("player2_current_iv"))


def result_rows(raw: DataFrame, sessions: DataFrame, clubs: DataFrame | None = None, private: bool = False, values: DataFrame | None = None) -> DataFrame:
    """raw (tournament_id, series_id, payload) and sessions (tournament_id, date, tournament_name) to rows that history.fold takes.

    clubs (code, label) name clubs where few results have names; values (player_id, iv) are players' values.
    """
    rows = landing.private_results(raw) if private else landing.public_results(raw)
    rows = filters.with_optional(rows.join(sessions, "tournament_id"), OPTIONAL)
    rows = identified(rows if clubs is None else landing.named_clubs(rows, clubs))
    return rows if values is None else with_player_values(rows, values)


def build(
    raw: DataFrame, sessions: DataFrame, today: str, clubs: DataFrame | None = None, private: bool = False, by: Sequence[str] = (), values: DataFrame | None = None, initial: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results and players of all sessions up to `today`; initial: first ratings, as in history.fold."""
    rated = history.fold(result_rows(raw, sessions, clubs, private, values), by=by, today=today, initial=initial)
    return history.standardized(rated, history.snapshot(rated))


def key_of(private: bool, values: bool) -> str:
    """The dataset's key: builds of another source, or with players' values, are datasets of their own."""
    return ("private" if private else "public") + ("-values" if values else "")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the landing folder; None if there is none."""
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except Exception as e:
        if type(e).__name__ == "AnalysisException":
            return None
        raise


def landed(spark: SparkSession, folder: str, now: dt.datetime, max_age_hours: float | None, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Payloads, from payloads.parquet or the envelopes envelopes/*.json, and sessions, from sessions.parquet or the pages pages/*.json.

    limit: of the latest sessions alone, or of each series' first ones on its pages."""
    sessions = _table(spark, folder, "sessions")
    if sessions is None:
        pages = landing.read_pages(spark, f"{folder}/pages")
        sessions = landing.sessions_of_pages(pages, limit, max_age_hours, now).groupBy("tournament_id").agg(F.max_by("date", F.struct("date", "tournament_name")).alias("date"), F.max_by("tournament_name", F.struct("date", "tournament_name")).alias("tournament_name"))
    elif limit is not None:
        sessions = sessions.orderBy(F.desc("date"), "tournament_id").limit(limit)
    raw = _table(spark, folder, "payloads")
    if raw is None:
        raw = landing.payloads(landing.fresh(landing.read_landing(spark, f"{folder}/envelopes"), max_age_hours, now))
    return raw, sessions


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> bool:
    """Whether it built: with --if-stale, only a dataset that is missing, old, or lacks a past session is."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--landing", required=True, help="folder with sessions.parquet or pages/*.json, payloads.parquet or envelopes/*.json, and, if known, clubs.parquet (code, label) and values.parquet (player_id, iv)")
    p.add_argument("--out", required=True)
    p.add_argument("--private", action="store_true")
    p.add_argument("--if-stale", action="store_true")
    p.add_argument("--max-age-hours", type=float, default=20.0)
    p.add_argument("--envelope-hours", type=float, default=None, help="oldest envelopes to read; by default all")
    p.add_argument("--limit", type=int, default=None, help="latest sessions to read; by default all")
    p.add_argument("--window-rows", type=int, default=1_000_000, help="rows that a window of days has about; its unconnected sessions fold apart")
    p.add_argument("--keep", type=int, default=2, help="versions to keep")
    p.add_argument("--now", type=dt.datetime.fromisoformat, default=dt.datetime.now())
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("build").getOrCreate()
    raw, sessions = landed(spark, a.landing, a.now, a.envelope_hours, a.limit)
    clubs, values = _table(spark, a.landing, "clubs"), _table(spark, a.landing, "values")
    key = key_of(a.private, values is not None)
    if a.if_stale and not dataset.needs_rebuild(spark, a.out, key, sessions, a.now, a.max_age_hours):
        return False
    rows = result_rows(raw, sessions, clubs, a.private, values)
    dataset.extend(rows, a.out, key, a.now, today=a.now.date().isoformat(), window_rows=a.window_rows)
    dataset.prune(spark, a.out, key, a.keep)
    return True


if __name__ == "__main__":
    main()
