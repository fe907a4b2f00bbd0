"""Service entry points: a leaderboard or a history with what was asked for, and SQL over the last result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boards as B
from ..operators import filters
from ..sources import landing
from .params import Report


def report(boards: DataFrame, p: Report, anchor: float | None = None, other: DataFrame | None = None, other_anchor: float | None = None) -> DataFrame:
    """Leaderboard of the filtered boards, with the other event type's columns if its boards are given."""
    bucket = T.label_bucket(p.strata)
    out = B.leaderboard(filters.boards(boards, p.date_from, p.mode, bucket), p, anchor)
    if other is None:
        return out
    return B.with_crossover(out, filters.boards(other, p.date_from, p.mode, bucket), p, other_anchor)


def detail(boards: DataFrame, p: Report, player: str | None = None, pair: str | None = None) -> DataFrame:
    if not (player if p.entity == "Players" else pair):
        raise ValueError("an id is needed")
    own = filters.boards(boards, p.date_from, p.mode, T.label_bucket(p.strata))
    return B.player_history(own, player, p.column) if p.entity == "Players" else B.pair_history(own, pair, p.column)


def date_range(boards: DataFrame) -> DataFrame:
    """First and last date of all boards, whatever the filters."""
    return boards.agg(F.min("Date").alias("first"), F.max("Date").alias("last"))


def report_of_files(spark: SparkSession, paths: dict[str, str] | landing.BoardFiles, p: Report, sidecar: str | None = None) -> DataFrame:
    """report over files of boards by event type, or over those that BoardFiles has of both, with anchors from the sidecars {event}.json in a folder; no file, no anchor."""
    if isinstance(paths, landing.BoardFiles):
        files, paths = paths, {e: paths.path(e) for e in ("club", "tournament")}
        columns = {e: files.boards(spark, e) for e in paths}
    else:
        columns = {e: landing.boards(spark, path) for e, path in paths.items()}
    kind = "player" if p.entity == "Players" else "pair"
    anchors = {e: None if sidecar is None else landing.anchor(spark, f"{sidecar}/{e}.json", kind) for e in paths}
    other = next((e for e in paths if e != p.event), None)
    return report(columns[p.event], p, anchors[p.event], columns.get(other), anchors.get(other))


def found_in(board: DataFrame, p: Report, token: str | None = None, band: tuple[float, float | None] | None = None) -> DataFrame:
    """Rows of a leaderboard by name or number, and by masterpoints: of those that it lists, so ranks stay."""
    keys = ("Player_ID", "Player_Name", "MasterPoints") if p.entity == "Players" else ("Pair_IDs", "Pair_Names", "Avg_MPs")
    if token:
        board = board.where(T.name_or_number(token, keys[0], keys[1], pair=p.entity == "Pairs"))
    return board if band is None else board.where(T.masterpoint_band(F.col(keys[2]), *band))


def ad_hoc(result: DataFrame, text: str) -> DataFrame:
    """SQL over a result as the table `self`; text without a FROM clause may be a select list with its clauses, or clauses alone.

    The name `self` holds for this text alone. What is quoted or in parentheses is no clause of it.
    """
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*", " ", text)
    while (outer := re.sub(r"\([^()]*\)", " ", bare)) != bare:
        bare = outer
    if not re.search(r"\bfrom\s", bare, re.IGNORECASE):
        text = f"FROM self {text}" if re.match(r"\s*select\b", text, re.IGNORECASE) else f"SELECT * FROM self {text}"
    spark = result.sparkSession
    before = spark.table("self") if spark.catalog.tableExists("self") else None  # a caller's own, which has its name back afterwards
    result.createOrReplaceTempView("self")
    try:
        return spark.sql(text)  # resolved here, so the name is free again afterwards
    finally:
        spark.catalog.dropTempView("self")
        if before is not None and not spark.catalog.tableExists("self"):
            before.createOrReplaceTempView("self")
