"""Row filters of reports. Each is a predicate or a DataFrame to DataFrame step that reaches the scan."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def play(mode: str) -> Column | None:
    """Local games are marked false, online ones null; games marked true are neither."""
    c = F.col("is_virtual_game")
    return {"All": None, "Local Only": c == F.lit(False), "Online Only": c.isNull()}[mode]


def in_strata(df: DataFrame, bucket: str | None) -> Column | None:
    if bucket is None:
        return None
    if "strata_bucket" not in df.columns:
        raise ValueError("these boards have no strata_bucket")
    return F.col("strata_bucket") == bucket


def valid_fraction(c: str) -> Column:
    """Null, or from 0 to 1; NaN is greater."""
    return F.col(c).isNull() | F.col(c).between(0, 1)


def valid_percentages(*columns: str) -> Column:
    return all_of(*[F.col(c).isNull() | F.col(c).between(0, 100) for c in columns])


def days(c: str, first: str | None, last: str | None) -> Column:
    """Inclusive range by the first ten characters of an ISO date text."""
    d = F.substring(c, 1, 10)
    return all_of(None if first is None else d >= first, None if last is None else d <= last)


def boards(df: DataFrame, date_from: dt.datetime | None = None, mode: str = "All", bucket: str | None = None) -> DataFrame:
    since = None if date_from is None else F.col("Date") >= F.lit(date_from).cast("timestamp_ntz")
    pct = valid_fraction("Pct_NS") if "Pct_NS" in df.columns else None
    return df.where(all_of(since, play(mode) if "is_virtual_game" in df.columns else None, in_strata(df, bucket), pct))


def results(df: DataFrame, series: int | None = None, club: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    pct = [c for c in ("percentage", "scratch_percentage", "handicap_percentage", "club_percentage") if c in df.columns]
    own = None if series is None else F.col("series_id") == series
    at = None if club is None else F.col("club_name") == club
    return df.where(all_of(valid_percentages(*pct), own, at, days("date", first, last)))


def members(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is in a table of ids; Spark broadcasts the table if it is small."""
    return df.join(ids.select(on).distinct(), on, "left_semi")


def in_any(columns: list[str], values: list) -> Column:
    """Whether any of the columns has one of a few values."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(values), F.lit(False)) for c in columns], F.lit(False)), F.lit(False))


def not_yet_in(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return df.join(known.select(on), on, "left_anti")


def options(df: DataFrame, c: str) -> DataFrame:
    """Distinct known values, sorted."""
    return df.select(c).where(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).distinct().orderBy(c)


def existing(df: DataFrame, *columns: str) -> DataFrame:
    """The columns that there are, in this order and once each."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with typed null columns for those it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
