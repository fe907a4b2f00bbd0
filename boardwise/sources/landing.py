"""Raw API payloads, landed as JSON lines, to result rows; sidecars; board files."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import filters

_PLAYER = "struct<id:string,migrationId:string,firstName:string,lastName:string>"
RANKING = f"array<struct<rank:string,sessionScore:string,totalScore:string,pe:string,peBonus:string,simultaneousId:string,rankWithoutHandicap:string,team:struct<id:string,player1:{_PLAYER},player2:{_PLAYER}>>>"
TEAMS = "struct<teams:array<struct<id:string,percent:string,percentWithoutHandicap:string,clubPercent:string,club_percent:string,PE:string,PE_bonus:string,ranking:string,theoretical_ranking:string,organization:struct<id:string,name:string,code:string>,players:array<struct<id:string,firstname:string,lastname:string>>>>>"
#: The series whose payloads give the scratch score and a bonus.
BONUS_SERIES = 386


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _name(first: str, last: str) -> Column:
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def public_percentages(pct: Column, bonus: Column, series: Column) -> tuple[Column, Column]:
    """(scratch, handicap): the score holds the bonus in the bonus series and wherever there is one."""
    with_bonus = (series == BONUS_SERIES) | (bonus > 0)
    return F.when(with_bonus, pct - bonus).otherwise(pct), F.when(with_bonus, pct)


def private_percentages(pct: Column, explicit: Column, bonus: Column, series: Column) -> tuple[Column, Column]:
    """(scratch, handicap): an explicit scratch score wins; the bonus series adds its bonus; else a bonus is taken off."""
    own = series == BONUS_SERIES
    scratch = F.when(explicit.isNotNull(), F.coalesce(_number(explicit), pct)).when(own, pct).when(bonus > 0, pct - bonus).otherwise(pct)
    return scratch, F.when(explicit.isNotNull(), pct).when(own, pct + bonus).when(bonus > 0, pct)


def public_results(raw: DataFrame) -> DataFrame:
    """raw (tournament_id, series_id, payload JSON) to result rows; entries without both players are left out."""
    rows = raw.select("tournament_id", "series_id", F.posexplode(F.from_json("payload", RANKING)).alias("row_seq", "e")).where("e.team.player1 is not null and e.team.player2 is not null")
    bonus = F.coalesce(_number(F.col("e.peBonus")), F.lit(0.0)) / 10.0
    pct = F.coalesce(F.nullif(_number(F.col("e.sessionScore")), F.lit(0.0)), _number(F.col("e.totalScore")), F.lit(0.0))
    scratch, handicap = public_percentages(pct, bonus, F.col("series_id"))
    ids = [F.coalesce(F.nullif(F.col(f"e.team.player{i}.migrationId"), F.lit("")), F.col(f"e.team.player{i}.id"), F.lit("")).alias(f"player{i}_id") for i in (1, 2)]
    names = [_name(f"e.team.player{i}.firstName", f"e.team.player{i}.lastName").alias(f"player{i}_name") for i in (1, 2)]
    return rows.select(
        "tournament_id", "series_id", "row_seq", F.col("e.team.id").alias("team_id"), *ids, *names, pct.alias("percentage"), handicap.alias("handicap_percentage"), scratch.alias("scratch_percentage"), bonus.alias("iv_bonus"),
        scratch.alias("club_percentage"), F.col("e.rank").try_cast("long").alias("rank"), F.col("e.rankWithoutHandicap").try_cast("long").alias("theoretical_rank"), _number(F.col("e.pe")).alias("pe"), T.without_leading_zeros(F.col("e.simultaneousId")).alias("club_code"),
    )


def private_results(raw: DataFrame) -> DataFrame:
    """The same for the other API's payloads; teams of fewer than two players are left out."""
    rows = raw.select("tournament_id", "series_id", F.posexplode(F.from_json("payload", TEAMS)["teams"]).alias("row_seq", "e")).where("size(e.players) >= 2")
    bonus = F.coalesce(_number(F.col("e.PE_bonus")), F.lit(0.0)) / 10.0
    explicit = F.coalesce(*[F.nullif(F.col(f"e.{c}"), F.lit("")) for c in ("percentWithoutHandicap", "clubPercent", "club_percent")])
    pct = F.coalesce(_number(F.col("e.percent")), F.lit(0.0))
    scratch, handicap = private_percentages(pct, explicit, bonus, F.col("series_id"))
    p = [F.col("e.players")[i] for i in (0, 1)]
    full = [F.trim(F.concat(F.coalesce(x["firstname"], F.lit("")), F.lit(" "), F.coalesce(x["lastname"], F.lit("")))).alias(f"player{i}_name") for i, x in enumerate(p, 1)]
    return rows.select(
        "tournament_id", "series_id", "row_seq", F.col("e.id").alias("team_id"), *[x["id"].alias(f"player{i}_id") for i, x in enumerate(p, 1)], *full, pct.alias("percentage"), handicap.alias("handicap_percentage"), scratch.alias("scratch_percentage"),
        bonus.alias("iv_bonus"), scratch.alias("club_percentage"), F.col("e.ranking").try_cast("long").alias("rank"), F.col("e.theoretical_ranking").try_cast("long").alias("theoretical_rank"), _number(F.col("e.PE")).alias("pe"),
        F.col("e.organization.id").alias("club_id"), F.col("e.organization.name").alias("club_name"), F.col("e.organization.code").alias("club_code"),
    )


def named_clubs(results: DataFrame, clubs: DataFrame, code: str = "code", name: str = "label", share: float = 0.1) -> DataFrame:
    """Club names by code, leading zeros aside, if fewer than `share` of the results have one; unknown codes keep theirs."""
    known = clubs.select(T.without_leading_zeros(F.col(code)).alias("_code"), F.col(name).alias("_name")).where("_name is not null").groupBy("_code").agg(F.min("_name").alias("_name"))
    stats = results.agg((F.count_if(F.coalesce("club_name", F.lit("")) != "") < share * F.count(F.lit(1))).alias("_few"))
    out = results.withColumn("_code", T.without_leading_zeros(F.col("club_code"))).join(known, "_code", "left").crossJoin(F.broadcast(stats))
    return out.withColumn("club_name", F.when(F.col("_few"), F.coalesce("_name", "club_name")).otherwise(F.col("club_name"))).select(results.columns)


def fresh(landed: DataFrame, max_age_hours: float | None, now: dt.datetime) -> DataFrame:
    """Envelopes (timestamp in seconds, identifier, series_id, data) young enough; None: all."""
    return landed if max_age_hours is None else landed.where(F.col("timestamp") >= now.timestamp() - 3600 * max_age_hours)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp double, identifier string, series_id int, data string").option("multiLine", True).json(path)


_ITEM = "array<struct<id:string,date:string,name:string,label:string>>"
LIST = f"struct<items:{_ITEM},pagination:struct<has_next_page:boolean>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of session lists (timestamp in seconds, series_id, page from 1, data); one series has many, or one list without pages."""
    return spark.read.schema("timestamp double, series_id int, page int, data string").option("multiLine", True).json(path)


def sessions_of_pages(pages: DataFrame, limit: int | None = None, max_age_hours: float | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Sessions of all series (tournament_id, date, tournament_name, series_id, page, place), as far as each series' pages lead on.

    Of a page that landed several times the newest counts. A page counts if all ahead of it have items and say that there is a
    next one; a page that is missing, or no list, ends its series, and a bare list is one page. limit: the first sessions of each
    series, in the order of its pages. Where max_age_hours leaves a series no page, its older ones are taken.
    """
    if max_age_hours is not None and now is not None:
        young = F.col("timestamp") >= now.timestamp() - 3600 * max_age_hours
        some = pages.groupBy(F.col("series_id").alias("_series")).agg(F.max(young).alias("_some"))
        pages = pages.join(some, F.col("series_id").eqNullSafe(F.col("_series"))).where(young | ~F.col("_some"))
    newest = pages.groupBy("series_id", "page").agg(F.max_by("data", F.struct("timestamp", "data")).alias("data"))
    whole, bare = F.from_json("data", LIST), F.from_json("data", _ITEM)
    read = newest.select("series_id", "page", F.coalesce(whole["items"], F.when(F.ltrim("data").startswith("["), bare)).alias("items"), F.coalesce(whole["pagination"]["has_next_page"], F.lit(False)).alias("leads"))
    ahead = Window.partitionBy("series_id").orderBy("page")  # a row a page
    led = read.withColumns({"n": F.row_number().over(ahead), "on": F.coalesce(F.min(F.col("leads") & F.col("items").isNotNull()).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))})
    items = led.where("n = page and on and items is not null").select("series_id", "page", F.posexplode("items").alias("place", "e"))
    out = items.select(F.col("e.id").alias("tournament_id"), F.col("e.date").alias("date"), F.coalesce("e.name", "e.label").alias("tournament_name"), "series_id", "page", "place").where("tournament_id is not null")
    if limit is None:
        return out
    first = F.row_number().over(Window.partitionBy("series_id").orderBy("page", "place"))
    return out.withColumn("_n", first).where(F.col("_n") <= limit).drop("_n")


def payloads(landed: DataFrame) -> DataFrame:
    """Envelopes' payloads (tournament_id, series_id, payload), the newest of each identifier and series."""
    newest = F.max_by("data", F.struct("timestamp", "data"))
    return landed.groupBy(F.col("identifier").alias("tournament_id"), "series_id").agg(newest.alias("payload"))


def anchor(spark: SparkSession, path: str, kind: str) -> float | None:
    """prior_anchor of a sidecar {kind: {prior_anchor}}; None if the file, the section or a number is missing."""
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
        value = json.loads(rows[0].value)[kind]["prior_anchor"]
        return None if isinstance(value, bool) else float(value)
    except Exception as e:
        if type(e).__name__ in ("AnalysisException", "IndexError", "KeyError", "TypeError", "ValueError", "JSONDecodeError"):
            return None
        raise


def boards(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Board results of one generation of files or another: dates parsed, session ids as text, columns as far as they exist."""
    return _prepared(spark.read.parquet(path), columns)


def _prepared(df: DataFrame, columns: list[str] | None) -> DataFrame:
    df = df if columns is None else filters.existing(df, *columns)
    kinds = dict(df.dtypes)
    if "Date" in kinds:
        df = df.withColumn("Date", T.parse_timestamp(F.col("Date")) if kinds["Date"] == "string" else F.col("Date").cast("timestamp_ntz"))
    return df.withColumn("session_id", F.col("session_id").cast("string")) if "session_id" in kinds else df


_SCHEMAS: dict[tuple, StructType] = {}


@dataclass(frozen=True)
class BoardFiles:
    """Board files of event types under one root, on any file system that Spark reads; options are its settings for these reads alone."""

    root: str
    name: str = "{event}.parquet"
    options: tuple[tuple[str, str], ...] = ()

    def path(self, event: str) -> str:
        return f"{self.root.rstrip('/')}/{self.name.format(event=event.lower())}"

    def schema(self, spark: SparkSession, event: str) -> StructType:
        """From the files' footers, once a session."""
        key = (spark.sparkContext.applicationId, self, event)
        if key not in _SCHEMAS:
            try:
                _SCHEMAS[key] = spark.read.options(**dict(self.options)).parquet(self.path(event)).schema
            except AnalysisException as e:
                raise FileNotFoundError(f"no boards at {self.path(event)}") from e
        return _SCHEMAS[key]

    def boards(self, spark: SparkSession, event: str, columns: list[str] | None = None) -> DataFrame:
        """boards of the event type: with the known schema, so that no footer is read again for it."""
        return _prepared(spark.read.options(**dict(self.options)).schema(self.schema(spark, event)).parquet(self.path(event)), columns)
