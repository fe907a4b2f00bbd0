"""Versions of a rated dataset, kept under keys.

    {path}/{key}/claims/{version}/...   marks made before anything is written; who finds its own alone there owns the name
    {path}/{key}/{version}/...          results, states, days, players and scale of what that build folded
    {path}/{key}/meta/{version}.json    made last; a version without it doesn't count
    {path}/{version}, {path}/meta       the same without keys, as older builds left it: read where a key has no version

A version holds what its build folded and names the parts of older versions that it goes on from, so a build neither folds nor
copies the days before the first that changed. Keys tell sources and options apart, so builds of different ones don't meet.
"""

from __future__ import annotations

import datetime as dt
import json
import random
import re
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, history
from ..shared import delete

NAME = re.compile(r"v\d{8}T\d{12}")
TIME = "v%Y%m%dT%H%M%S%f"
#: Parts from which a build copies older ones into its own version, so that chains stay short.
PARTS = 8
#: Rules of the fold; a version by other rules isn't gone on from.
RULES = 1


@dataclass(frozen=True)
class Version:
    name: str
    built_at: str
    folder: str
    parts: tuple[tuple[str, str | None, str | None], ...] = ()  # (folder, first day, day before which it ends); none: whole tables, already on the display scale
    options: str = ""

    @property
    def time(self) -> dt.datetime:
        return dt.datetime.fromisoformat(self.built_at)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    of = jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, of = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(of(folder))) if fs.exists(of(folder)) else []


def claim(spark: SparkSession, path: str, key: str, now: dt.datetime) -> str:
    """A version's name that no other build has: of the time, or soon after the last name where the key has one from then on.

    So of builds at the same time, the later one has the greater name, by which versions are told newer from older.
    Each build puts a mark of its own into the name's claims, then lists them: who finds no other's owns the name. Two that find
    each other both go on. It needs no create-if-absent, which local file systems don't have."""
    fs, of = _fs(spark, path)
    while True:
        name, mark = now.strftime(TIME), uuid.uuid4().hex
        last = max((x for f in (f"{path}/{key}", f"{path}/{key}/claims") for x in _names(spark, f) if NAME.fullmatch(x)), default="")
        if last < name:
            folder = f"{path}/{key}/claims/{name}"
            fs.create(of(f"{folder}/{mark}"), False).close()
            if _names(spark, folder) == [mark]:
                return name
            fs.delete(of(f"{folder}/{mark}"), False)
            last = name
        now = dt.datetime.strptime(last, TIME) + dt.timedelta(microseconds=random.randint(1, 1000))


def publish(spark: SparkSession, path: str, key: str, version: Version) -> None:
    """Makes a written version count: its meta is written aside and renamed, so that no reader sees half of it."""
    fs, of = _fs(spark, path)
    target = f"{path}/{key}/meta/{version.name}.json"
    out = fs.create(of(f"{target}.new"), True)
    out.write(bytearray(json.dumps(asdict(version)), "utf-8"))
    out.close()
    if not fs.rename(of(f"{target}.new"), of(target)):
        raise FileExistsError(target)


def versions(spark: SparkSession, path: str, key: str | None) -> list[Version]:
    """Complete versions, the newest first. No key: those without one."""
    folder = path if key is None else f"{path}/{key}"
    try:
        rows = spark.read.text(f"{folder}/meta").collect()  # a line a version
    except AnalysisException:
        return []
    found = []
    for x in (json.loads(r.value) for r in rows if r.value.strip()):
        name = x.get("name") or x["version"]
        found.append(Version(name, x["built_at"], f"{folder}/{name}", tuple(map(tuple, x.get("parts", ()))), x.get("options", "")))
    return sorted(found, key=lambda v: (v.time, v.name), reverse=True)


def current(spark: SparkSession, path: str, key: str, older: Sequence[str | None] = (None,)) -> Version | None:
    """The newest version of a key; where it has none, of the first of the older keys that has."""
    return next((v[0] for k in (key, *older) if (v := versions(spark, path, k))), None)


def prune(spark: SparkSession, path: str, key: str, keep: int = 2) -> list[str]:
    """Deletes a key's complete versions but the newest `keep` and those whose parts they need; returns the names of what it deleted.

    A version being written has no meta yet, and anything else in the folder isn't a version, so both stay."""
    known = versions(spark, path, key)
    needed = {p[0] for v in known[:keep] for p in v.parts} | {v.folder for v in known[:keep]}
    fs, of = _fs(spark, path)
    old = [v.name for v in known[keep:] if v.folder not in needed and NAME.fullmatch(v.name)]
    for name in old:
        fs.delete(of(f"{path}/{key}/meta/{name}.json"), False)  # first, so that no reader finds half a version
        delete(spark, f"{path}/{key}/{name}")
        fs.delete(of(f"{path}/{key}/claims/{name}"), True)
    return sorted(old)


def _of_days(c: str, first: str | None, end: str | None) -> Column:
    return filters.all_of(None if first is None else F.col(c) >= first, None if end is None else F.col(c) < end)


def _parts(spark: SparkSession, parts: Sequence[tuple[str, str | None, str | None]], table: str, day: str) -> DataFrame:
    """A table over all parts, each read for its own days alone."""
    read = [spark.read.parquet(f"{folder}/{table}").where(_of_days(day, first, end)).drop("window") for folder, first, end in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def read(spark: SparkSession, path: str, key: str, table: str, older: Sequence[str | None] = (None,)) -> DataFrame:
    """results or players of the current version, on the display scale."""
    found = current(spark, path, key, older)
    if found is None:
        raise FileNotFoundError(f"no dataset at {path} for {key}")
    if not found.parts:
        return spark.read.parquet(f"{found.folder}/{table}")
    scale = spark.read.parquet(f"{found.folder}/scale")
    if table == "players":
        return history.scaled(spark.read.parquet(f"{found.folder}/players"), scale)
    return history.scaled(folded(spark, found), scale)


def folded(spark: SparkSession, version: Version) -> DataFrame:
    """A version's results as the fold left them, before any scale."""
    return _parts(spark, version.parts, "results", "fold_day").drop("fold_day", *history.TRACE)


def write_whole(rated: DataFrame, people: DataFrame, path: str, key: str, now: dt.datetime) -> Version:
    """Results and players, both as they are to be read, as a new version."""
    spark = rated.sparkSession
    name = claim(spark, path, key, now)
    version = Version(name, now.isoformat(), f"{path}/{key}/{name}")
    rated.write.parquet(f"{version.folder}/results")
    people.write.parquet(f"{version.folder}/players")
    publish(spark, path, key, version)
    return version


def day_prints(results: DataFrame) -> DataFrame:
    """day, n and print of each day's rows, whatever their order: equal for equal rows."""
    rows = results.select(history.day_of().alias("day"), F.xxhash64(F.to_json(F.struct(*sorted(results.columns)), {"ignoreNullFields": "false"})).alias("h"))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("print"))


def first_change(before: DataFrame, after: DataFrame) -> str | None:
    """The first day whose rows differ between two tables of day_prints; None if all are the same."""
    old = before.select(F.col("day").alias("_day"), F.col("n").alias("_n"), F.col("print").alias("_print"))
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("print").eqNullSafe(F.col("_print"))
    return after.join(old, F.col("day") == F.col("_day"), "full").where(~same).agg(F.min(F.coalesce("day", "_day"))).first()[0]


def extend(
    results: DataFrame, path: str, key: str, now: dt.datetime, by: Sequence[str] = (), row: str = "row_seq", today: str | None = None, initial: DataFrame | None = None, window_rows: int = 1_000_000, options: str = "",
) -> tuple[Version, str | None]:
    """Folds results into a new version, from the first day that differs from the key's newest version; returns it and that day.

    Late, changed and missing sessions count like new ones: their day is where the fold starts again, with the ratings that the
    day before left. The day is None where nothing changed, and then nothing is folded. Options tell what else the
    fold depends on (initial ratings, say): a version by other options isn't gone on from.
    """
    spark = results.sparkSession
    known = history.up_to(results, today)
    rules = json.dumps([RULES, list(by), row, options, sorted(map(list, known.dtypes))])
    name = claim(spark, path, key, now)
    folder = f"{path}/{key}/{name}"
    day_prints(known).write.parquet(f"{folder}/days")
    days = spark.read.parquet(f"{folder}/days")
    base = next((v for v in versions(spark, path, key) if v.parts and v.options == rules), None)
    start = None if base is None else first_change(spark.read.parquet(f"{base.folder}/days"), days)
    parts: list[tuple[str, str | None, str | None]] = []
    if base is not None:
        parts = [(f, a, b if start is None or b is not None and b <= start else start) for f, a, b in base.parts if start is None or a is None or a < start]
    if base is None or start is not None:
        suffix = known if base is None else known.where(history.day_of() >= start)
        state = initial
        if parts:
            before = history.latest_states(_parts(spark, parts, "states", "day"), by)
            state = before if initial is None else history.newer(initial, before, by)
        history.fold_windows(suffix, folder, by, row, state, window_rows)
        if len(parts) >= PARTS:
            for table, day in (("results", "fold_day"), ("states", "day")):
                _parts(spark, parts, table, day).write.parquet(f"{folder}/{table}/window=-1")
            parts, start = [], None
        parts.append((folder, start, None))
    states = _parts(spark, parts, "states", "day")
    history.totals(states).write.parquet(f"{folder}/players")
    history.scale_of(spark.read.parquet(f"{folder}/players")).write.parquet(f"{folder}/scale")
    version = Version(name, now.isoformat(), folder, tuple(parts), rules)
    publish(spark, path, key, version)
    return version, start


def needs_rebuild(spark: SparkSession, path: str, key: str, listed: DataFrame, now: dt.datetime, max_age_hours: float = 20.0, older: Sequence[str | None] = (None,)) -> bool:
    """Whether the dataset is missing, stale, or lacks a past tournament that is listed (tournament_id, date)."""
    found = current(spark, path, key, older)
    if found is None or now - found.time >= dt.timedelta(hours=max_age_hours):
        return True
    past = listed.where(F.substring("date", 1, 10) <= now.date().isoformat())
    rows = folded(spark, found) if found.parts else spark.read.parquet(f"{found.folder}/results")
    return not filters.not_yet_in(past, rows.select("tournament_id"), "tournament_id").isEmpty()
