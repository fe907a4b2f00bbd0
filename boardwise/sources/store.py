"""Boards laid out for reports, with the parts that leaderboards merge.

    boards/day=...                      all boards, for filters by date
    seats/bucket=...                    a board under each of its players, sorted by player: a history reads one bucket, and of that the row groups that may have the player
    parts/moment=k/{players|pairs|players_scale|pairs_scale}   operators/states.py, for each moment of ratings

write_store makes all of it; write_boards makes the boards, and write_for then what a report reads besides, once it is asked for.
Text days as folder names prune before any file is opened; buckets and row groups prune by what Parquet's footers say.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boards as B
from ..operators import filters, states
from ..operators.aggregates import merged_stats
from ..plans.params import MOMENTS, Report
from ..shared import checkpointed

BUCKETS = 64
#: Rows that a task of the layout sorts, so that it needs no disk for them.
SORTED_ROWS = 400_000
#: Groups of parts that a task aggregates by hash before it sorts its rows instead; Spark's own limit is 128.
GROUPS = 50_000
#: Parts that a moment has; the scales are of its ratings' mean and deviation.
KINDS = ("players", "players_scale", "pairs", "pairs_scale")


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


@contextmanager
def _hashed(spark: SparkSession) -> Iterator[None]:
    """Aggregates of a session's sets hold GROUPS groups of a task: an entity, day, mode of play and stratum have many rows, which needn't be sorted."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(GROUPS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORTED_ROWS))


def write_boards(boards: DataFrame, path: str) -> None:
    """Lays out boards by day, which all else under path is made from."""
    spark, laid = boards.sparkSession, states.with_day(boards)
    # ranges, not hashes, deal the rows, so that a day or a player with a large share of all boards has several tasks
    laid.repartitionByRange(_tasks(spark, laid.count()), "day", "Date").sortWithinPartitions("day", "Date").write.mode("overwrite").partitionBy("day").parquet(f"{path}/boards")


def write_seats(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Lays out the copy by player of the boards under path."""
    stored = spark.read.parquet(f"{path}/boards")
    players = F.array_distinct(F.filter(F.array(*[F.col(f"Player_ID_{s}") for s in "NESW"]), lambda x: x.isNotNull()))
    seats = stored.select("*", F.explode(players).alias("player")).withColumn("bucket", _bucket(F.col("player"), buckets))
    dealt = seats.repartitionByRange(_tasks(spark, 4 * stored.count()), "bucket", "player", "Date")
    dealt.sortWithinPartitions("bucket", "player", "Date").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/seats")


def write_parts(spark: SparkSession, path: str, moment: str, kind: str) -> None:
    """Lays out the parts of a kind and a moment's ratings, of the boards under path."""
    stored, (seat, side) = spark.read.parquet(f"{path}/boards"), MOMENTS[moment]
    parts = {
        "players": lambda: states.player_parts(stored, seat), "players_scale": lambda: states.scale_parts(stored, [seat.format(s) for s in "NESW"]),
        "pairs": lambda: states.pair_parts(stored, side, seat), "pairs_scale": lambda: states.scale_parts(stored, [side.format(s) for s in B.SIDES]),
    }[kind]
    with _hashed(spark):
        parts().write.mode("overwrite").parquet(f"{path}/parts/moment={[*MOMENTS].index(moment)}/{kind}")


def write_store(boards: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Lays out boards under path, whose folders are replaced, with all that any report reads. boards are counted, read for the layout, and from there once for each folder of parts."""
    spark = boards.sparkSession
    write_boards(boards, path)
    write_seats(spark, path, buckets)
    for moment in states.moments_of(boards):
        for kind in KINDS:
            if MOMENTS[moment][0] is not None or not kind.startswith("players"):
                write_parts(spark, path, moment, kind)


def write_for(p: Report, spark: SparkSession, path: str, buckets: int = BUCKETS, detail: bool = False) -> None:
    """Of the boards under path, lays out what Store.report of p reads, or Store.detail, where it isn't there yet."""
    kind = p.entity.lower() + "_scale" * detail
    if detail and not _written(spark, f"{path}/seats"):
        write_seats(spark, path, buckets)
    if not _written(spark, f"{path}/parts/moment={[*MOMENTS].index(p.moment)}/{kind}"):
        write_parts(spark, path, p.moment, kind)


def _written(spark: SparkSession, folder: str) -> bool:
    """Whether a write of the folder has ended."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(of)


@dataclass(frozen=True)
class Store:
    """Reports over a folder that write_store has made, or write_boards and, for each report, write_for."""

    spark: SparkSession = field(repr=False)
    path: str
    buckets: int = BUCKETS

    def boards(self, first: dt.datetime | None = None) -> DataFrame:
        """All boards, or of the days from `first` on."""
        all_boards = self.spark.read.parquet(f"{self.path}/boards")
        return all_boards if first is None else all_boards.where(F.col("day") >= F.lit(first.date()))

    def of_player(self, player: str) -> DataFrame:
        """A player's boards, from one bucket's files."""
        code = self.spark.range(1).select(_bucket(F.lit(player), self.buckets)).first()[0]
        return self.spark.read.parquet(f"{self.path}/seats").where((F.col("bucket") == code) & (F.col("player") == player)).drop("bucket", "player")

    def _parts(self, p: Report, kind: str, fresh) -> DataFrame:
        """Parts that pass the report's filters. Where it starts within a day, that day's are made from its boards."""
        k, first = [*MOMENTS].index(p.moment), p.date_from
        try:
            parts = self.spark.read.parquet(f"{self.path}/parts/moment={k}/{kind}")
        except AnalysisException as e:
            raise ValueError(f"these boards have no ratings for {p.moment!r}") from e
        own = filters.all_of(filters.play(p.mode), filters.in_strata(parts, T.label_bucket(p.strata)))
        if first is None:
            return parts.where(own)
        whole = first == dt.datetime.combine(first.date(), dt.time())
        kept = parts.where(own & (F.col("day") >= F.lit(first.date()) if whole else F.col("day") > F.lit(first.date())))
        if whole:
            return kept
        edge = self.boards().where((F.col("day") == F.lit(first.date())) & (F.col("Date") >= F.lit(first).cast("timestamp_ntz")))
        return kept.unionByName(fresh(edge).where(own).select(kept.columns))

    def _pool_parts(self, p: Report) -> DataFrame:
        seat, side = MOMENTS[p.moment]
        if p.entity == "Players":
            return self._parts(p, "players", lambda b: states.player_parts(b, seat))
        return self._parts(p, "pairs", lambda b: states.pair_parts(b, side, seat))

    def report(self, p: Report, anchor: float | None = None, other: Store | None = None, other_anchor: float | None = None) -> DataFrame:
        """plans.report.report, of merged parts. other: the store of the other event type."""
        pool = states.merged_pool(self._pool_parts(p), p)
        board = (B.players_of_pool if p.entity == "Players" else B.pairs_of_pool)(pool, p, anchor)
        if other is None:
            return board
        board = checkpointed(board)
        return B.crossover_of(board, states.merged_crossover(other._pool_parts(p), board, p), p, other_anchor)

    def detail(self, p: Report, player: str | None = None, pair: str | None = None) -> DataFrame:
        """plans.report.detail: a player's own bucket, or that of a pair's first player, on the scale of the merged parts."""
        one = player if p.entity == "Players" else pair
        if not one:
            raise ValueError("an id is needed")
        own = filters.boards(self.of_player(one if p.entity == "Players" else one.split("-", 1)[0]), p.date_from, p.mode, T.label_bucket(p.strata))
        seat, side = MOMENTS[p.moment]
        kind, columns = ("players", [seat.format(s) for s in "NESW"]) if p.entity == "Players" else ("pairs", [side.format(s) for s in B.SIDES])
        stats = merged_stats(self._parts(p, f"{kind}_scale", lambda b: states.scale_parts(b, columns)))
        return (B.player_history if p.entity == "Players" else B.pair_history)(own, one, p.column, stats)
