"""Elo history of tournaments: a fold over results in time.

A rating depends on the field's mean at the start of its session, so a pool's sessions follow each other where players
connect them. Pools (columns given in `by`) are independent and fold in parallel. What follows each other is little: two codes
and two percentages a row, packed by session, from which a pool's task finds each session's means and the ratings that each
chunk of it starts with. From those, chunks are rated apart, wherever they are: whole rows arrive sorted through Spark's own
external sort and leave as they came, with their ratings. A pool's task holds its players' ratings and one session's packs, any
other a batch.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..shared import checkpointed, delete
from .components import components

RATED = [f"player{i}_{t}_elo_{m}" for i in (1, 2) for t in ("scratch", "handicap") for m in ("before", "after")]
FIELD = ["scratch_field_avg", "handicap_field_avg", "scratch_field_strength", "handicap_field_strength"]
OUT = [*FIELD, *RATED, "scratch_pair_elo", "handicap_pair_elo"]
#: Rows up to which pools fold whole: less work than a search, window by window, for what players connect.
FEW_ROWS = 50_000_000
#: Rows of a pack. A batch of Arrow has 10,000 packs, so a pack is small.
PACK = 256
#: Least number of tasks that sessions are dealt to, as a few large ones of a pool shouldn't meet in a task.
SESSION_PARTS = 32
#: Rows of a session from which a pack may begin another chunk, so that a large session has several tasks.
CHUNK = 16_384
#: Rows that a task sorts, on average.
TASK_ROWS = 100_000
#: What a fold can go on from: players' unrounded ratings after a row, and the row's place in its task's order.
TRACE = ["player1_scratch_raw", "player1_handicap_raw", "player2_scratch_raw", "player2_handicap_raw", "fold_seq"]


def _scale(mean: float) -> float:
    z = (mean - R.DEFAULT_ELO) / R.STRENGTH_SIGMA
    if z != z or z >= 0:
        return 1.0
    return R.STRENGTH_FLOOR if z <= R.STRENGTH_FLOOR_Z else R.STRENGTH_FLOOR + (1 - R.STRENGTH_FLOOR) * (z - R.STRENGTH_FLOOR_Z) / -R.STRENGTH_FLOOR_Z


def _step(rating: float, pct: float, field: float, scale: float) -> float:
    gap = min(10.0, max(-10.0, (field - rating) / R.ELO_SCALE))
    return rating + R.K_FACTOR * scale * (pct / 100.0 - 1.0 / (1.0 + 10.0**gap))


def _shown(x: float) -> float:
    return round(min(R.DISPLAY_MAX, max(0.0, min(10000.0, max(-1000.0, x)) * 2.0)), 1)


def _fields(pairs: Iterable[tuple], scratch: dict, handicap: dict) -> tuple[float, ...]:
    """Means of both players' ratings over a session's rows (player1, player2, ...) that have both."""
    start, means = R.DEFAULT_ELO, (array("d"), array("d"))
    for x in pairs:
        a, b = x[0], x[1]
        if a and b:
            means[0].append((scratch.get(a, start) + scratch.get(b, start)) / 2)
            means[1].append((handicap.get(a, start) + handicap.get(b, start)) / 2)
    return tuple(sum(own) / len(own) if own else start for own in means)


def _rated(rows: Sequence[tuple], fields: tuple[float, ...], scratch: dict, handicap: dict) -> list[tuple]:
    """Rated values of rows of one session, whose fields are known, and their players' new ratings."""
    start, scales, out = R.DEFAULT_ELO, [_scale(f) for f in fields], []
    for a, b, pct, with_bonus in rows:
        track = 1 if with_bonus is not None else 0
        own: list[float | None] = []
        raw: list[float | None] = []
        for p in (a, b):
            if not p:
                own, raw = [*own, *[None] * 4], [*raw, None, None]
                continue
            s0, h0 = scratch.get(p, start), handicap.get(p, start)
            s1 = scratch[p] = _step(s0, pct, fields[0], scales[0])
            h1 = handicap[p] = _step(h0, pct if with_bonus is None else with_bonus, fields[track], scales[track])
            own += [_shown(s0), _shown(s1), _shown(h0), _shown(h1)]
            raw += [s1, h1]
        pairs = [_shown((r[a] + r[b]) / 2) for r in (scratch, handicap)] if a and b else [None, None]
        out.append((*fields, *scales, *own, *pairs, *raw))
    return out


def fold_session(rows: list[tuple], scratch: dict, handicap: dict) -> list[tuple]:
    """Rated values of one session's rows (player1, player2, scratch pct, handicap pct or None) and their players' new ratings."""
    return _rated(rows, _fields(rows, scratch, handicap), scratch, handicap)


def with_percentages(results: DataFrame) -> DataFrame:
    """results with scratch_percentage, club_percentage and iv_bonus filled where they are missing or no number.

    A bonus is a tenth of pe_bonus. A missing or zero percentage is 50; the club's is that less the bonus, and the
    scratch percentage is the club's. Columns that results lack count as missing.
    """
    own = {c: F.col(c).try_cast("double") if c in results.columns else F.lit(None).cast("double") for c in ("percentage", "pe_bonus", "club_percentage", "scratch_percentage", "iv_bonus")}
    bonus = F.coalesce(own["pe_bonus"], F.lit(0.0)) / 10.0
    club = F.coalesce(own["club_percentage"], F.coalesce(F.nullif(own["percentage"], F.lit(0.0)), F.lit(50.0)) - bonus)
    return results.withColumns({"scratch_percentage": F.coalesce(own["scratch_percentage"], club), "club_percentage": club, "iv_bonus": F.coalesce(own["iv_bonus"], bonus)})


def _narrow(results: DataFrame, row: str) -> list[Column]:
    """What rates a row: its session, its place there, both players and percentages."""
    players = [F.nullif(F.col(f"player{i}_id").cast("string"), F.lit("")).alias(f"player{i}_id") for i in (1, 2)]
    return [F.col("date"), F.col("tournament_id"), F.col(row).alias("place"), *players, F.col("scratch_percentage").cast("double").alias("scratch"), F.col("handicap_percentage").try_cast("double").alias("handicap")]


ROW_ORDER = ["place", "player1_id", "player2_id", "scratch", "handicap"]


def _tasks(df: DataFrame, rows: int = 0) -> int:
    # a number, as Spark would join parts by their bytes, and the fold's work isn't in them
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _packs(results: DataFrame, by: Sequence[str], row: str, rows: int = 0) -> DataFrame:
    """Rows of each session in order, up to PACK in a row: their players once, and of each row two places among them (null: no player) and the percentages.

    Ranges deal the rows, so a large session has several tasks; (part, pack) is a pack's place in its session. first and last are
    the places of its first and last row. rows: how many there are."""
    keys = [*by, "date", "tournament_id"]
    own = results.select(*by, *_narrow(results, row))
    dealt = own.repartitionByRange(_tasks(own, rows), *keys, *ROW_ORDER).sortWithinPartitions(*keys, *ROW_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, pack, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            starts, packs = [], []
            for k, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(keys))))):
                if key != session:
                    session, pack = key, -1
                elif k and k - starts[-1] < PACK:
                    continue
                pack += 1
                starts.append(k)
                packs.append(pack)
            ends, lists = [*starts[1:], batch.num_rows], [[], [], [], [], []]
            for a, b in zip(starts, ends):
                ids = [batch.column(f"player{i}_id").slice(a, b - a) for i in (1, 2)]
                coded = pa.concat_arrays(ids).dictionary_encode()
                values = (coded.dictionary, coded.indices.slice(0, b - a), coded.indices.slice(b - a), *(batch.column(c).slice(a, b - a) for c in ("scratch", "handicap")))
                for of, x in zip(lists, values):
                    of.append(x)
            if starts:
                at, until, place = pa.array(starts, pa.int64()), pa.array([b - 1 for b in ends], pa.int64()), batch.column("place")
                arrays = [pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, x))], pa.int32()), pa.concat_arrays(x)) for x in lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keys))), pa.repeat(pa.scalar(part, pa.int32()), len(starts)), pa.array(packs, pa.int32()), place.take(at), place.take(until), *arrays], names=[*keys, "part", "pack", "first", "last", *PACKED])

    types = {f.name: f.dataType.simpleString() for f in own.schema}
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keys), "part int", "pack int", *(f"{c} {types['place']}" for c in ("first", "last")), "players array<string>", "a array<int>", "b array<int>", "scratch array<double>", "handicap array<double>"]))


PACKED = ["players", "a", "b", "scratch", "handicap"]


def _starts(results: DataFrame, by: Sequence[str], row: str, initial: DataFrame | None, rows: int = 0) -> DataFrame:
    """(by, date, tournament_id, chunk, player_id, scratch, handicap, done, fields, low): ratings of each chunk's players ahead of it, of those that have some.

    done is the number of the pool's rows ahead, and fields are the session's means; each chunk has a row without a player, for
    them. low is what tells a chunk's rows from those ahead, of all chunks but a session's first: the place and the players of its
    first row. A chunk begins where that differs from the row ahead. A pool's task reads its first ratings, then its sessions' packs.
    """
    own = _packs(results, by, row, rows).withColumn("kind", F.lit(1))
    if initial is not None:
        one = [F.array(F.col(c).cast(t)).alias(n) for c, t, n in (("player_id", "string", "players"), ("scratch", "double", "scratch"), ("handicap", "double", "handicap"))]
        own = own.unionByName(initial.select(*by, F.lit(0).alias("kind"), *one), allowMissingColumns=True)
    keys = [*by, "date", "tournament_id"]
    own = own.repartition(_tasks(own), *by) if by else own.repartition(1)
    ordered, n_by = own.sortWithinPartitions(*by, "kind", "date", "tournament_id", "part", "pack", "players", "scratch", "handicap"), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, session, held, scratch, handicap, done = None, None, [], {}, {}, 0

        def rows_of(p: list) -> Iterator[tuple]:
            names, a, b, s, h = (x.as_py() for x in p[2:])
            return zip((None if i is None else names[i] for i in a), (None if i is None else names[i] for i in b), s, h)

        def edge(p: list, at: int) -> tuple:
            return (p[at].as_py(), *(None if (i := p[c][-at].as_py()) is None else p[2][i].as_py() for c in (3, 4)))

        def chunks() -> Iterator[tuple]:
            low, own, n = None, [], 0
            for p in held:
                if n >= CHUNK:
                    before, first = edge(own[-1], 1), edge(p, 0)
                    if before != first and first[0] == first[0]:  # a place that is no number isn't told apart
                        yield low, own
                        low, own, n = first, [], 0
                own.append(p)
                n += len(p[3])
            yield low, own

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            fields = _fields((x for p in held for x in rows_of(p)), scratch, handicap)
            scales, start, step = [_scale(f) for f in fields], R.DEFAULT_ELO, _step
            for number, (low, own) in enumerate(chunks()):
                known = [p for p in dict.fromkeys(n for x in own for n in x[2].as_py()) if p in scratch]
                columns = [(pa.string(), [None, *known]), (pa.float64(), [None, *(scratch[p] for p in known)]), (pa.float64(), [None, *(handicap[p] for p in known)])]
                same = [pa.scalar(number, pa.int32()), pa.scalar(done, pa.int64()), *(pa.scalar(f, pa.float64()) for f in fields)]
                lows = zip((held[0][0].type, pa.string(), pa.string()), low or (None,) * 3)
                size = len(known) + 1
                arrays = [*(pa.repeat(x, size) for x in (*session, *same)), *(pa.array(c, t) for t, c in columns), *(pa.array([x] + [None] * len(known), t) for t, x in lows)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "chunk", "done", *STARTED])
                for p in own:
                    for a, b, pct, with_bonus in rows_of(p):
                        done += 1
                        other, track = (pct, 0) if with_bonus is None else (with_bonus, 1)
                        for x in (a, b):
                            if x:
                                scratch[x] = step(scratch.get(x, start), pct, fields[0], scales[0])
                                handicap[x] = step(handicap.get(x, start), other, fields[track], scales[track])

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                key = tuple(columns[c][k] for c in keys)
                first = columns["kind"][k].as_py() == 0
                if held and (first or key != session):
                    yield from flush()
                    held = []
                if key[:n_by] != pool:
                    pool, scratch, handicap, done = key[:n_by], {}, {}, 0
                if first:
                    player = columns["players"][k].as_py()[0]
                    scratch[player], handicap[player] = columns["scratch"][k].as_py()[0], columns["handicap"][k].as_py()[0]
                else:
                    session = key
                    held.append([columns[c][k] for c in ("first", "last", *PACKED)])
        if held:
            yield from flush()

    types = {f.name: f.dataType.simpleString() for f in own.schema}
    started = ["scratch_field double", "handicap_field double", "player_id string", "scratch double", "handicap double", f"low_place {types['first']}", "low_player1_id string", "low_player2_id string"]
    return ordered.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keys), "chunk int", "done long", *started]))


STARTED = ["scratch_field", "handicap_field", "player_id", "scratch", "handicap", "low_place", "low_player1_id", "low_player2_id"]


def _stream(results: DataFrame, by: Sequence[str], row: str, starts: DataFrame | None, rows: int = 0) -> DataFrame:
    """What a task reads of each chunk, in order: its players' first ratings (as player1_id, scratch, handicap), then its results.

    A row's chunk is the number of its session's lows up to it; few sessions have any, and starts are read twice for them."""
    keys = [*by, "date", "tournament_id"]
    own = results.select(*by, *_narrow(results, row), F.lit(1).alias("kind"), F.struct(*results.drop(*OUT).columns).alias("own"))
    if starts is None:
        own = own.withColumn("chunk", F.lit(0))
    else:
        low = F.struct(*[F.col(f"low_{c}").alias(c) for c in ROW_ORDER[:3]])
        lows = starts.where("player_id is null and chunk > 0").groupBy(*keys).agg(F.collect_list(low).alias("lows"))
        ahead = F.size(F.filter("lows", lambda x: x <= F.struct(*ROW_ORDER[:3])))
        own = _same(own, F.broadcast(lows), keys, "left").withColumn("chunk", F.when(F.col("lows").isNull(), F.lit(0)).otherwise(ahead)).drop("lows")
        first = starts.select(*keys, "chunk", F.lit(0).alias("kind"), F.col("player_id").alias("player1_id"), "scratch", "handicap", "done", "scratch_field", "handicap_field")
        own = own.unionByName(first, allowMissingColumns=True)
    return own.repartition(max(_tasks(own, rows), SESSION_PARTS), *keys, "chunk").sortWithinPartitions(*keys, "chunk", "kind", *ROW_ORDER)


def up_to(results: DataFrame, today: str | None) -> DataFrame:
    """results with completed percentages, without sessions later than `today`."""
    known = with_percentages(results)
    return known if today is None else known.where(F.coalesce(F.substring("date", 1, 10), F.lit("")) <= today)


def fold(results: DataFrame, by: Sequence[str] = (), row: str = "row_seq", today: str | None = None, initial: DataFrame | None = None, trace: bool = False) -> DataFrame:
    """results (by, date, tournament_id, row, player1_id, player2_id, percentages) with ratings, in place of columns of their names.

    Percentages are completed by with_percentages. Sessions go by date text, then id, and rows of a session by `row`; nulls
    come first. Later sessions than `today` are left out. Every other row stays, repeated ones too, which count each. A null
    or empty id is no player. initial: ratings to start from, (by, player_id, scratch, handicap), read as the pool's first rows.
    trace adds the columns TRACE. results are counted, read in the order of the pools as soon as this is called, and read again
    as whole rows; they have to be the same each time.
    """
    known = up_to(results, today)
    n = known.count()
    ordered, keys = _stream(known, by, row, checkpointed(_starts(known, by, row, initial, n)), n), [*by, "date", "tournament_id", "chunk"]
    names, types = [*OUT, *TRACE], [*[pa.float64()] * (len(OUT) + 4), pa.int64()]
    names, types = (names, types) if trace else (OUT, types[: len(OUT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ratings, fields, done = None, ({}, {}), (), 0
        for b in batches:
            values = list(zip(*(b.column(c).to_pylist() for c in ROW_ORDER[1:])))
            codes = [b.column(c).dictionary_encode().indices.fill_null(-1).to_numpy() for c in (*keys, "kind")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            for k, at in itertools.pairwise([0, *new.tolist(), b.num_rows] if b.num_rows else []):
                key = [b.column(c)[k].as_py() for c in keys]
                if key != chunk:
                    chunk, ratings = key, ({}, {})
                if b.column("kind")[k].as_py() == 0:
                    fields, done = tuple(b.column(c)[k].as_py() for c in ("scratch_field", "handicap_field")), b.column("done")[k].as_py()
                    for player, _, scratch, handicap in values[k:at]:
                        if player:
                            ratings[0][player], ratings[1][player] = scratch, handicap
                else:
                    out = [*zip(*_rated(values[k:at], fields, *ratings)), range(done, done + at - k)]
                    done += at - k
                    yield pa.RecordBatch.from_arrays([b.column("own").slice(k, at - k), *(pa.array(c, t) for c, t in zip(out, types))], names=["own", *names])

    kind = ordered.schema["own"].dataType.simpleString()
    rated = ordered.mapInArrow(run, ", ".join([f"own {kind}", *(f"{c} {'long' if c == 'fold_seq' else 'double'}" for c in names)]))
    return rated.select("own.*", *names)


def day_of(date: str = "date") -> Column:
    """The day of a session; sessions without a date are on the first one."""
    return F.coalesce(F.substring(date, 1, 10), F.lit(""))


def windows(days: Sequence[tuple[str, int]], rows: int) -> list[tuple[str, str]]:
    """First and last day of windows, which hold about `rows` rows each, by the rows of each day."""
    out: list[tuple[str, str]] = []
    held = 0
    for day, n in sorted(days):
        if out and held + n <= rows:
            out[-1] = (out[-1][0], day)
            held += n
        else:
            out.append((day, day))
            held = n
    return out


def _seats(df: DataFrame, *columns: str | Column) -> DataFrame:
    """player_id of both seats, without those that are no player, and what else is asked for."""
    ids = F.array(*[F.nullif(F.col(f"player{i}_id").cast("string"), F.lit("")) for i in (1, 2)])
    return df.select(*columns, F.explode(ids).alias("player_id")).where("player_id is not null")


def coupled(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """results with `coupled`, the same number for sessions that players connect. Hashes that meet connect more, which is as right."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    own = results.withColumn("_s", F.xxhash64(*keys, F.coalesce("date", F.lit("")), F.coalesce(F.col("tournament_id").cast("string"), F.lit(""))))
    found = components(_seats(own, "_s", *by).select(F.col("_s").alias("s"), F.xxhash64(*keys, "player_id").alias("p")))
    return own.join(found.select(F.col("s").alias("_s"), "label"), "_s", "left").withColumn("coupled", F.coalesce("label", "_s")).drop("_s", "label")


def _moments(v: str) -> list[Column]:
    """Count, mean and squared deviations of a column, which _merged adds up."""
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), (F.count(v) * F.var_pop(v)).alias("m2")]


def _merged() -> dict[str, Column]:
    """n, mean and m2 of groups of _moments, around a fixed centre near percentages, so that groups add up."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))
    return {"n": n, "mean": mean, "m2": F.greatest(F.sum("m2") + F.sum(F.col("n") * (F.col("mean") - 50.0) ** 2) - n * (mean - 50.0) ** 2, F.lit(0.0))}


def day_states(rated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of each player and day of traced rows: ratings after it, unrounded and shown, the last name, and moments of the percentages.

    Rows are aggregated under each of a player's names first, by a number and into numbers, as snapshot's are."""
    of = {"scratch": "scratch_raw", "handicap": "handicap_raw", "scratch_elo": "scratch_elo_after", "handicap_elo": "handicap_elo_after"}
    seats = [
        F.struct(
            F.nullif(F.col(f"player{i}_id").cast("string"), F.lit("")).alias("player_id"), F.col(f"player{i}_name").cast("string").alias("player_name"), (F.col("fold_seq") * 2 + i).alias("at"),
            *[F.col(f"player{i}_{c}").alias(name) for name, c in of.items()],
        )
        for i in (1, 2)
    ]
    long = rated.select(*by, day_of().alias("day"), "scratch_percentage", F.inline(F.array(*seats))).where("player_id is not null")
    each = long.groupBy(*by, "day", "player_id", "player_name").agg(F.max("at").alias("at"), *[F.max_by(c, "at").alias(c) for c in of], F.count(F.lit(1)).alias("games"), *_moments("scratch_percentage"))
    last = F.max_by(F.struct("scratch", "handicap", "player_name", "scratch_elo", "handicap_elo"), "at").alias("last")
    days = each.groupBy(*by, "day", "player_id").agg(last, F.sum("games").alias("games"), *[c.alias(k) for k, c in _merged().items()])
    return days.select(*by, "day", "player_id", "last.*", "games", "n", "mean", "m2")


def _same(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join by keys that holds for nulls, with df's columns and, unless it is a semi or anti join, other's."""
    named = other.select([F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in other.columns])
    return df.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], how).drop(*[f"_{c}" for c in keys])


def latest_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, player_id, scratch, handicap) after the last day that states have of a player."""
    return states.groupBy(*by, "player_id").agg(F.max_by(F.struct("scratch", "handicap"), "day").alias("last")).select(*by, "player_id", "last.*")


def newer(state: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ratings (by, player_id, scratch, handicap) of new, and those of state for players that new lacks."""
    return new.unionByName(_same(state.select(new.columns), new.select(*by, "player_id"), [*by, "player_id"], "left_anti"))


def fold_windows(results: DataFrame, folder: str, by: Sequence[str] = (), row: str = "row_seq", initial: DataFrame | None = None, window_rows: int = 1_000_000) -> None:
    """Writes fold's rows, with TRACE and fold_day, to folder/results and day_states to folder/states. results have completed percentages.

    Up to FEW_ROWS they are one window, whose pools fold whole. Beyond, a window after the other is folded, of about window_rows
    rows of days that follow each other: its sessions are dealt by what players connect, so that tasks fold apart, and ratings
    go from window to window as a table, one row a player.
    """
    spark = results.sparkSession
    by_day = results.withColumn("fold_day", day_of())
    sizes = {r[0]: r[1] for r in by_day.groupBy("fold_day").count().collect()}  # a row a day
    few = sum(sizes.values()) <= FEW_ROWS
    found = windows([*sizes.items()], FEW_ROWS if few else window_rows) or [("", "")]
    if not few:
        by_day = by_day.repartitionByRange("fold_day")  # days stand together, so a window reads its own files or row groups
    by_day.write.parquet(f"{folder}/input")
    table = spark.read.schema(by_day.schema).parquet(f"{folder}/input")
    state = None if initial is None else initial.withColumn("player_id", F.col("player_id").cast("string"))
    for k, (first, last) in enumerate(found):
        own, pools = table if few else table.where(F.col("fold_day").between(first, last)), [*by]
        if not few:
            own, pools = checkpointed(coupled(own, by)), [*by, "coupled"]
        start = None if state is None else _same(state, _seats(own, *pools).distinct(), [*by, "player_id"], "inner")
        fold(own, pools, row, initial=start, trace=True).drop("coupled").write.parquet(f"{folder}/results/window={k}")
        day_states(spark.read.parquet(f"{folder}/results/window={k}"), by).write.parquet(f"{folder}/states/window={k}")
        if k + 1 < len(found):
            new = latest_states(spark.read.parquet(f"{folder}/states/window={k}"), by)
            state = checkpointed(new if state is None else newer(state, new, by))
    delete(spark, f"{folder}/input")


def totals(states: DataFrame) -> DataFrame:
    """Players after all days of states, over all pools: last ratings, games, mean and deviation of their percentages, as snapshot has them."""
    each = states.groupBy("player_id").agg(
        F.max_by(F.struct("player_name", "scratch_elo", "handicap_elo"), "day").alias("last"), F.sum("games").alias("games_played"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("avg_percentage"),
        F.sum("m2").alias("m2"), F.sum(F.col("n") * (F.col("mean") - 50.0) ** 2).alias("spread"),
    )
    m2 = F.greatest(F.col("m2") + F.col("spread") - F.col("n") * (F.col("avg_percentage") - 50.0) ** 2, F.lit(0.0))  # a fixed centre, so days add up
    return each.select("player_id", "last.*", "games_played", "avg_percentage", F.when(F.col("n") > 1, F.sqrt(m2 / (F.col("n") - 1))).alias("stdev_percentage"))


def snapshot(rated: DataFrame, row: str = "row_seq") -> DataFrame:
    """Players after the fold: last ratings, games, mean and deviation of their percentages.

    A session's rows of a player are aggregated first, by a number and into numbers, which Spark does by hash; the last of
    names and dates needs sorting, and is taken from those.
    """
    seats = [F.struct(F.col(f"player{i}_id").alias("player_id"), F.col(f"player{i}_name").alias("player_name"), F.lit(i).alias("seat"), *[F.col(f"player{i}_{t}_elo_after").alias(f"{t}_elo") for t in ("scratch", "handicap")]) for i in (1, 2)]
    at, first = F.col(row), F.lit(0).cast(rated.schema[row].dataType)
    long = rated.select("date", "tournament_id", at.isNotNull().alias("placed"), F.coalesce(at, first).alias("place"), "scratch_percentage", F.inline(F.array(*seats))).where("player_id is not null and player_id <> ''")
    last = lambda c: F.max_by(c, "place").alias(c)
    each = long.groupBy("player_id", "player_name", "date", "tournament_id", "placed", "seat").agg(
        F.max("place").alias("place"), last("scratch_elo"), last("handicap_elo"), F.count(F.lit(1)).alias("games"), *_moments("scratch_percentage"),
    )
    shown, n = F.struct("player_name", "scratch_elo", "handicap_elo"), F.col("n")
    people = each.groupBy("player_id").agg(F.max_by(shown, F.struct("date", "tournament_id", "placed", "place", "seat")).alias("last"), F.sum("games").alias("games_played"), *[c.alias(k) for k, c in _merged().items()])
    return people.select("player_id", "last.*", "games_played", F.col("mean").alias("avg_percentage"), F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("stdev_percentage"))


def scale_of(people: DataFrame, min_games: int = 5, min_pool: int = 10) -> DataFrame:
    """One row: mean and deviation of both ratings of those with enough games if they are enough, else of all."""
    aggs: list[Column] = [F.count_if(F.col("games_played") >= min_games).alias("n")]
    for t in ("scratch", "handicap"):
        v, own = F.col(f"{t}_elo"), F.when(F.col("games_played") >= min_games, F.col(f"{t}_elo"))
        aggs += [F.avg(own).alias(f"{t}_m"), F.stddev_pop(own).alias(f"{t}_s"), F.avg(v).alias(f"{t}_am"), F.stddev_pop(v).alias(f"{t}_as")]
    few = F.col("n") < min_pool
    return people.agg(*aggs).select(*[F.when(few, F.col(f"{t}_a{k}")).otherwise(F.col(f"{t}_{k}")).alias(f"_{t}_{k}") for t in ("scratch", "handicap") for k in "ms"])


def scaled(df: DataFrame, scale: DataFrame) -> DataFrame:
    """Results or players with ratings on the display scale of scale_of."""
    rated = {c: "scratch" if "scratch" in c else "handicap" for c in [*RATED, "scratch_pair_elo", "handicap_pair_elo"]}
    columns = rated if RATED[0] in df.columns else {"scratch_elo": "scratch", "handicap_elo": "handicap"}
    new = {}
    for c, t in columns.items():
        x = R.fixed_round(R.clamp(F.lit(R.DISPLAY_MEAN) + (F.col(c) - F.col(f"_{t}_m")) / F.nullif(F.col(f"_{t}_s"), F.lit(0.0)) * R.DISPLAY_SD, 0.0, R.DISPLAY_MAX), 1)
        new[c] = F.when(F.coalesce(F.col(f"_{t}_s"), F.lit(0.0)) <= 0, F.lit(R.DISPLAY_MEAN)).when(F.col(c).isNotNull(), x)
    return df.crossJoin(F.broadcast(scale)).withColumns(new).select(df.columns)  # one row


def standardized(rated: DataFrame, people: DataFrame, min_games: int = 5, min_pool: int = 10) -> tuple[DataFrame, DataFrame]:
    """Both tables with ratings on the display scale of the players' population, of those with enough games if they are enough.

    people, a row a player, are computed once, as they and their scale would otherwise each fold all results."""
    people = checkpointed(people)
    scale = scale_of(people, min_games, min_pool)
    return scaled(rated, scale), scaled(people, scale)
