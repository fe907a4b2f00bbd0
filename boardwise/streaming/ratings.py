"""The Elo fold over a stream of results: ratings of a pool as keyed state, sessions closed by event-time timers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import history

#: The state store that keyed state with timers needs; set it before the query starts.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
COLUMNS = ["date", "tournament_id", "row_seq", "player1_id", "player2_id", "scratch_percentage", "handicap_percentage"]


class _Pool(StatefulProcessor):
    """State of a pool: ratings by player, and the rows of sessions that are still open."""

    def __init__(self, by: Sequence[str], kept: Sequence[str], schema: str, late_ms: int) -> None:
        self.by, self.kept, self.schema, self.late_ms = list(by), list(kept), schema, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getMapState("ratings", "player string", "scratch double, handicap double")
        self.held = handle.getListState("held", self.schema)

    def _closes(self, at: dt.datetime) -> int:
        return int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) + self.late_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.kept) for r in rows]
        self.held.appendList(new)
        known = set(self.handle.listTimers())
        for when in {self._closes(r[0]) for r in new} - known:
            self.handle.registerTimer(when)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Folds all sessions that are closed by now, in order; timers of the same batch then find none left."""
        now = timerValues.getCurrentWatermarkInMs()
        every = [tuple(r) for r in self.held.get()]
        done, open_ = [r for r in every if self._closes(r[0]) <= now], [r for r in every if self._closes(r[0]) > now]
        if not done:
            return
        self.held.put(open_) if open_ else self.held.clear()
        at = {c: self.kept.index(c) for c in COLUMNS}
        done.sort(key=lambda r: tuple((r[at[c]] is not None, r[at[c]]) for c in COLUMNS))  # nulls first
        scratch, handicap = {}, {}
        for p in {p for r in done for p in (r[at["player1_id"]], r[at["player2_id"]]) if p}:
            if self.ratings.containsKey((p,)):
                scratch[p], handicap[p] = self.ratings.getValue((p,))
        start = 0
        while start < len(done):
            end = start
            session = (done[start][at["date"]], done[start][at["tournament_id"]])
            while end < len(done) and (done[end][at["date"]], done[end][at["tournament_id"]]) == session:
                end += 1
            own = done[start:end]
            rated = history.fold_session([tuple(r[at[c]] for c in COLUMNS[3:]) for r in own], scratch, handicap)
            for r, values in zip(own, rated):
                yield Row(**dict(zip(self.by, key)), **dict(zip(self.kept[1:], r[1:])), **dict(zip(history.OUT, values)))
            start = end
        for p in scratch:
            self.ratings.updateValue((p,), (scratch[p], handicap[p]))


def fold_stream(results: DataFrame, by: Sequence[str], late: str = "2 hours", late_ms: int = 7_200_000, keep: Sequence[str] = ()) -> DataFrame:
    """A stream of results, rated as history.fold rates them: by, history's order and inputs, keep's columns, and history.OUT.

    A session is rated once the watermark has passed its date by `late_ms`, so its rows, in any batch and order, are together
    by then, as long as they come within `late` of it; what comes later Spark drops. Rows without a date have no
    place in a stream and are left out. State is a rating for each player of a pool and the rows of open sessions; it lives in the query's
    checkpoint, from which a restart goes on. Set the session's state store by PROVIDER.
    """
    known = history.with_percentages(results)
    at = F.to_timestamp(F.substring("date", 1, 19))
    kept = list(dict.fromkeys([*COLUMNS, *keep]))
    ids = {f"player{i}_id": F.nullif(F.col(f"player{i}_id").cast("string"), F.lit("")) for i in (1, 2)}
    numbers = {"scratch_percentage": F.col("scratch_percentage").cast("double"), "handicap_percentage": F.col("handicap_percentage").try_cast("double")}
    rows = known.withColumns(ids | numbers).withColumn("event_at", at).where("event_at is not null").withWatermark("event_at", late).select(*by, "event_at", *kept)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["event_at", *kept])
    out = ", ".join([*(f"{c} {kinds[c]}" for c in [*by, *kept]), *(f"{c} double" for c in history.OUT)])
    return rows.groupBy(*by).transformWithState(_Pool(by, ["event_at", *kept], schema, late_ms), out, "Append", "EventTime")
