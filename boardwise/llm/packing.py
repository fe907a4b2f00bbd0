"""Best-fit packing of token pieces into sequences, with several capacities.

Each document becomes pieces: as many full ones as it has, and one shorter. A piece is known to the packer by its
length alone, as its demands (tokens, one document, attention cost) follow from it. So the packer works on the number
of pieces of each length, a table of at most `tokens` rows whatever the corpus, and fills many equal bins at a time:
longest pieces first, each into the open bin whose weighted residuals its demands leave smallest (or meet best, by dot
product) under every capacity. Its plan says which ranks of a length go to which bins; pieces are ranked within their
lengths by a distributed count, and look their bins up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, read_bytes, text_or_empty
from .pieces import of_worker

#: Special strings of the byte_bpe_50k vocabulary; within texts they are their ids, as by the tokenizers library's default.
SPECIAL = {"<|endoftext|>": 50256}
#: Rows of the most frequent length that one task ranks, and shares of a length whose sizes one task adds up.
RANKED, SHARES = 2_000, 2_000


@dataclass(frozen=True)
class Capacity:
    """Of a sequence. attention is the sum of the squared lengths of its pieces; weights are those of the three residuals."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02)
    rule: str = "norm"  # or "dot"


@dataclass
class Plan:
    """Runs by length and rank: ranks from `rank` up to the next run's go to bins from `bin` on, at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins and offsets of pieces, by their lengths and ranks from 0."""
        span = np.int64(1) << 48
        k = np.searchsorted(self.length * span + self.rank, length * span + rank, side="right") - 1
        return self.bin[k] + rank - self.rank[k], self.offset[k]


def plan_bins(counts: dict[int, int], cap: Capacity = Capacity()) -> Plan:
    """counts: pieces by length. Bins of equal residuals are one group, kept as stretches of bin numbers."""
    runs: list[tuple[int, int, int, int]] = []
    groups: dict[tuple[int, int, int], list[list[int]]] = {}
    states = np.empty((0, 3), dtype=np.int64)
    full = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.float64)
    weights, bins = np.array(cap.weights), 0

    def put(state: tuple[int, int, int], first: int, n: int) -> None:
        nonlocal states
        if state[0] <= 0 or state[1] <= 0:
            return  # nothing fits any more
        if state not in groups:
            groups[state] = []
            states = np.vstack([states, state])
        groups[state].append([first, n])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        item = np.array([length, 1, length * length], dtype=np.int64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")

        def stack(state: tuple[int, int, int], first: int, n: int, high: int, length=length, item=item) -> None:
            """Puts `high` pieces into each of n bins."""
            nonlocal rank, left
            for i in range(high):
                runs.append((length, rank, first, cap.tokens - state[0] + i * length))
                rank += n
            left -= n * high
            put(tuple(int(x) for x in np.array(state) - high * item), first, n)

        while left:
            fits = np.flatnonzero((states >= item).all(axis=1))
            if not len(fits):
                most = int(min(full // item))
                state = tuple(int(x) for x in full)
                if n := left // most:
                    stack(state, bins, n, most)
                    bins += n
                elif left:
                    stack(state, bins, 1, left)
                    bins += 1
                continue
            s = states[fits]
            most = (s // item).min(axis=1)
            if cap.rule == "dot":
                score = -((s / full) * (item / full) * weights).sum(axis=1)
            else:
                score = (weights * ((s - most[:, None] * item) / full) ** 2).sum(axis=1)
            best = int(np.argmin(score))
            state, high = tuple(int(x) for x in s[best]), int(most[best])
            stretches = groups[state]
            first, n = stretches.pop()
            take, each = (min(n, left // high), high) if left >= high else (1, left)
            if take < n:
                stretches.append([first + take, n - take])
            if not stretches:
                del groups[state]
                states = states[(states != state).any(axis=1)]
            stack(state, first, take, each)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    return Plan(*(np.ascontiguousarray(table[:, i]) for i in range(4)))


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], end: int, tokens: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32: texts' ids with `end` behind them, cut into pieces of `tokens` at most."""
    content = docs.sparkSession.sparkContext.broadcast(read_bytes(ranks_path))
    last = np.uint32(end).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = of_worker(content.value, pattern, special)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("_text").to_pylist()):
                ids = memoryview(encode(text) + last)
                n = len(ids) // 4
                at = [0, *range(n % tokens or tokens, n + 1, tokens)]
                for k, (a, e) in enumerate(zip(at, at[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(e - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", text_or_empty().alias("_text")).mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def _before(sizes: DataFrame) -> DataFrame:
    """length, share and before, the rows of a length in the shares ahead of one: sums of blocks of shares first, then within blocks."""
    own = sizes.withColumn("block", F.floor(F.col("share") / SHARES))
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, *keys: F.coalesce(F.sum(c).over(ahead(*keys)), F.lit(0))
    blocks = own.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", summed("n", "length", "block").alias("blocks_before"))
    return own.withColumn("within", summed("n", "length", "block", "share")).join(blocks, ["length", "block"]).select("length", "share", (F.col("within") + F.col("blocks_before")).alias("before"))


def pack(items: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """Adds sequence_id and offset to items, which have a length of 1 to cap.tokens and any other columns, whatever their names.

    items is read several times, so it should be checkpointed or written. Sequences have no gaps. Columns of these two names are
    replaced; an empty table gives an empty result.
    """
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # cap.tokens rows at most
    plan = items.sparkSession.sparkContext.broadcast(plan_bins(counts, cap))
    shares = max(1, -(-max(counts.values(), default=0) // RANKED))
    dealt = items.select(F.struct(*kept).alias("own"), F.col("length").alias("length"), F.pmod(F.xxhash64(*kept), F.lit(shares)).alias("share"))
    starts = _before(dealt.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n")))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("own")) - 1).join(starts, ["length", "share"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, at: pd.Series) -> pd.DataFrame:
        bins, offset = plan.value.place(length.to_numpy(dtype=np.int64), at.to_numpy(dtype=np.int64))
        return pd.DataFrame({"sequence_id": bins, "offset": offset})

    return ranked.withColumn("place", place("length", F.col("rank") + F.col("before"))).select("own.*", "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], end: int = 0, cap: Capacity = Capacity()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of docs.

    A very long text is encoded whole by the task that reads it, which holds its ids, four bytes each; its pieces are rows of their own. Null and empty texts are one piece, of the end token. Repeated rows are packed each; a null doc_id is carried along.
    Other columns of docs, whatever their names, don't matter; an empty table gives an empty result.
    """
    return pack(checkpointed(token_pieces(docs, ranks_path, pattern, special, end, cap.tokens)), cap)
