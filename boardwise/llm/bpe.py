"""Byte-level BPE: each distinct pre-token of the corpus is encoded once, and texts are put together from the ids.

1. A task cuts blocks of texts into pre-tokens. A block keeps its distinct pre-tokens, numbered, and their numbers by
   position: the explosion into (position, pre-token), coded by dictionary. What stands between spaces repeats,
   so positions name such stretches, and a table has the pre-tokens of each. Blocks are shuffled by name.
2. The pre-tokens alone are shuffled on, by their hash: all blocks' rows of a pre-token meet in one task, which encodes it once
   and joins the ids to each block's number. A pre-token has one row a block, so even the commonest is no hot key.
3. The ids return to their blocks, which wait where they are, and fill the positions.

Decoding joins ids with the token-byte table, whose size is the vocabulary's, by broadcast.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_bytes, text_or_empty
from .pieces import cut_text, encoding, ranks_of

#: Characters of a block's texts; a longer text is a block of its own.
BLOCK = 12_000_000
#: Parts that distinct pre-tokens go to by hash, for each shuffle partition. A task has one part's in memory at a time.
PARTS = 2


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers by byte plane, compressed."""
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(raw.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _strings(items: list[bytes]) -> bytes:
    return zstandard.compress(_lengths(items) + b"".join(items), 3)


def _lengths(items: list[bytes]) -> bytes:
    return np.array([len(items), *map(len, items)], dtype="<u4").tobytes()


def _strings_of(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    starts = np.r_[4 * (n + 1), ends[:-1]] if n else ends
    return [raw[a:e] for a, e in zip(starts.tolist(), ends.tolist())]


class _Stretches(dict):
    """Numbers of stretches. The pattern sees each distinct one of a block once; its pre-tokens go to the block's table."""

    def __init__(self, block: _Block, before: str):
        super().__init__()
        # The block itself is not kept: as a cycle it would outlive its rows until a full garbage collection.
        self.find, self.numbers, self.lengths, self.words, self.before = block.find, block.numbers, block.lengths, block.words, before

    def __missing__(self, key: str) -> int:
        words, own = self.find(self.before + key), self.numbers
        n = self[key] = len(self.lengths)
        self.lengths.append(len(words))
        self.words.extend([own.setdefault(w, len(own)) for w in words])
        return n


class _Block:
    """Texts' stretches by position, stretches' pre-tokens, and the distinct pre-tokens."""

    def __init__(self, find: Callable[[str], list[str]]):
        self.find = find
        self.numbers: dict[str, int] = {}
        self.lengths, self.words = array("I"), array("I")
        self.plain, self.spaced = _Stretches(self, ""), _Stretches(self, " ")
        self.codes: list[np.ndarray] = []
        self.ids: list = []
        self.chars = 0

    def add(self, doc_id, text: str) -> None:
        plain, spaced, found = self.plain, self.spaced.__getitem__, []
        for k, (first, *rest) in enumerate(cut_text(text)):
            if k:
                found.append(plain["\n"])
            if first:
                found.append(plain[first])
            found.extend(map(spaced, rest))
        self.codes.append(np.array(found, dtype=np.uint32))
        self.ids.append(doc_id)
        self.chars += len(text) + 100

    def rows(self, block: str, parts: int) -> Iterator[tuple]:
        """One row with positions (part -1), and one for each part of the distinct pre-tokens.

        Numbers go by frequency here, so that most are small; a part's are sorted, and sent as differences.
        """
        words = [w.encode() for w in self.numbers]
        part = np.array([zlib.crc32(w) % parts for w in words], dtype=np.int64)
        flat = np.concatenate(self.codes)
        lengths, inner = np.array(self.lengths, dtype=np.int64), np.array(self.words, dtype=np.int64)
        times = np.bincount(flat, minlength=len(lengths))
        order, rank = _by_frequency(times)
        word_order, word_rank = _by_frequency(np.bincount(inner, np.repeat(times, lengths), len(words)))
        starts = np.cumsum(lengths) - lengths
        own = lengths[order]
        at = np.repeat(starts[order] - (np.cumsum(own) - own), own) + np.arange(len(inner))
        table = [_packed(own), _packed(word_rank[inner[at]])]
        sizes = np.array([len(c) for c in self.codes])
        yield block, -1, self.ids, _strings([_packed(sizes), *table]), _packed(rank[flat])
        sent = part[word_order]
        for p in np.unique(part):
            mine = word_order[sent == p]
            yield block, int(p), [], _packed(np.diff(word_rank[mine], prepend=0)), _strings([words[i] for i in mine.tolist()])


def _by_frequency(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from the most frequent on, and the place of each there."""
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return order, rank


def _cut(docs: DataFrame, pattern: str, parts: int, size: int) -> DataFrame:
    """Blocks' rows. Blocks are named by partition and number, so a lost task's are made anew as they were: a scan's rows keep
    their partitions and order. What has no such order must be written or checkpointed before."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, at, made = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0

        def out(block: _Block) -> Iterator[pa.RecordBatch]:
            for name, part, ids, sizes, data in block.rows(f"{at}-{made}", parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([part], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.binary()), pa.array([data], pa.binary())],
                    names=["block", "part", "ids", "sizes", "data"],
                )

        block, id_type = _Block(find), pa.int64()
        for b in batches:
            id_type = b.column("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("_text")):
                text = text.as_py()
                if block.ids and block.chars + len(text) > size:
                    yield from out(block)
                    block, made = _Block(find), made + 1
                block.add(doc_id, text)
        if block.ids:
            yield from out(block)

    return docs.select("doc_id", text_or_empty().alias("_text")).mapInArrow(run, f"block string, part int, ids array<{kind}>, sizes binary, data binary")


def _words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pre-tokens, as a function so that the filter stays behind the shuffle that both branches read."""
    for b in batches:
        yield b.filter(pc.greater_equal(b.column("part"), 0)).select(["block", "part", "sizes", "data"])


def _encode_distinct(words: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """words' rows with each pre-token replaced by its ids. All rows of a part stand together in one task, so each distinct
    pre-token is encoded once, and only one part's ids are held."""
    content = words.sparkSession.sparkContext.broadcast(read_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, at = encoding(content.value, pattern).encode_ordinary, {}, None
        for b in batches:
            out = []
            for part, data in zip(b.column("part").to_pylist(), b.column("data")):
                if part != at:
                    known, at = {}, part
                ids = []
                for w in _strings_of(data.as_py()):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = np.array(encode(w.decode()), dtype="<u4").tobytes()
                    ids.append(got)
                out.append(_strings(ids))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("sizes"), pa.array(out, pa.binary())], names=["block", "numbers", "data"])

    return words.sortWithinPartitions("part").mapInArrow(run, "block string, numbers binary, data binary")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, parts: int | None = None, block: int = BLOCK, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row of docs; with `decoded`, also the
    bytes that the ids stand for, by the token-byte table, in the task that has the ids at hand.

    Each match of pattern is encoded separately and no string is special. Null and empty texts have no ids. Repeated
    rows each have their row, null doc_ids are carried along, other columns don't matter, and an empty table gives an
    empty result. No block but that of a longer text has more than `block` characters, and parts follow the shuffle
    partitions, so what a task holds does not grow with the corpus.
    """
    kind = dict(docs.dtypes)["doc_id"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _cut(docs, pattern, parts or PARTS * partitions, block)
    kept = rows.repartition(partitions, "block")  # both branches below read this one shuffle
    words = kept.mapInArrow(_words_only, "block string, part int, sizes binary, data binary").repartition(partitions, "part")
    ids = _encode_distinct(words, ranks_path, pattern)
    sent = docs.sparkSession.sparkContext.broadcast(token_bytes(ranks_path)) if decoded else None

    def fill(own: pa.Table, tokens: pa.Table) -> pa.Table:
        own = own.filter(pc.less(own.column("part"), 0))
        numbers = [_unpacked(x.as_py()) for x in tokens.column("numbers")]
        table = [b""] * sum(map(len, numbers))
        for places, data in zip(numbers, tokens.column("data")):
            for i, got in zip(np.cumsum(places).tolist(), _strings_of(data.as_py())):
                table[i] = got
        sizes, lengths, inner = map(_unpacked, _strings_of(own.column("sizes")[0].as_py()))
        stretches, at = [], 0
        for n in lengths.tolist():
            stretches.append(b"".join([table[w] for w in inner[at : at + n].tolist()]))
            at += n
        codes, ends = _unpacked(own.column("data")[0].as_py()), np.cumsum(sizes, dtype=np.int64)
        out = [b"".join([stretches[c] for c in codes[e - n : e].tolist()]) for n, e in zip(sizes.tolist(), ends.tolist())]
        doc_ids = own.column("ids")[0].values
        columns = {"doc_id": doc_ids, "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())}
        if sent is not None:
            columns["decoded"] = pa.array([_decode(x, sent.value) for x in out], pa.binary())
        return pa.table(columns)

    schema = f"doc_id {kind}, n_tokens long, ids binary" + (", decoded binary" if decoded else "")
    return kept.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(fill, schema)


def token_bytes(ranks_path: str) -> list[bytes]:
    """Bytes by id; ids without a token have none."""
    ranks = ranks_of(read_bytes(ranks_path))
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def _decode(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with a binary column `decoded`, the bytes that ids stand for; null ids give null.

    The table has the vocabulary's size. Repeated rows and other columns stay; an empty table gives an empty result.
    """
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks_path))

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _decode(x, table.value) for x in ids], dtype="object")

    return encoded.withColumn("decoded", decode("ids"))
