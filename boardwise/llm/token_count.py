"""Token counts of whole texts for a SentencePiece BPE model with byte fallback.

No piece of the model holds a space mark behind another character, so merges never cross the start of a run of
spaces, and a newline, which has only its byte piece, never merges at all. A text's count is therefore the sum
of the counts of its pre-tokens: runs of spaces with what follows them, cut at newlines. Those counts come from two
tiers, both on the map side: a broadcast table of frequent pre-tokens, of at most `frequent` entries, and behind it
a cache in each Python worker, which encodes what it misses. No document's pre-tokens are shuffled to be counted; only to choose
the table, tasks send the frequent ones of a small sample of documents, with their counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, read_bytes, text_or_empty

MARK, NEWLINE = "\u2581", "\ue000"  # the model's space mark; stands for a newline that no space precedes
#: Entries of the frequent tier, the share of documents it is taken from, each partition's part of the candidates,
#: and entries of a worker's cache. They change the speed only, never a count.
FREQUENT, SAMPLE, PART, CACHE = 20_000, 0.01, 50_000, 300_000

_spaced = re.compile(" +[^ ]*")
_workers: dict[int, "Lengths"] = {}


def pre_tokens(text: str) -> list[str] | None:
    """Pre-tokens without their first space; None if the text can't be cut (it holds the stand-in character)."""
    if NEWLINE in text:
        return None
    text = text.replace(MARK, " ")
    if "  " in text or " \n" in text or text[:1] in (" ", "\n") or text[-1:] == " ":
        return [x[1:] for x in _spaced.findall(" " + text)] if text else []
    return text.replace("\n", f" {NEWLINE}").split(" ") if text else []


class Lengths(dict):
    """Token counts by pre-token; encodes what is missing, and starts afresh when it holds more than CACHE entries."""

    def __init__(self, model: bytes):
        import sentencepiece

        super().__init__()
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode

    def __missing__(self, key: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        # A newline first keeps the model from adding its own space mark to the pre-token: mark and newline are two tokens.
        plain = "\n" + key[1:] if key[:1] == NEWLINE else "\n " + key
        n = self[key] = len(self.encode(plain)) - (1 if key[:1] == NEWLINE else 2)
        return n


def text_length(text: str, frequent: dict[str, int], rest: Lengths) -> int:
    keys = pre_tokens(text)
    if keys is None:
        return len(rest.encode(text))
    get = frequent.get
    return sum([n if (n := get(k)) is not None else rest[k] for k in keys])


def _of_worker(model: bytes) -> Lengths:
    if hash(model) not in _workers:
        _workers.clear()
        _workers[hash(model)] = Lengths(model)
    return _workers[hash(model)]


def frequent_lengths(docs: DataFrame, model: bytes, text: str = "text", share: float = SAMPLE, most: int = FREQUENT) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample of documents.

    At most `most` entries reach the driver, from all tasks together: counts are first put into levels, an eighth of a doubling
    each, and whole levels are taken from the top as long as they fit.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(pre_tokens(t) or ())
                if len(seen) > 4 * PART:
                    seen = Counter(dict(seen.most_common(PART)))
        top = seen.most_common(PART)
        yield pa.RecordBatch.from_pydict({"pre_token": pa.array([k for k, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    sample = docs.select(text_or_empty(text).alias("text")).sample(share, seed=17)
    counted = sample.mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n")).where("length(pre_token) <= 64")
    counted = checkpointed(counted.withColumn("level", F.floor(8 * F.log2("n")).cast("int")))
    taken, least = 0, None
    for r in sorted(counted.groupBy("level").count().collect(), reverse=True):  # 8 * 64 levels at most
        taken += r["count"]
        if taken > most:
            break
        least = r["level"]
    top = counted.where(F.col("level") >= least).select("pre_token").collect() if least is not None else []
    lengths = Lengths(model)
    return {r.pre_token: lengths[r.pre_token] for r in top}


def token_counter(docs: DataFrame, model_path: str, text: str = "text", **tier: float) -> Column:
    """Column of the token counts of docs' texts (null: 0)."""
    model = read_bytes(model_path)
    send = docs.sparkSession.sparkContext.broadcast
    frequent, model_sent = send(frequent_lengths(docs, model, text, **tier)), send(model)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        rest = _of_worker(model_sent.value)
        return pd.Series([text_length(t, frequent.value, rest) for t in texts], dtype="int64")

    return count(text_or_empty(text))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs.

    Null and empty texts have 0 bytes and 0 tokens; a very long text is counted whole, by one task. Repeated rows each have their row, and other columns, whatever
    their names, don't matter. An empty table gives an empty result.
    """
    t = text_or_empty()
    out = docs.select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), token_counter(docs, model_path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
