"""Ranked lexical search with inverted treaps.

Documents are searched in shards, each a run of the rows that one task reads, so no posting is shuffled. A term's postings in a
shard form a treap: search order by document, heap order by impact, so the root of a range of documents bounds the impacts
in it. A query walks its terms' treaps together: a range whose summed maxima can't enter the best k goes, any other is
scored at the document with the greatest single maximum and split there.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

#: Terms' weights and impacts: fixed values of the score.
WEIGHT, IMPACT, PER_TF, PER_LENGTH, FLAT, SLOPE = 1000, 1_000_000_000, 1000, 8, 10, 90
#: Documents, and postings, from which a shard is full.
SHARD, POSTINGS = 8192, 1_000_000
#: Terms, and items, that the tasks hold at once; more items are searched for block by block.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 20_000
#: Ranges that are split at once.
FRONTIER = 4096

#: Letters, digits and all that isn't ASCII, with A-Z lowered; any other byte ends a term.
_BYTES = bytes((i + 32 if 65 <= i < 91 else i) if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return text.translate(_BYTES).split()


def weight(n: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n + 2) / (2 * df + 1)))


class Treaps:
    """A shard's treaps, one a term, in common arrays by (term, document); -1 is no node."""

    def __init__(self, slot: np.ndarray, doc: np.ndarray, impact: np.ndarray, size: int) -> None:
        """slot: each posting's term; postings go by slot, then document. size: the shard's documents."""
        self.size, self.key = size, slot.astype(np.int64) * size + doc
        self.doc, self.impact = np.append(doc, -1), np.append(impact, 0)  # at -1: no document, no impact
        left, right, self.root = array("i", [-1]) * (len(slot) + 1), array("i", [-1]) * (len(slot) + 1), {}
        values, firsts = impact.tolist(), np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else []
        for a, b in zip(firsts, [*firsts[1:], len(slot)]):
            spine: list[int] = []  # the right edge of the treap so far
            for i in range(a, b):
                last = -1
                while spine and values[spine[-1]] < values[i]:
                    last = spine.pop()
                left[i] = last
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            self.root[int(slot[a])] = spine[0]
        self.left, self.right = np.array(left), np.array(right)

    def scores(self, docs: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at = slots[None, :] * self.size + docs[:, None]
        found = np.minimum(np.searchsorted(self.key, at), len(self.key) - 1)
        return (self.impact[found] * weights * (self.key[found] == at)).sum(axis=1)

    def _roots(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each node's highest descendant within its range of documents."""
        i, j = np.nonzero(node >= 0)
        v = node[i, j]
        while len(v):
            d = self.doc[v]
            before, out = d < low[i], (d < low[i]) | (d > high[i])
            i, j, v = i[out], j[out], np.where(before, self.right[v], self.left[v])[out]
            node[i, j] = v
            on = v >= 0
            i, j, v = i[on], j[on], v[on]
        return node

    def best(self, wanted: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores above 0 of the k best documents by wanted (weights by term), and the documents; the lower of equal ones first."""
        slots = np.array([s for s in wanted if s in self.root], dtype=np.int64)
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(slots):
            return scores, docs
        weights, least = np.array([wanted[s] for s in slots.tolist()], dtype=np.int64), 1
        todo = [(np.array([[self.root[s] for s in slots.tolist()]]), np.array([0]), np.array([self.size - 1]))]
        while todo:
            node, low, high = todo.pop()
            most = self.impact[node] * weights
            live = most.sum(axis=1) >= least  # an equal score may still have a lower document
            node, most, low, high = node[live], most[live], low[live], high[live]
            if not len(node):
                continue
            at = self.doc[node[np.arange(len(node)), most.argmax(axis=1)]].astype(np.int64)
            scores, docs = np.concatenate([scores, self.scores(at, slots, weights)]), np.concatenate([docs, at])
            if len(scores) > k:
                kept = np.lexsort((docs, -scores))[:k]
                scores, docs = scores[kept], docs[kept]
            if len(scores) == k:
                least = max(1, int(scores.min()))
            node, low, high = np.concatenate([node, node]), np.concatenate([low, at + 1]), np.concatenate([at - 1, high])
            some = low <= high
            node, low, high = self._roots(node[some], low[some], high[some]), low[some], high[some]
            todo += [(node[i : i + FRONTIER], low[i : i + FRONTIER], high[i : i + FRONTIER]) for i in range(0, len(node), FRONTIER)]
        order = np.lexsort((docs, -scores))[:k]
        order = order[scores[order] > 0]
        return scores[order], docs[order]


def index_shards(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row a shard: doc_ids and lengths (terms) of its documents by doc_id, and its postings of the vocabulary's terms.

    Postings are sorted by term, then document: slots (places in the vocabulary), places (in doc_ids), counts."""
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, lengths, slots, places, counts = sent.value, [], [], array("i"), array("i"), array("i")

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
            place = np.empty(len(ids), np.int32)
            place[order] = np.arange(len(ids))
            s, p, c = np.array(slots), place[np.array(places, dtype=np.int32)], np.array(counts)
            by = np.lexsort((p, s))
            row = [[ids[i] for i in order], np.array(lengths)[order], s[by], p[by], c[by]]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        names = ["doc_ids", "lengths", "slots", "places", "counts"]
        types = [pa.list_(x) for x in (None, pa.int64(), pa.int32(), pa.int32(), pa.int32())[1:]]
        for b in batches:
            types = [pa.list_(b.column("doc_id").type), *types[-4:]]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("_bytes")):
                found = Counter(terms(text.as_py()))
                for t in found.keys() & known.keys():
                    slots.append(known[t])
                    places.append(len(ids))
                    counts.append(found[t])
                ids.append(doc_id)
                lengths.append(found.total())
                if len(ids) == SHARD or len(slots) >= POSTINGS:
                    yield flush()
                    ids, lengths, slots, places, counts = [], [], array("i"), array("i"), array("i")
        if ids:
            yield flush()

    return docs.select("doc_id", text_or_empty().cast("binary").alias("_bytes")).mapInArrow(run, f"doc_ids array<{kind}>, lengths array<long>, slots array<int>, places array<int>, counts array<int>")


def _search(index: DataFrame, items: list[tuple], n: int, total: int, weights: list[int], k: int, kinds: tuple[str, str]) -> DataFrame:
    """(item, doc_id, score) of the k best of each shard for each item (slots of its terms)."""
    sent = index.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight_of = sent.value
        for b in batches if queries else ():
            for row in range(b.num_rows):
                ids, lengths, slots, places, counts = (b.column(c)[row].values for c in ("doc_ids", "lengths", "slots", "places", "counts"))
                m = FLAT + SLOPE * lengths.to_numpy() * n // max(total, 1)
                doc, tf = places.to_numpy(), counts.to_numpy().astype(np.int64)
                own = Treaps(slots.to_numpy(), doc, IMPACT * tf // (PER_TF * tf + PER_LENGTH * m[doc]), len(ids))
                found = [own.best({s: weight_of[s] for s in wanted}, k) for wanted in queries]
                item = np.repeat(np.arange(len(queries)), [len(s) for s, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(np.concatenate([d for _, d in found]))), pa.array(np.concatenate([s for s, _ in found]))], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, f"item long, doc_id {kinds[1]}, score long")


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The best k for items (item_id, terms) of a bounded number with a bounded vocabulary, which are broadcast."""
    spark, rows = docs.sparkSession, items.collect()
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
    index = checkpointed(index_shards(docs, vocabulary))
    n, total = index.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(index.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect())  # a row a term of the block
    weights = [weight(n, holding.get(i, 0)) for i in range(len(vocabulary))]
    kinds = (dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"])
    found = _search(index, [[vocabulary[bytes(t)] for t in r.terms] for r in rows], n, total, weights, k, kinds)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {kinds[0]}")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and terms, each once; rows with the same item_id are one item. Items without a term have no row."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(terms(t.as_py()))) for t in b.column("_bytes")]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(own, pa.list_(pa.binary()))], names=["item_id", "terms"])

    each = items.select("item_id", text_or_empty().cast("binary").alias("_bytes")).mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return each.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms")).where(F.size("terms") > 0)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the k documents (doc_id, text) that score highest for each item (item_id, text).

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lowered; the score is that of the contract of op13, in
    whole numbers. Null and empty texts have no terms: such documents are in no result, and such items have no row. Every row of
    docs is a document, so repeated rows take a place each; equal scores go by doc_id, a null one last. Very long texts count
    whole. Other columns, whatever their names, don't matter; an empty table on either side gives an empty result.

    Each document is read once for its terms, if the items' terms fit one block (BLOCK_TERMS, BLOCK_ITEMS); more items are
    dealt by hash to as many blocks as hold them, each with a pass of its own over the documents.
    """
    own = checkpointed(item_terms(items))
    n, postings = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, math.ceil(2 * postings / BLOCK_TERMS), math.ceil(2 * n / BLOCK_ITEMS))  # twice as many as needed, as hashes deal unevenly
    blocks = 1 if postings <= BLOCK_TERMS and n <= BLOCK_ITEMS else blocks
    dealt = own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = _block(docs, dealt.where(F.col("block") == b).drop("block"), k)
        out = part if out is None else out.unionByName(part)
    return out
