"""Near copies by SimHash: several short fingerprints of a text bring near ones together, exact similarity links them.

One fingerprint of 64 bits doesn't do: at a Jaccard similarity of 0.8, two differ in about 10 bits. So a text has `tables`
fingerprints of `bits` bits, from independent hashes of its shingles. Within each table, fingerprints meet in the middle
as in simhash.py. Two texts of similarity s differ in a bit with a probability of acos(2 s / (1 + s)) / pi; there are
so many tables that a pair of the least similarity is within 4 bits in one of them with a probability of FOUND.

Pairs that meet are verified twice. By a further fingerprint of 64 bits at once, where they meet: it tells chance from
likeness, so that components of such pairs don't grow with the corpus. Then by exact similarity, in each component.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty
from .components import connected_components
from .simhash import RADIUS, SEED, component_ids, keep_smallest, majority, meet_in_the_middle, shingle_hashes

SHINGLE, LEAST, FOUND = 5, 0.8, 0.97
#: Bits of the further fingerprint that may differ: at 0.8, about 10 do, and over 18 with 1 in 500; of unlike texts, 32 do, and
#: 18 or fewer with 1 in 2500.
KEY_BITS = 18
#: Chance meetings of a fingerprint in a table, at most; with more texts than that allows, fingerprints get more bits.
CHANCE = 16
#: Texts that met, up to which their table goes out by broadcast: of 32 bytes a text.
SMALL = 500_000
#: Texts of a component that are compared with each other in one task; a larger one is split into parts of about as many.
PART = 1024
#: Hashes that go out at once.
HELD = 500_000


def table_shape(n: int, least: float = LEAST) -> tuple[int, int]:
    """Bits and tables for n texts."""
    ball = lambda b: sum(math.comb(b, k) for k in range(2 * RADIUS + 1))
    bits = next((b for b in range(32, 64, 4) if n * ball(b) >> b <= CHANCE), 64)
    p = math.acos(2 * least / (1 + least)) / math.pi
    met = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(2 * RADIUS + 1))
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - met))


def _words(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(SEED)
    return tuple(np.array([r.getrandbits(64) | 1 for _ in range(n)], dtype=np.uint64) for _ in range(2))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted; of the whole text if it has no more words than a shingle."""
    parts = [np.unique(h) for h in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *parts]))


def signature(own: np.ndarray, bits: int, tables: int) -> tuple[int, list[int]]:
    """The key and the tables' fingerprints of a set of shingles: signed longs."""
    found = []
    for add, times in zip(*_words(-(-bits * tables // 64))):
        h = (own ^ add) * times
        h ^= h >> np.uint64(29)
        h *= times
        found.append(majority(h ^ h >> np.uint64(32)))
    of_tables = np.zeros((1 + tables, 64), dtype=bool)
    of_tables[0] = majority(own)
    of_tables[1:, :bits] = np.concatenate(found)[: bits * tables].reshape(tables, bits)
    key, *fps = np.packbits(of_tables, axis=1, bitorder="little").view("<i8").ravel().tolist()
    return key, fps


def _node(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def _signatures(docs: DataFrame, shingle: int, bits: int, tables: int) -> DataFrame:
    """doc_id, node (a hash of its shingles), key and fps of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys, fps = [], [], []
            for t in b.column("text"):
                own = shingle_set(t.as_py(), shingle)
                key, of_tables = signature(own, bits, tables)
                nodes.append(_node(own))
                keys.append(key)
                fps.append(of_tables)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(keys, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "node", "key", "fps"])

    sent = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    return sent.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, node long, key long, fps array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """A row (group, i, j, node, own: its shingles' hashes) of texts (text, node, group, tasks) for each of their tasks (i, j).

    A doc_id can stand for other texts than the node's; those are left out."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(x[-1]) for x in rows)])
        own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x[-1] for x in rows]).view(np.int64)))
        columns = [pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, own], names=["group", "i", "j", "node", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for text, node, group, tasks in zip(b.column("text"), *(b.column(c).to_pylist() for c in ("node", "group", "tasks"))):
                own = shingle_set(text.as_py(), shingle)
                for task in tasks if _node(own) == node else ():
                    rows.append((group, task["i"], task["j"], node, own))
                    held += len(own)
                    if held > HELD:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return texts.mapInArrow(run, "group long, i int, j int, node long, own array<long>")


def links_within(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links (i, j) that connect what pairs of similarity `least` or more connect; sets are sorted, none is empty.

    From each set, those it resembles are taken out of the rest and searched from in turn, so that of two sets only
    those in different components are surely compared, and a dense group costs one comparison a set.
    """
    sizes, rest, out = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        queue = [first]
        while queue and len(rest):
            x = queue.pop()
            own, n = sets[x], sizes[x]
            near = rest[np.minimum(sizes[rest], n) / np.maximum(sizes[rest], n) >= least]
            if not len(near):
                continue
            flat = np.concatenate([sets[k] for k in near])
            hit = own[np.minimum(np.searchsorted(own, flat), n - 1)] == flat
            both = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes[near])[:-1]], dtype=np.int64)
            found = near[both / (n + sizes[near] - both) >= least]
            out += [(int(k), int(first)) for k in found]
            queue += found.tolist()
            rest = np.setdiff1d(rest, found, assume_unique=True)
    return out


def candidates(nodes: DataFrame, n: int, bits: int) -> DataFrame:
    """node and group of the nodes (node, key, fps) that meet others: groups are components of verified meetings."""
    keys = nodes.dropDuplicates(["key"]).select("key", F.posexplode("fps").alias("t", "fp"))
    roots = connected_components(meet_in_the_middle(keys, n, bits, KEY_BITS))
    met = nodes.select("node", "key").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    return met.select("node", F.coalesce("root", "key").alias("group"))


def _compared(docs: DataFrame, dealt: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) within the tasks (i, j) of each group; docs are read for the texts of dealt (wanted: a doc_id, node, group, tasks)."""
    if dealt.count() <= SMALL:
        dealt = F.broadcast(dealt)
    own = docs.select("doc_id", text_or_empty().cast("binary").alias("text")).join(dealt, F.col("doc_id").eqNullSafe(F.col("wanted")))
    sent = _sets(own.select("text", "node", "group", "tasks"), shingle)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, first = np.unique(group.column("node").to_numpy(), return_index=True)  # repeated rows are one
        own = group.column("own").combine_chunks()
        flat, ends = own.flatten().to_numpy().view(np.uint64), np.cumsum(own.value_lengths().to_numpy())
        sets = np.split(flat, ends[:-1])
        links = np.array(links_within([sets[k] for k in first], least), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[links[:, 0]]), "b": pa.array(ids[links[:, 1]])})

    return sent.groupBy("group", "i", "j").applyInArrow(run, "a long, b long")


def _task(i: Column, j: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))


def _first_tasks(parts: DataFrame) -> DataFrame:
    """Each part of a group meets the group's part 0, whose texts are its hubs; a group of one part is one task."""
    zero, last = F.lit(0), F.col("n") - 1
    to_all = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: _task(zero, k))
    return parts.withColumn("tasks", F.when(last == 0, F.array(_task(zero, zero))).when(F.col("part") == 0, to_all).otherwise(F.array(_task(zero, F.col("part")))))


def _open_tasks(parts: DataFrame, links: DataFrame) -> DataFrame | None:
    """What is left after the first tasks (parts, of groups with several): texts outside their group's largest component of
    links, in blocks, meet each part but the hubs, which have met all. Of two texts that links don't connect yet, one is
    outside, so each pair of such texts meets. None if nothing is left."""
    at = parts.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = at.groupBy("group", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("group").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
    outside = checkpointed(at.where("part > 0").join(largest, "group").where("root <> largest").select("node", "group"))
    if outside.isEmpty():
        return None
    blocks = outside.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("blocks"))
    left = parts.where("part > 0").join(blocks, "group").join(outside.select("node", F.lit(True).alias("out")), "node", "left")
    block = F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col("blocks"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: _task(b, F.col("part")))
    to_all = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: _task(block, k))
    return checkpointed(left.withColumn("tasks", F.when(F.col("out"), F.array_union(met, to_all)).otherwise(met)).select("wanted", "node", "group", "tasks"))


def _links(docs: DataFrame, nodes: DataFrame, met: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) that connect what similar pairs of a group connect: nodes (node, least: a doc_id), met (node, group).

    Groups are split into parts of about PART texts. A text goes out about twice in the first tasks; what they connect
    needn't meet again, so what goes out after them is in proportion to the texts outside a group's largest component.
    """
    sizes = met.groupBy("group").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wanted = met.join(sizes, "group").join(nodes.select("node", F.col("least").alias("wanted")), "node")
    parts = wanted.withColumn("n", F.ceil(F.col("m") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    parts = checkpointed(parts.select("wanted", "node", "group", "part", "n"))
    links = _compared(docs, _first_tasks(parts), shingle, least)
    split = parts.where("n > 1")
    if split.isEmpty():
        return links
    links = checkpointed(links)
    left = _open_tasks(split, links.join(split.select(F.col("node").alias("a")), "a", "left_semi"))
    return links if left is None else links.union(_compared(docs, left, shingle, least))


def near_copy_groups(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that found pairs of similarity `least` or more reach) for every row of docs.

    No pair below `least` is linked. A very long text is hashed in blocks; what a task holds of it are its distinct shingles' hashes. Null and empty texts and those of white space are copies of each other. Equal sets are one
    node. Repeated rows each have their row; a null doc_id counts for component_id only where a group has no other. Other
    columns, whatever their names, don't matter; an empty table gives an empty result.
    """
    bits, tables = table_shape(docs.count(), least)
    rows = checkpointed(_signatures(docs, shingle, bits, tables))
    nodes = checkpointed(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.any_value(c).alias(c) for c in ("key", "fps"))))
    met = candidates(nodes, nodes.count(), bits)
    of_node = component_ids(nodes, connected_components(_links(docs, nodes, met, shingle, least)), "node")
    return rows.select("doc_id", "node").join(of_node, "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The row with the smallest doc_id of each of near_copy_groups, with docs' columns; what is said there holds."""
    return keep_smallest(docs, near_copy_groups(docs, shingle, least))
