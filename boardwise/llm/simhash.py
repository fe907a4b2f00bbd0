"""Near-duplicates by SimHash: fingerprints that differ in few bits are linked by meeting in the middle.

Two fingerprints at most 2r bits apart have a word at most r bits from either. So every fingerprint emits all words
within r bits (its variants), and fingerprints with a common variant are linked. A variant's prefix, some of its
bits, goes through the shuffle in place of it: a fingerprint goes once to each prefix that its variants have, and the task of
a prefix makes the variants that have it. That is each variant once in all, with a fraction of the shuffle. Prefixes grow
with the number of fingerprints, and those that still hold many go out again by more bits, so no task has an unbounded group.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty
from .components import connected_components

SEED, SHINGLE, RADIUS, BITS = 42, 4, 2, 64
#: Variants that a task holds at once; a prefix with more is worked through by longer prefixes.
AT_ONCE = 2_000_000
#: Fingerprints and variants that a prefix has about, at most; fingerprints from which it is dealt out again by MORE bits.
GROUP, VARIANTS, HOT, LEAST_BITS, MORE = 2_000_000, 50_000_000, 8_000_000, 4, 6
#: Shingles whose bits are counted at once; bytes of a text whose words are held at once.
BLOCK, CHARS = 1 << 15, 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, shingle: int = SHINGLE, block: int = CHARS) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in order, for a block of its bytes at a time; of the whole text if it has no more words than a shingle."""
    text, digest = text.lower(), xxhash.xxh64_intdigest  # of bytes: A-Z only
    carried: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        end = _GAP.search(text, at + block)
        end = len(text) if end is None else end.start()
        words = [*carried, *text[at:end].split()]  # at the six characters of white space
        at = end
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = [n - 1 for n in accumulate(len(w) + 1 for w in words)]
            starts = [0, *(e + 1 for e in ends)]
            yield np.array([digest(joined[a:e], SEED) for a, e in zip(starts, ends[shingle - 1 :])], dtype="<u8")
            some = True
        carried = words[-(shingle - 1) :] if shingle > 1 else []
    if carried and not some:
        yield np.array([digest(b" ".join(carried), SEED)], dtype="<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles; 0 for a text without a word."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        counts += bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each of the 64 bits is set."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of each of the 64 bits, whether it is set in over half the hashes."""
    return 2 * bit_counts(hashes) > len(hashes)


def with_fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """keep's columns of docs and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_bytes")
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(fps)], names=[*keep, "fp"])

    sent = docs.select(*keep, text_or_empty().cast("binary").alias("_bytes"))
    kinds = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep)
    return sent.mapInArrow(run, f"{kinds}, fp long")


def flips(bits: tuple[int, ...], n: int) -> list[int]:
    """Words with exactly n of the given bits set."""
    return [sum(1 << i for i in c) for c in combinations(bits, n)]


@cache
def _flips(bits: tuple[int, ...], n: int) -> np.ndarray:
    return np.array([x for k in range(n + 1) for x in flips(bits, k)], dtype=np.uint64)


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _meetings(fps: np.ndarray, left: np.ndarray, ids: np.ndarray, free: tuple[int, ...], near: Near) -> Iterator[np.ndarray]:
    """Verified pairs of ids that share a variant: fps may still change in `left` of the free bits.

    Of each variant's group, all are held against the first; those that are not near it are a group of their own then.
    """
    sizes = [1 + len(free) * (n > 0) + len(free) * (len(free) - 1) // 2 * (n > 1) for n in range(RADIUS + 1)]
    if len(fps) < 2:
        return
    if free and sum(int((left == n).sum()) * s for n, s in enumerate(sizes)) > AT_ONCE:
        bit, rest = np.uint64(1 << free[0]), free[1:]
        for value in (np.uint64(0), bit):
            differs = (fps & bit) != value
            stays = (left > 0) | ~differs
            yield from _meetings((fps[stays] & ~bit) | value, (left - differs)[stays], ids[stays], rest, near)
        return
    variants, owners = [], []
    for n in range(RADIUS + 1):
        own = left == n
        masks = _flips(free, n)
        variants.append((fps[own][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(ids[own], len(masks)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    while (same := v[1:] == v[:-1]).any():
        first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(v)), 0))
        k = np.flatnonzero(same) + 1
        ok = near(o[first[k]], o[k])
        if ok.any():
            yield np.unique(np.stack([o[first[k[ok]]], o[k[ok]]], axis=1), axis=0)
        v, o = v[k[~ok]], o[k[~ok]]


def forest(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Smallest index that pairs, and what root connects already, connect each index with."""
    root = root.copy()
    while True:
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        if (a == b).all():
            return root
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def bucket_links(fps: np.ndarray, bucket: int, mask: int, bits: int = BITS, near: Near | None = None) -> np.ndarray:
    """Links within one prefix: the places of each linked fingerprint and of one that stands for its group.

    Every pair is verified by its fingerprints' distance, and by near if given.
    """
    free = tuple(i for i in range(bits) if not mask >> i & 1)
    mask_, bucket_ = np.uint64(mask), np.uint64(bucket)
    within = lambda a, b: np.bitwise_count(fps[a] ^ fps[b]) <= 2 * RADIUS
    verified = within if near is None else lambda a, b: within(a, b) & near(a, b)
    left = RADIUS - np.bitwise_count((fps & mask_) ^ bucket_).astype(np.int64)
    root = np.arange(len(fps))
    for pairs in _meetings((fps & ~mask_) | bucket_, left, np.arange(len(fps)), free, verified):
        root = forest(root, pairs)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return np.stack([linked, root[linked]], axis=1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits: list[int]) -> int:
    return sum(1 << i for i in bits)


def _dealt(rows: DataFrame, prefix: list[int]) -> DataFrame:
    """rows with a bucket for each way to give the bits of `prefix` values that take no more than `left` changes."""
    own = F.col("fp").bitwiseAND(F.lit(_signed(_mask(prefix))))
    ways = [F.struct(own.bitwiseXOR(F.lit(_signed(x))).bitwiseOR(F.col("bucket")).alias("bucket"), (F.col("left") - k).alias("left")) for k in range(RADIUS + 1) for x in flips(tuple(prefix), k)]
    kept = [c for c in rows.columns if c not in ("bucket", "left")]
    return rows.select(*kept, F.inline(F.filter(F.array(*ways), lambda w: w["left"] >= 0)))


def prefix_bits(n: int, bits: int) -> int:
    """Bits of prefix for n fingerprints, by what a prefix then has of them and of their variants."""
    size, ball = LEAST_BITS, 1 + bits + bits * (bits - 1) // 2
    while size < bits and (n * (1 + size + size * (size - 1) // 2) >> size > GROUP or n * ball >> size > VARIANTS):
        size += 1
    return size


def meet_in_the_middle(rows: DataFrame, n: int, bits: int = BITS, key_bits: int | None = None) -> DataFrame:
    """Links (a, b) that connect what is connected among the fingerprints of a table: rows are (t, fp) of up to 64 `bits`, n
    or fewer in a table t, and those are linked that differ in 4 bits or fewer.

    With key_bits, rows also have a key of 64 bits: links are between keys, and theirs too differ in no more than key_bits.
    """
    kept = ["fp"] if key_bits is None else ["fp", "key"]
    order = [i * 29 % bits for i in range(bits)]  # 29 has no factor in common with 32 to 64, but for 58
    at = [prefix_bits(n, bits)]
    levels = [_dealt(rows.withColumns({"bucket": F.lit(0).cast("long"), "left": F.lit(RADIUS)}), order[: at[0]])]
    while at[-1] < bits:
        own = levels[-1]
        hot = checkpointed(own.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT).select("t", "bucket"))
        if hot.isEmpty():
            break
        levels[-1] = own.join(hot, ["t", "bucket"], "left_anti")
        levels.append(_dealt(own.join(hot, ["t", "bucket"], "left_semi"), order[at[-1] : at[-1] + MORE]))
        at.append(min(bits, at[-1] + MORE))
    masks = [_mask(order[:x]) for x in at]
    sent = levels[0].select("t", "bucket", *kept, F.lit(0).alias("level"))
    for i, more in enumerate(levels[1:], 1):
        sent = sent.unionByName(more.select("t", "bucket", *kept, F.lit(i).alias("level")))

    def links(group: pa.Table) -> pa.Table:
        fps, keys = (group.column(c).to_numpy().view(np.uint64) for c in (kept[0], kept[-1]))
        near = None if key_bits is None else lambda a, b: np.bitwise_count(keys[a] ^ keys[b]) <= key_bits
        bucket, mask = group.column("bucket")[0].as_py() & (1 << 64) - 1, masks[group.column("level")[0].as_py()]
        out = keys[bucket_links(fps, bucket, mask, bits, near)].view(np.int64)
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    return sent.groupBy("t", "level", "bucket").applyInArrow(links, "a long, b long").where("a <> b").distinct()


def fingerprint_links(fps: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that connect what is connected among the distinct fingerprints fp, n of them."""
    return meet_in_the_middle(fps.select(F.lit(0).alias("t"), "fp"), n)


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest doc_id that links reach) for every row of docs.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Equal
    fingerprints are one node, so copies make no pairs. Repeated rows each have their row; a null doc_id counts for
    component_id only where a group has no other. Other columns, whatever their names, don't matter; an empty table gives
    an empty result. A very long text is hashed in blocks of CHARS bytes.
    """
    rows = checkpointed(with_fingerprints(docs, "doc_id", shingle=shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of_fp = component_ids(nodes, connected_components(fingerprint_links(nodes.select("fp"), nodes.count())), "fp")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_ids(nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """nodes' keys and component_id, the smallest `least` of the component that roots (node, root) puts a node in."""
    own = nodes.select(F.col(key), "least").join(roots.select(F.col("node").alias(key), "root"), key, "left")
    own = own.select(key, F.coalesce("root", key).alias("root"), "least")
    groups = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.select(key, "root").join(groups, "root").select(key, "component_id")


def keep_smallest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the component_id of groups (doc_id, component_id), with docs' columns. A null doc_id
    stays where its group has no other; of repeated rows, all stay."""
    own = docs.select(F.col("doc_id").alias("key"), F.struct(*docs.columns).alias("row"))
    stay = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("stay"))
    return own.join(stay, F.col("key").eqNullSafe(F.col("stay")), "left_semi").select("row.*")
