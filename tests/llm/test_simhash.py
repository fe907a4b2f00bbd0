import random
import re
from collections import Counter

import numpy as np
import xxhash

from boardwise.llm import simhash
from boardwise.llm.components import connected_components

from .cases import SCHEMA, TEXTS, by_id, clashing, documents


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes) > 0)


def brute_groups(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in values}


def near_texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        own = [r.choice(words) for _ in range(150)]
        out.append(" ".join(own))
        for k in (1, 1, 2, 4):
            other = own[:]
            for _ in range(k):
                other[r.randrange(len(other))] = r.choice(words)
            out.append(" ".join(other))
    return out


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = TEXTS + near_texts()
    got = by_id(simhash.near_duplicate_groups(clashing(documents(spark, texts))))
    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_groups(fps)
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(roots[f], i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", least[roots[f]]) for i, f in enumerate(fps)}
    assert len({r.component_id for r in got.values()}) < len(texts) - 10


def test_every_pair_within_the_radius_is_connected(monkeypatch):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(60)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for c in centres for _ in range(6)}
    mask = sum(1 << i for i in (0, 9, 30, 63))
    wanted = brute_groups(fps)
    for most in (2_000_000, 3_000):
        monkeypatch.setattr(simhash, "AT_ONCE", most)
        root = {f: f for f in fps}
        for bucket in {(f & mask) ^ x for f in fps for k in range(3) for x in simhash.flips((0, 9, 30, 63), k)}:
            own = np.array([f for f in fps if ((f & mask) ^ bucket).bit_count() <= 2], dtype=np.uint64)
            for a, b in own[simhash.bucket_links(own, bucket, mask)]:
                x, y = root[int(a)], root[int(b)]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        assert root == wanted


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i + 1, i) for i in range(40)] + [(1000 + i, 1000) for i in range(1, 50)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}, **{2000 + i: 2000 for i in range(9)}}


def test_hot_prefixes_are_dealt_out_again(spark, monkeypatch):
    """A dense cluster of distinct fingerprints, in prefixes far above the bound."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(400)} | {r.getrandbits(64) for _ in range(100)}
    monkeypatch.setattr(simhash, "HOT", 40)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {x.node & (1 << 64) - 1: x.root for x in connected_components(simhash.fingerprint_links(df, len(fps))).collect()}
    want = brute_groups(fps)
    size = Counter(want.values())
    assert set(got) == {f for f in fps if size[want[f]] > 1}
    assert {frozenset(f for f in got if got[f] == x) for x in got.values()} == {frozenset(f for f in got if want[f] == x) for x in {want[f] for f in got}}


def test_keeping_one_of_each_group(spark):
    docs = clashing(documents(spark, ["a b c d e f g", "a b c d e f g", None, None, "quite another text than the first one"]))
    kept = simhash.keep_smallest(docs, simhash.near_duplicate_groups(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]
    assert simhash.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_give_the_shingles_of_the_whole_text():
    texts = [t.encode() for t in TEXTS if t] + [b"", b"a", b"a b c d", b"a b c d e", b"  x " * 9, b"w" * 5000 + b" a b c d"]
    for text in texts:
        words = text.lower().split()
        whole = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        for block in (1, 7, 100, 1 << 20):
            if len(text) < 10_000 or block > 50:
                assert [int(h) for x in simhash.shingle_hashes(text, 4, block) for h in x] == whole


def test_a_very_long_text_takes_little_memory():
    import tracemalloc

    text = b"word and 12345 " * 1_000_000
    tracemalloc.start()
    simhash.fingerprint(text)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 4 * len(text)
