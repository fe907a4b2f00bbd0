import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from boardwise.llm import near_copies

from .cases import SCHEMA, TEXTS, clashing, documents


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(sets, least=0.8):
    """Pairs of similarity `least` or more, and the smallest id that they connect each with."""
    root = {i: i for i in sets}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= least]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return pairs, {i: find(i) for i in sets}


def edited():
    """Texts with copies from about 0.6 to 0.97 of similarity."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(40):
        own = [r.choice(words) for _ in range(r.choice([30, 120, 300]))]
        out.append(" ".join(own))
        for share in (0.005, 0.015, 0.02, 0.03, 0.05):
            out.append(" ".join(r.choice(words) if r.random() < share else w for w in own))
    return out


def pairs_found(pairs, got):
    return sum(got[a] == got[b] for a, b in pairs) / len(pairs)


def test_groups_against_brute_force(spark):
    texts = TEXTS + edited()
    docs = clashing(documents(spark, texts))
    pairs, want = brute({i: grams(t) for i, t in enumerate(texts)})
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(docs).collect()}
    assert len(pairs) > 50 and pairs_found(pairs, got) >= 0.97
    assert all(want[i] == want[c] for i, c in got.items())  # no link that brute force hasn't
    stay = near_copies.drop_near_copies(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == set(got.values())
    assert near_copies.near_copy_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_stage_finds_pairs_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") > 200)
    pairs, want = brute({r.doc_id: grams(r.text) for r in docs.collect()})
    assert {(1, 177), (6, 145)} <= set(pairs)  # 17 and 11 bits apart by one fingerprint of 64
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(want.values())


def test_tables_meet_at_the_least_similarity():
    r = random.Random(1)
    for size in (100_000, 10_000_000, 1_000_000_000):
        bits, tables = near_copies.table_shape(size)
        met = 0
        for _ in range(300):
            n = r.choice([90, 270, 450])
            own = np.array([r.getrandbits(64) for _ in range(n // 9 * 10)], dtype=np.uint64)
            (x1, a), (y1, b) = (near_copies.signature(np.sort(x), bits, tables) for x in (own[: len(own) - n // 9], own[n // 9 :]))
            near = ((x1 ^ y1) & (1 << 64) - 1).bit_count() <= near_copies.KEY_BITS
            met += near and any(((x ^ y) & (1 << 64) - 1).bit_count() <= 4 for x, y in zip(a, b))
        assert met >= 285


def test_large_components_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PART", 7)
    r = random.Random(2)
    own = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"x{k}" if r.random() < 0.015 else w for w in own) for k in range(60)]
    pairs, want = brute({i: grams(t) for i, t in enumerate(texts)})
    got = {x.doc_id: x.component_id for x in near_copies.near_copy_groups(documents(spark, texts)).collect()}
    assert pairs_found(pairs, got) >= 0.97 and all(want[i] == want[c] for i, c in got.items())


def test_what_goes_out_of_a_large_component(spark, monkeypatch):
    """Edits of one text, one in eight far from all: about two sets a text first, and a quarter of all pairs of parts in all."""
    monkeypatch.setattr(near_copies, "PART", 32)
    sent, whole = [], near_copies._compared

    def counted(docs, dealt, *more):
        sent.append(dealt.agg(F.sum(F.size("tasks"))).first()[0])
        return whole(docs, dealt, *more)

    monkeypatch.setattr(near_copies, "_compared", counted)
    r, n = random.Random(3), 600
    own = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"x{k}" if r.random() < 0.01 else w for w in own) for k in range(n)]
    pairs, want = brute({i: grams(t) for i, t in enumerate(texts)})
    got = {x.doc_id: x.component_id for x in near_copies.near_copy_groups(documents(spark, texts)).collect()}
    assert pairs_found(pairs, got) >= 0.97 and all(want[i] == want[c] for i, c in got.items())
    assert sent[0] <= 2.1 * n and sum(sent) <= n * n / 32 / 4


def test_second_tasks_lose_no_link(spark, monkeypatch):
    """One group of texts in many small parts: links are those of all pairs, whatever the hubs are."""
    monkeypatch.setattr(near_copies, "PART", 3)
    texts = edited()[:60]
    docs, sets = documents(spark, texts), {i: grams(t) for i, t in enumerate(texts)}
    _, want = brute(sets)
    rows = near_copies._signatures(docs, 5, 32, 6).select("doc_id", "node")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    links = near_copies._links(docs, nodes, nodes.select("node", F.lit(1).cast("long").alias("group")), 5, 0.8)
    of_node = {r.node: r.least for r in nodes.collect()}
    root = {i: of_node[r.node] for r in rows.collect() for i in [r.doc_id]}
    for a, b in links.collect():
        x, y = root[of_node[a]], root[of_node[b]]
        root = {i: min(x, y) if c in (x, y) else c for i, c in root.items()}
    assert root == want
