import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from boardwise.llm import lexical as L

from .cases import LONG, TEXTS, clashing, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total, out = len(own), sum(x[2] for x in own), []
    df = Counter(t for _, c, _ in own for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, ts in wanted.items():
        scores = []
        for i, c, length in own:
            m = 100 - 90 + (90 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    draw = lambda n: " ".join(words[int(300 * r.random() ** 3)] + r.choice([" ", ", ", "\n"]) for _ in range(n))
    docs = [(i, draw(r.choice([1, 5, 30, 200]))) for i in range(700)]
    docs += [(1000 + i, docs[i][1]) for i in range(40)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w250 w251 w1")]
    return docs, [(i, draw(r.choice([1, 3, 20]))) for i in range(30)] + [(30, ""), (31, None), (32, "?!"), (33, "w1"), (33, "w250 w251"), (34, "unknown"), (35, "W1 w1 W250")]


@pytest.mark.parametrize("shard, frontier", [(8192, 4096), (50, 8), (1, 1)])
def test_equals_brute_force(spark, corpus, monkeypatch, shard, frontier):
    docs, items = corpus
    monkeypatch.setattr(L, "SHARD", shard)
    monkeypatch.setattr(L, "FRONTIER", frontier)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(L.rank_documents(clashing(df), clashing(spark.createDataFrame(items, "item_id long, text string")))) == brute(docs, items)


def test_items_in_blocks(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(L, "BLOCK_ITEMS", 20)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(L.rank_documents(df, spark.createDataFrame(items, "item_id long, text string"), k=3)) == brute(docs, items, 3)


def test_odd_texts_and_empty_tables(spark):
    df = documents(spark)
    items = [("a", "Köln naïve one 日本語 B"), ("b", LONG), ("c", "same text here"), (None, "leading and 14")]
    table = spark.createDataFrame(items, "item_id string, text string")
    want = brute(list(enumerate(TEXTS)), items)
    assert rows(L.rank_documents(df, table)) == want
    assert L.rank_documents(df.limit(0), table).count() == 0 and L.rank_documents(df, table.limit(0)).count() == 0


def test_terms_are_those_of_the_pattern():
    every = "".join(map(chr, range(0x180))) + "aB9-﻿_\U0001f600x"
    assert [t.decode() for t in L.terms(every.encode())] == terms(every)


def test_ranges_that_cannot_enter_are_pruned():
    r = np.random.default_rng(1)
    n = 5000
    slot, doc = np.repeat(np.arange(4), n), np.tile(np.arange(n), 4)
    impact = (r.pareto(1.5, 4 * n) * 1000).astype(np.int64)
    t, seen, plain = L.Treaps(slot, doc, impact, n), [0], L.Treaps.scores
    t.scores = lambda d, *a: (seen.__setitem__(0, seen[0] + len(d)), plain(t, d, *a))[1]
    scores, docs = t.best({0: 5, 1: 3, 2: 1, 3: 2}, 10)
    full = impact.reshape(4, n).T @ np.array([5, 3, 1, 2])
    order = np.lexsort((np.arange(n), -full))[:10]
    assert (docs == order).all() and (scores == full[order]).all() and seen[0] < n / 4
    for s in range(4):  # search order by document, heap order by impact
        stack = [(t.root[s], 0, n - 1, np.inf)]
        count = 0
        while stack:
            v, low, high, above = stack.pop()
            if v >= 0:
                count += 1
                assert low <= t.doc[v] <= high and t.impact[v] <= above
                stack += [(t.left[v], low, t.doc[v] - 1, t.impact[v]), (t.right[v], t.doc[v] + 1, high, t.impact[v])]
        assert count == n
