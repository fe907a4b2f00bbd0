import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from boardwise.llm import bpe, packing, pieces

from .cases import SCHEMA, TEXTS, by_id, clashing, documents

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_encode():
    return pieces.encoding(open(RANKS, "rb").read(), P.PATTERN).encode_ordinary


@pytest.mark.parametrize("parts,block", [(64, bpe.BLOCK), (3, 50), (None, 20_000)])
def test_ids_equal_the_librarys_and_decode_to_the_text(spark, tiktoken_encode, parts, block):
    encoded = bpe.encode_documents(clashing(documents(spark)), RANKS, P.PATTERN, parts, block, decoded=True).withColumnRenamed("decoded", "at_once")
    got = by_id(bpe.decode_documents(encoded, RANKS))
    assert all(r.at_once == r.decoded for r in got.values())
    for i, t in enumerate(TEXTS):
        ids = np.array(tiktoken_encode(t or ""), dtype="<u4")
        assert (got[i].n_tokens, bytes(got[i].ids), bytes(got[i].decoded)) == (len(ids), ids.tobytes(), (t or "").encode()), t
    assert len(got) == len(TEXTS)


def test_bpe_of_a_table_of_repeated_rows_and_of_an_empty_one(spark, tiktoken_encode):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = by_id(bpe.encode_documents(docs, RANKS, P.PATTERN))
    assert {r.doc_id: bytes(got[r.doc_id].ids) for r in docs.collect()} == {r.doc_id: np.array(tiktoken_encode(r.text), "<u4").tobytes() for r in docs.collect()}
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_tokens) for r in bpe.encode_documents(twice, RANKS, P.PATTERN).collect()) == {(None, 2): 2, (7, 0): 1}
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


def tricky(n=400):
    r = random.Random(2)
    bits = [" ", "  ", "\n", "\n\n", " \n", "\t", "a", "The", "don't", "'s", "12", ".", "!!", "é", "日本", "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "'", "\r\n", "\U0001f600", "x" * 40]
    return ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(n)]


def test_cached_stretches_equal_the_librarys_ids(monkeypatch):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for cache in (250_000, 3):
        monkeypatch.setattr(pieces, "CACHE", cache)
        encode = pieces.Encoder(open(RANKS, "rb").read(), P.PATTERN, packing.SPECIAL)
        for t in TEXTS + tricky():
            assert np.frombuffer(encode(t or ""), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def check_packing(rows, ids, tokens):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == tokens) and 0 < r.length <= tokens
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by_bin)


def test_packing_of_a_table(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    rows = packing.pack_documents(clashing(docs), RANKS, P.PATTERN, packing.SPECIAL).collect()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    bins = check_packing(rows, ids, 2048)
    assert bins <= 1.01 * sum(map(len, ids.values())) / 2048 + 1
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN, packing.SPECIAL).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("docs,attention", [(2048, 2048 * 2048), (3, 2048 * 2048), (2048, 900_000)])
def test_plans_hold_every_capacity(rule, docs, attention):
    r = random.Random(4)
    cap = packing.Capacity(2048, docs, attention, rule=rule)
    top = 900 if attention < 2048 * 2048 else 2048
    counts = Counter(min(top, int(r.expovariate(1 / 400)) + 1) for _ in range(5000))
    plan = packing.plan_bins(counts, cap)
    bins = defaultdict(list)
    for length, n in counts.items():
        b, o = plan.place(np.full(n, length), np.arange(n))
        for x, y in zip(b.tolist(), o.tolist()):
            bins[x].append((y, length))
    for own in bins.values():
        own.sort()
        assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own))
        assert sum(n for _, n in own) <= 2048 and len(own) <= docs and sum(n * n for _, n in own) <= attention
    least = max(sum(k * v for k, v in counts.items()) / 2048, sum(counts.values()) / docs, sum(k * k * v for k, v in counts.items()) / attention)
    assert len(bins) <= (1.02 if rule == "norm" and docs > 3 and top > 900 else 1.7) * least + 1
    if docs > 3 and top > 900 and rule == "norm":
        assert len(bins) <= best_fit_decreasing(counts) + 1


def best_fit_decreasing(counts):
    free = []
    for length in sorted(counts.elements(), reverse=True):
        k = min((k for k, f in enumerate(free) if f >= length), key=lambda k: free[k], default=None)
        if k is None:
            free.append(2048 - length)
        else:
            free[k] -= length
    return len(free)


def test_plan_size_does_not_follow_the_corpus():
    r = random.Random(4)
    counts = Counter(min(2048, int(r.expovariate(1 / 400)) + 1) for _ in range(20000))
    small, large = (packing.plan_bins({k: v * m for k, v in counts.items()}) for m in (1, 10_000))
    assert len(large.length) < 3 * len(small.length)


def test_a_hot_length_is_ranked_in_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    monkeypatch.setattr(packing, "SHARES", 4)
    items = spark.createDataFrame([(i, 100 if i % 3 else 7, "x") for i in range(500)], "doc_id long, length long, _share string")
    rows = packing.pack(items).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 500 and all(sum(n for _, n in x) <= 2048 for x in bins.values())
    assert all(o == sum(n for _, n in sorted(x)[:k]) for x in bins.values() for k, (o, _) in enumerate(sorted(x)))


def test_digest_of_ids(spark, tiktoken_encode):
    from boardwise.llm.queries import op4_byte_bpe

    got = by_id(op4_byte_bpe(spark, "/root/testdata/sf0.001"))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(tiktoken_encode(r.text), "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
