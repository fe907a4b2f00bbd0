import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from boardwise.llm import license_scan, pii

from .cases import SCHEMA, TEXTS, clashing, documents
from .test_bpe_packing import check_packing
from .test_quality import brute as brute_quality
from .test_near_copies import brute as brute_near, grams

T = license_scan.TEMPLATES


def brute_licenses(text, least=license_scan.LEAST):
    def grams(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", t).strip(" ").split(" ")
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    own, best = grams(text), {}
    for name, template in T:
        t = set(grams(template))
        c = (len(t) - 1).bit_length()
        for start in range(0, len(own), 1 << c):
            share = len(t & set(own[start : start + (2 << c)])) / len(t)
            if share >= least:
                old = best.get(name, (0, start))
                best[name] = (max(old[0], share), min(old[1], start))
    return best


def test_licenses_against_brute_force(spark):
    words = T[1][1].split()
    changed = " ".join(words[:20] + ["other"] + words[21:])
    texts = TEXTS + [f"{'lead in words ' * k}{t}{' and more words' * k}" for k in (0, 3, 50) for _, t in T] + [changed, " ".join(words[:30]), T[0][1].upper() + "\n" + T[2][1], " ".join(t for _, t in T) * 3]
    docs = clashing(documents(spark, texts))
    got = defaultdict(dict)
    for r in license_scan.scan_licenses(docs).collect():
        got[r.doc_id][r.license] = (r.containment, r.first_word)
    want = {i: b for i, t in enumerate(texts) if (b := brute_licenses(t))}
    assert set(want) == set(got)
    assert {(i, k): round(v[0], 9) for i, x in want.items() for k, v in x.items()} == {(i, k): round(v[0], 9) for i, x in got.items() for k, v in x.items()}
    assert license_scan.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licenses_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {(r.doc_id, k) for r in docs.collect() for k in brute_licenses(r.text)}


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    banners = [" ".join(f"v{k}x{j}" for j in range(40)) + f"\nHome | About us | Contact\nend {k}" for k in range(20)]
    extra = spark.createDataFrame([(10_000 + i, t, "en", "src1", len(t or "")) for i, t in enumerate([*TEXTS, *banners])], SCHEMA)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    cleaned = {}
    verdict = brute_quality([(i, r.text, r.source) for i, r in rows.items()], cleaned=cleaned)
    kept = {i: cleaned[i] for i in rows if verdict[i][8]}
    assert any(cleaned[i] != rows[i].text for i in kept)
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    _, least = brute_near({i: grams(t) for i, t in kept.items()})
    kept = {i: kept[i] for i in set(least.values())}
    masked = {i: pii.masked(t, pii.all_spans(t, pii.trained())[1]) for i, t in kept.items()}
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in masked.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(ids) and any(masked[i] != kept[i] for i in kept)
    bins = check_packing(got, ids, 2048)
    assert bins <= 1.02 * np.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_stages_keep_the_columns_of_documents(spark):
    docs = clashing(documents(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {tuple(r) for r in out.select("key", "_row", "left", "pii").collect()} <= {("x",) * 4}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").columns[0] == "doc_id"
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
