import pickle
import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from boardwise.llm import exact_dedup, token_count, url_filter
from boardwise.llm.queries import URL_RULES

from .cases import SCHEMA, TEXTS, by_id, clashing, documents, rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_the_librarys(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = by_id(token_count.count_tokens(clashing(documents(spark)), MODEL, limit=5))
    for i, t in enumerate(TEXTS):
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 5), t


def test_token_counts_on_a_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = by_id(token_count.count_tokens(docs, MODEL))
    texts = docs.select("doc_id", "text").collect()
    assert {r.doc_id: len(sp.encode(r.text)) for r in texts} == {k: v.n_tokens for k, v in got.items()}


def test_no_piece_crosses_what_texts_are_cut_at():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    assert not [p for p in pieces if re.search("[^\u2581]\u2581|\n", p)]


def test_a_full_worker_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 2)
    rest = token_count.Lengths(open(MODEL, "rb").read())
    assert token_count.text_length("a b c d a", {}, rest) == 5 and len(rest) <= 2


def test_the_frequent_tier_is_bounded_and_right(spark):
    model, sp = open(MODEL, "rb").read(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(i, f"the of the of the w{i} rare{i}") for i in range(300)], "doc_id long, text string")
    tier = token_count.frequent_lengths(docs, model, share=1.0, most=5)
    assert set(tier) == {"the", "of"} and all(n == len(sp.encode(k)) for k, n in tier.items())
    assert token_count.frequent_lengths(docs, model, share=1.0, most=1) in ({}, {"the": 1})
    assert token_count.frequent_lengths(docs.limit(0), model) == {}


def brute_groups(data):
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t, *_ in data}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_equal_brute_force_even_if_hashes_collide(spark, weak):
    docs = clashing(documents(spark))
    got = exact_dedup.exact_groups(docs, lambda c: F.length(c) % 2) if weak else exact_dedup.exact_groups(docs)
    if weak:
        got = got.drop("content_hash")
    assert {i: (r.keep_id, r.group_size, r.kept, r.text_sha256) for i, r in by_id(got).items()} == brute_groups(rows())


def test_large_groups_are_dealt_to_several_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same  text" if i % 3 else f"own {i}", None, None, None) for i in range(300)], SCHEMA)
    want = {tuple(r) for r in exact_dedup.exact_groups(docs).collect()}
    monkeypatch.setattr(exact_dedup, "LARGE", 5)
    monkeypatch.setattr(exact_dedup, "FEW", -1)
    assert {tuple(r) for r in exact_dedup.exact_groups(docs).collect()} == want and len(want) == 300


def test_exact_groups_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (3, "b")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, False), (2, 1, 3, False), (0, None, 2, True), (3, None, 2, False)], key=str)
    assert sorted((r.doc_id or 0) for r in exact_dedup.drop_copies(docs).collect()) == [0, 1]


@pytest.mark.parametrize("weak", [False, True])
def test_drop_copies_keeps_whole_rows_of_the_smallest_ids(spark, weak):
    docs = clashing(documents(spark))
    kept = exact_dedup.drop_copies(docs, lambda c: F.length(c) % 2) if weak else exact_dedup.drop_copies(docs)
    stay = {i for i, (_, _, first, _) in brute_groups(rows()).items() if first}
    assert kept.columns == docs.columns
    assert {r.doc_id: r for r in kept.collect()} == {r.doc_id: r for r in docs.collect() if r.doc_id in stay}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_count.count_tokens(empty, MODEL).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


URLS = [
    None, "", "no scheme", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://m.example.com/en/", "https://example.com/en",
    "https://xexample.com/en/1", "http://b.net/es/1", "http://net/fr/?q", "http://b.net/de/", "http://b.net/es", "http://com/", "x://a.com:80/", "http://a.com?x/", "://a.com/en/",
]


def fitting(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [URL_RULES, [*URL_RULES, ("block", "a.com", ""), ("allow", "net", "/e"), ("block", "b.net", "/d/e"), ("allow", "b.net", "/es/1"), ("allow", "b.net", "/de/"), ("block", "b.net", "/de/")]])
def test_urls_against_brute_force(spark, monkeypatch, rules):
    pages = clashing(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"))
    got = by_id(url_filter.filter_urls(pages, rules), "page_id")
    assert {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()} == {i: fitting(u, rules) for i, u in enumerate(URLS)}
    monkeypatch.setattr(url_filter, "MAX_TRIE", 1)  # a larger list is joined
    assert by_id(url_filter.filter_urls(pages, rules), "page_id") == got
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_rules_that_share_a_start_are_found_by_characters():
    rules = [("block", "a.com", f"/x{k}") for k in range(3000)] + [("allow", "a.com", "/x29")]
    trie = url_filter.build_trie(rules)
    for path in ("/x29", "/x299/y", "/x2999", "/x", "/x77?"):
        want = max(((len(h) + len(p), len(h), h + p, a) for a, h, p in rules if path.startswith(p)), default=None)
        assert url_filter.longest_match(trie, "www.a.com", path) == want


def test_url_rules_of_odd_forms_fit_alike_on_both_paths(spark, monkeypatch):
    rules = [("block", "Com", "en/"), ("block", "EXAMPLE.com", "/En"), ("allow", "example.com", ""), ("block", "example.com", "/a/b"), ("allow", "a.example.com", "/a/bc/"), ("block", "net", "/")]
    urls = ["http://EXAMPLE.com/En/x", "http://example.com/en/", "http://a.b.com/en/", "http://a.example.com/a/bc/d", "http://a.example.com/a/bcd", "http://x.net", "http://x.net/", "http://example.com", "http://example.com/a/b?c", None, "no url"]
    urls += ["http://example.com/" + "a/" * 5000, "http://" + "x." * 300 + "net/" + "y" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def brute(url):
        if url is None or "://" not in url:
            return None
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path, host = re.split("[?#]", rest[len(host) :])[0], host.lower()
        fits = [(len(h) + len(p), len(h), h.lower() + p) for _, h, p in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        return max(fits)[2] if fits else None

    for most in (10**9, 1):
        monkeypatch.setattr(url_filter, "MAX_TRIE", most)
        got = {r.page_id: r.rule for r in url_filter.filter_urls(df, rules).select("page_id", "rule").collect()}
        assert got == {k: brute(u) for k, u in enumerate(urls)}


def test_a_workers_trie_stays_within_its_bound():
    import random
    import string
    import tracemalloc

    r = random.Random(1)
    word = lambda n: "".join(r.choice(string.ascii_lowercase) for _ in range(n))
    for paths in (1, 3):
        rules = [("block", f"{word(9)}.{word(3)}", "/" + "/".join(word(8) for _ in range(paths))) for _ in range(20000)]
        size = len(pickle.dumps(rules)) and url_filter.trie_bytes(rules)
        data = pickle.dumps(url_filter.build_trie(rules))
        tracemalloc.start()
        trie = pickle.loads(data)  # as a worker has it
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        assert trie.next and held <= size < 4 * held
    assert url_filter.MAX_TRIE < 200_000_000
