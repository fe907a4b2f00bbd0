"""The operators' queries over the driver's tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, conversations, exact_dedup, html_text, lexical, license_scan, packing, pii, quality, secrets, simhash, token_count, url_filter
from .common import table

#: (action, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), "doc_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("content_hash")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.SPECIAL)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), license_scan.NOTICES, apart=True)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), "doc_id").drop("base_spans")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), "page_id", "url")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_quality_rules, op2_exact_dedup, op3_token_counts, op4_byte_bpe, op5_url_filter,
        op6_personal_data, op7_packing, op8_license_scan, op9_simhash, op10_secrets,
        op11_html_text, op12_conversation_repair, op13_ranked_search,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": r"""
            WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
            w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
            win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' '))) AS s,
                           unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
            rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
            cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
            raw AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS place FROM d),
            ln AS (SELECT doc_id, host, t, line, place, trim(translate(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') AS norm FROM raw),
            dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE norm <> '' GROUP BY doc_id),
            hosts AS (SELECT host, count(DISTINCT t) AS n FROM ln WHERE norm <> '' GROUP BY host),
            freq AS (SELECT host, norm, min(doc_id) AS first FROM ln JOIN hosts USING (host) WHERE norm <> ''
                     GROUP BY host, norm, n HAVING count(DISTINCT t) > 5 AND count(DISTINCT t) > 0.05 * n),
            gone AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS n FROM ln JOIN freq USING (host, norm) WHERE doc_id <> first GROUP BY doc_id),
            m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
                  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
            v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                         n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_removed_words > 0.8 * n_words) AS depleted FROM m)
            SELECT *, NOT base_failed AND NOT depleted AS kept FROM v""",
        "op2_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
        "op13_ranked_search": r"""
            WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
            d AS (SELECT doc_id, row_number() OVER () AS row, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
            st AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
            q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
            p AS (SELECT doc_id, row, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, row, n, unnest(ts) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
            w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, st GROUP BY term, docs),
            s AS (SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
                  FROM p JOIN w USING (term) JOIN q USING (term), st GROUP BY ALL)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
            QUALIFY rank <= 10""",
        "op5_url_filter": r"""
            WITH s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            p AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, rest FROM s),
            u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path FROM p),
            r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                               ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
            m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
                  FROM u, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
            SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id""",
    }

