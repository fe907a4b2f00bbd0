"""Quality rules: measures of each text, and lines that too many documents of a host share.

Built from DataFrame functions only. Lines are normalised and hashed, once, to 128 bits; documents that hold them are counted per
host; lines above the limits are removed from all their documents but the first; a document left
with too little is depleted and rejected. Documents count by distinct text, in a line's count and in its host's alike, so
that a group of copies neither makes its lines frequent nor hides those of others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, let, one_space, text_or_empty, words_of

WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """A line is above the limits if more than `share` of its host's documents hold it, and more than `docs` of them.

    The share decides at every size; `docs` keeps hosts of a few documents from losing what two or three share. A document is depleted if fewer than `words` words are left, or more than `removed` of its words are gone.
    """

    docs: int = 5
    share: float = 0.05
    words: int = 20
    removed: float = 0.8


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows that the text has twice or more, the first time included.

    Windows are compared by 64-bit hash. Sorting hashes with their places brings equal ones together, so that long
    texts take no more than a sort.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        return F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ordered, lambda o: F.sort_array(F.transform(repeated(o), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places, covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(hashes, counted)).cast("long")


def _measured(docs: DataFrame) -> DataFrame:
    """docs (with text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed in place of text."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = F.array(F.struct(F.col("text"), words_of(F.col("text")).alias("words"), lines.alias("lines")))
    measures = F.transform(parts, lambda p: F.struct(
        F.size(p["words"]).cast("long").alias("n_words"),
        F.length(F.array_join(p["words"], "")).cast("long").alias("word_chars"),
        F.regexp_count(p["text"], F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("long").alias("n_dup_lines"),
        repeat_words(p["words"]).alias("n_repeat_words"),
    ))
    out = docs.select(*[c for c in docs.columns if c != "text"], F.inline(measures))  # one row each; no later filter takes these expressions apart
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


KEYS = ["id", "host", "content"]


def _keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """own, a struct of keep's columns, with a document's keys (id, host: null is empty, content: a hash of its text) and text."""
    text = text_or_empty()
    own = (F.struct(*keep) if keep else F.lit(None)).alias("own")
    return docs.select(own, F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("host"), F.xxhash64(text).alias("content"), text.alias("text"))


def line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line that has a word: document's keys, place, 128 bits of hash and number of words."""
    each = _keyed(docs).select(*KEYS, F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    each = each.withColumn("line", F.trim(ascii_lower(one_space(F.col("raw"))))).where("line <> ''")
    return each.select(*KEYS, "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), (F.regexp_count("line", F.lit(" ")) + 1).alias("n"))


def frequent_lines(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Of line_rows, those above the limits by host, h1, h2, with their number of documents and first document."""
    counted = lines.groupBy("host", "h1", "h2").agg(F.countDistinct("content").alias("docs"), F.min("id").alias("first"))
    hosts = lines.groupBy("host").agg(F.countDistinct("content").alias("of_host"))
    return counted.where(F.col("docs") > limits.docs).join(hosts, "host").where(F.col("docs") > limits.share * F.col("of_host")).drop("of_host")


def removed_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """By document: places of the frequent lines of which it isn't the first document, in order, and their words, n_removed."""
    lines = checkpointed(line_rows(docs))  # exploded and hashed once, for the counts and for the hits
    hits = lines.join(frequent_lines(lines, limits), ["host", "h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
    hits = hits.select(*KEYS, "place", "n").distinct()
    return hits.groupBy(*KEYS).agg(F.sort_array(F.collect_list("place")).alias("places"), F.sum("n").alias("n_removed"))


def _judged(docs: DataFrame, limits: Limits, *keep: str, cleaned: bool = False) -> DataFrame:
    """own (keep's columns), measures and verdict of every row of docs; with `cleaned`, also left, the text without removed lines."""
    gone = removed_lines(docs, limits).withColumnRenamed("id", "removed_id")
    keyed = _keyed(docs, *keep)
    rows = _measured(keyed.withColumn("whole", F.col("text")) if cleaned else keyed)
    same = rows["id"].eqNullSafe(gone["removed_id"]) & (rows["host"] == gone["host"]) & (rows["content"] == gone["content"])
    out = rows.join(gone.select("removed_id", "host", "content", "places", "n_removed"), same, "left").drop(gone["host"], gone["content"])
    removed = F.coalesce("n_removed", F.lit(0)).cast("long")
    depleted = (removed > 0) & ((F.col("n_words") - removed < limits.words) | (removed > limits.removed * F.col("n_words")))
    out = out.withColumns({"n_removed_words": removed, "depleted": depleted}).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    return out.withColumn("left", _without(F.col("whole"), F.col("places"))) if cleaned else out


def _without(text: Column, places: Column) -> Column:
    """text without the lines at these places, which are in order: what stands between them, so that each line is copied once."""

    def between(lines: Column, ends: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda k: F.slice(lines, F.get(ends, k - 1) + 2, F.get(ends, k) - F.get(ends, k - 1) - 1)))

    def kept(lines: Column) -> Column:
        return let(F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines))), lambda ends: between(lines, ends))

    return F.when(places.isNull(), text).otherwise(F.array_join(let(F.split(text, "\n"), kept), "\n"))


def judge(docs: DataFrame, *keep: str, limits: Limits = Limits()) -> DataFrame:
    """Adds the measures, base_failed, n_removed_words, depleted and kept to keep's columns, for every row of docs.

    Null texts count as empty and so fail; null hosts are one host. Copies of a text count as one document of their host,
    and a line's first document keeps it. Repeated rows each get the same verdict. Other columns of docs, whatever their names,
    don't matter; an empty table gives an empty result. A very long text is one row, measured in proportion to a sort of it.
    """
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "depleted", "kept"]
    return _judged(docs, limits, *keep).select("own.*", *measures)


def _cleaned(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs' columns of judged rows, with the text that is left and its n_chars; what lost no line stays as it was, null too."""
    changed = F.col("places").isNotNull()
    new = {"text": F.when(changed, F.col("left")).otherwise(F.col("own.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("left")).otherwise(F.col("own.n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return rows.select(*[new.get(c, F.col("own")[c]).alias(c) for c in docs.columns])


def without_frequent_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """docs with the lines above the limits taken out of their texts, but for each line's first document.

    Every row stays, with docs' columns; n_chars, if there, follows the text. What judge says of nulls, copies, repeated
    rows, names and empty tables holds.
    """
    return _cleaned(docs, _judged(docs, limits, *docs.columns, cleaned=True))


def keep_and_clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, without the lines above the limits; else as without_frequent_lines."""
    return _cleaned(docs, _judged(docs, limits, *docs.columns, cleaned=True).where("kept"))


def drop_rejected(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns and whole texts; else as judge."""
    return _judged(docs, limits, *docs.columns).where("kept").select("own.*")
