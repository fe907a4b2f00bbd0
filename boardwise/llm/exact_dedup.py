"""Exact dedup: rows are grouped by a 128-bit content hash; inside a hash's group, bytes decide what is equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, one_space, text_or_empty


#: Rows of a text from which its group is dealt to SALTS tasks for the join of ids, and hashes of several texts that go
#: out by broadcast, at most.
LARGE, SALTS, FEW = 1_000_000, 64, 100_000


def hash128(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _hashed(docs: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    """docs with _text, the normalised text, and its content_hash."""
    return docs.withColumn("_text", one_space(text_or_empty())).withColumn("content_hash", hash_of(F.col("_text")))


def _classes(base: DataFrame) -> DataFrame:
    """A row for each text: grouped by hash, and by bytes inside a hash's group."""
    return base.groupBy("content_hash", "_text").agg(
        F.min("doc_id").alias("_least"), F.max(F.col("doc_id").isNull()).alias("_null_id"), F.count(F.lit(1)).alias("group_size")
    )


def exact_groups(docs: DataFrame, hash_of: Callable[[Column], Column] = hash128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and content_hash for every row of docs.

    Texts are equal when they are the same bytes after each run of white space became one space; null counts as
    empty. Of equal texts the row with the smallest doc_id stays. Repeated rows (same doc_id, same text) count each in
    group_size, and one of them stays. A null doc_id sorts first, so such a row stays and has a null keep_id.
    Other columns, whatever their names, don't matter; an empty table gives an empty result.

    Texts go through one shuffle, after equal ones of a task became one row, so that a large group of copies never
    meets in one task. What comes of it, without texts, is checkpointed; only ids and hashes are joined, and large groups
    by salted hashes (there are no more of these than a millionth of the rows, so their table goes out by broadcast). Hashes that
    stand for several texts are told apart by the bytes, of their rows alone. None are to be expected, but as they can be
    made to order, their table is counted before it goes out by broadcast. A very long text is one row.
    """
    base = _hashed(docs.select("doc_id", "text"), hash_of)
    found = checkpointed(_classes(base).drop("_text"))
    collided = checkpointed(found.groupBy("content_hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("content_hash", F.lit(True).alias("_collided")))
    collided = F.broadcast(collided) if collided.count() <= FEW else collided
    told = _classes(base.join(collided, "content_hash", "left_semi")).withColumnRenamed("_text", "_told")
    classes = found.join(collided, "content_hash", "left_anti").unionByName(told, allowMissingColumns=True)
    salt = F.when(F.col("group_size") > LARGE, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    classes = classes.select(F.col("content_hash").alias("_hash"), "_told", F.when(~F.col("_null_id"), F.col("_least")).alias("keep_id"), "group_size", F.explode(salt).alias("_part"))
    large = F.broadcast(found.where(F.col("group_size") > LARGE).select("content_hash", F.lit(True).alias("_large")).distinct())
    rows = base.join(collided, "content_hash", "left").join(large, "content_hash", "left").select(
        "content_hash", F.when(F.col("_collided"), F.col("_text")).alias("_told"), "doc_id", F.unhex(F.sha2("_text", 256)).alias("_sha"), F.col("_large"),
    )
    several = F.when(F.col("_told").isNull() & F.col("_large"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumn("_salt", several)
    same = (F.col("content_hash") == F.col("_hash")) & (F.col("_salt") == F.col("_part")) & rows["_told"].eqNullSafe(classes["_told"])
    out = rows.join(classes, same).select("doc_id", "keep_id", "group_size", "content_hash", "_sha")
    first = F.row_number().over(Window.partitionBy("doc_id", "content_hash", "_sha").orderBy("keep_id")) == 1
    return out.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"), F.lower(F.hex("content_hash")).alias("content_hash"),
    )


def drop_copies(docs: DataFrame, hash_of: Callable[[Column], Column] = hash128) -> DataFrame:
    """The row of docs with the smallest doc_id of each text, with docs' columns; null doc_ids come first.

    Groups are those of exact_groups. Of repeated rows, the one with the smallest hash of its own text stays.
    Whole rows go through one shuffle, one for each text and task. A row's own text goes along only where it differs
    from the normalised one.
    """
    base = _hashed(docs.withColumn("_row", F.struct(*[c for c in docs.columns if c != "text"])).select("doc_id", "text", "_row"), hash_of)
    own = F.when(~F.col("text").eqNullSafe(F.col("_text")), F.struct("text"))
    first = F.min_by(F.struct("_row", own.alias("_own")), F.struct("doc_id", F.xxhash64("text")))
    out = base.groupBy("content_hash", "_text").agg(first.alias("_first"))
    text = F.when(F.col("_first._own").isNull(), F.col("_text")).otherwise(F.col("_first._own.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col("_first._row")[c].alias(c) for c in docs.columns])
