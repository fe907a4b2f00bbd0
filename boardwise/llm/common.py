"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, delete, shared_folder  # noqa: F401

#: White space that separates words, as a character class of Java's and Python's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def one_space(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, f"{SPACE}+", " ")


def words_of(c: Column) -> Column:
    """Array of the words of a text; empty for a text without one."""
    bare = F.trim(one_space(c))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column], zero: Column, chunk: int = 1024) -> Column:
    """For each place of an array of integers, join over all values up to it: sums, or extremes. zero leaves a value as it is.

    Appending to an array copies it, so that is done by chunks, and then over the chunks' last values: n values cost
    n * chunk + (n / chunk) ** 2 copies of a number, not n ** 2.
    """

    def appended(x: Column) -> Column:
        start = F.struct(zero.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))

        def add(acc: Column, v: Column) -> Column:
            return let(join(acc["at"], v), lambda n: F.struct(n.alias("at"), F.array_append(acc["out"], n).alias("out")))

        return F.aggregate(x, start, add, lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        lasts = appended(F.transform(parts, lambda p: F.element_at(p, -1)))
        before = lambda b, i: F.coalesce(F.get(b, i - 1), zero)
        return let(lasts, lambda b: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda v: join(before(b, i), v)))))

    def parted(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x), F.lit(chunk))
        return let(F.transform(starts, lambda k: appended(F.slice(x, k, chunk))), joined)

    return let(values, lambda x: F.when(F.size(x) == 0, x).when(F.size(x) <= chunk, appended(x)).otherwise(parted(x)))


def read_bytes(path: str) -> bytes:
    """A vocabulary file of the driver's; its content, of at most a few MB, goes to the executors by broadcast."""
    with open(path, "rb") as f:
        return f.read()
