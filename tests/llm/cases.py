"""Texts that every operator on documents must bear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "".join(f"wort{i * i % 977} and {i} " + ("\n" if i % 9 == 0 else "") for i in range(8000))
TEXTS = [
    None, "", " ", "\n\n \t", "one", "one two three", "a b c d e f", "A  b\x0bc\x0cd\re", "Grüße aus Köln — naïve café 日本語 \U0001f600 end",
    "<s> <|endoftext|> </s>", "  leading and trailing  ", "tab\tand\nnew  line\n\nx", "\u2581mark \ue000 stand-in", "\x00 null \x85 nel \xa0 nbsp\u3000wide",
    "don't we'll I'M it's 'tis 12345 3.14 ...!!! ", LONG, LONG, LONG + "more", "same text here", "same text here", "same  text\nhere",
]


def rows(texts=TEXTS):
    return [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"src{i % 3}", None) for i, t in enumerate(texts)]


def documents(spark: SparkSession, texts=TEXTS) -> DataFrame:
    return spark.createDataFrame(rows(texts), SCHEMA)


def clashing(df: DataFrame) -> DataFrame:
    """With more columns, of names that operators may use themselves."""
    from pyspark.sql import functions as F

    names = ["words", "fp", "root", "kept", "bucket", "length", "rule", "host", "path", "spans", "keep_id", "group_size", "block", "n", "h", "rank"]
    names += ["_host", "_path", "_found", "_share", "_rank", "_text", "_stay", "_row", "_places", "_id", "_content", "own", "row", "found", "pii", "key", "node", "left", "base", "id", "content", "part", "group"]
    return df.withColumns({n: F.lit("x") for n in names})


def by_id(df: DataFrame, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}
