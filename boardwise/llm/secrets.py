"""Secrets: patterns, and strings that look random, found by two character Markov models.

Built from DataFrame functions only. Both models are trained on labelled samples made here: random strings, and ordinary
identifiers and numbers; the ordinary model also counts the long words of a bounded sample of documents, so that it
knows their languages. Their log-likelihood ratio, by pair of characters, is one constant array in the plan and decides alone.
"""

from __future__ import annotations

import builtins
import keyword
import random
import sys
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, text_or_empty

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Log-likelihood ratio, in nats a pair, from which a token of 20 characters or more counts as random. Of held-out samples,
#: ordinary ones stay below 0.25, and 99 in 100 random ones are above 0.65.
MARGIN = 0.5
#: Documents, about, whose long words train the ordinary model: of small letters, perhaps after a capital, or of capitals. A random
#: string of mixed letters is none.
SAMPLE, LONG_WORD = 2000, r"(?<![A-Za-z0-9+/_=-])(?:[A-Z]?[a-z]{7,}|[A-Z]{8,})(?![A-Za-z0-9+/_=-])"


def labelled_samples(n: int, seed: int) -> list[tuple[str, int]]:
    """(string, 1 if random): n of each. Ordinary ones join words of Python's own names as code does."""
    r = random.Random(seed)
    names = sorted({*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names, *dir(str), *dir(random), *dir(np)})
    words = sorted({w.lower() for x in names for w in x.replace("_", " ").split() if w.isalpha() and len(w) > 2})
    kinds = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef"]
    out = []
    for _ in range(n):
        letters = r.choice(kinds)
        out.append(("".join(r.choice(letters) for _ in range(r.randrange(20, 64))), 1))
        parts = [r.choice(words) for _ in range(r.randrange(3, 8))]
        style = r.randrange(5)
        text = {0: "_".join(parts), 1: "-".join(parts), 2: "".join(p.capitalize() for p in parts), 3: "_".join(parts).upper(), 4: "/".join(parts)}[style]
        number = f"{r.choice(['_', '-', '', '/'])}{r.choice([r.randrange(100), r.randrange(1990, 2030), f'20{r.randrange(10, 30)}-0{r.randrange(1, 9)}-1{r.randrange(10)}'])}"
        out.append((r.choice([text, text + number, "".join(r.choice("0123456789") for _ in range(r.randrange(20, 40)))]), 0))
    return out


def word_pairs(docs: DataFrame, *keys: str, sample: int = SAMPLE) -> dict[str, int]:
    """Pairs of neighbouring letters in long words of about `sample` documents, with their counts: at most 52 * 52.

    Documents are chosen by a hash of their keys and text, so the same table gives the same sample however it is split."""
    parts = 1 << 30
    share = min(1.0, sample / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64(*keys, "text"), F.lit(parts)) < int(share * parts))
    words = chosen.select(text_or_empty().alias("text")).select(F.explode(F.regexp_extract_all("text", F.lit(LONG_WORD), F.lit(0))).alias("word"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}


@lru_cache(maxsize=2)
def _counts(n: int, seed: int) -> np.ndarray:
    counts = np.full((2, len(ALPHABET), len(ALPHABET)), 0.5)
    place = {c: i for i, c in enumerate(ALPHABET)}
    for text, label in labelled_samples(n, seed):
        codes = [place[c] for c in text if c in place]
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    return counts


def ratios(pairs: dict[str, int] | None = None, n: int = 4000, seed: int = 1) -> np.ndarray:
    """Log ratio of the two models' probabilities of the second character after the first; pairs: counts of ordinary ones."""
    counts = _counts(n, seed).copy()
    if pairs:
        scale = counts[0].sum() / sum(pairs.values())  # as much in all as the samples made here
        for (a, b), k in pairs.items():
            counts[0, ALPHABET.index(a), ALPHABET.index(b)] += k * scale
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return np.clip(logs[1] - logs[0], -6, 6)


def randomness(token: Column, table: np.ndarray) -> Column:
    """Mean log-likelihood ratio over the token's pairs of characters."""
    values = F.split(F.lit(",".join(f"{x:.3f}" for x in table.ravel())), ",").cast("array<double>")
    n = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def mean(c: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.coalesce(F.get(values, F.get(c, i - 1) * n + F.get(c, i)), F.lit(0.0)))
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (F.size(c) - 1)

    return let(F.filter(codes, lambda c: c >= 0), lambda c: F.when(F.size(c) > 1, mean(c)).otherwise(F.lit(0.0)))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Matches as (start, kind, end) in code points: what lies between them gives the places. keep(match, i): a condition."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        lengths = F.transform(m, lambda x: F.length(x))
        ends = running(F.zip_with(lengths, F.slice(between, F.lit(1), F.size(m)), lambda n, g: n + g), lambda a, b: a + b, F.lit(0))
        found = let(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), keep(x, i).alias("ok"))))
        return F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(placed(m)))


def _apart(base: Column, more: Column) -> Column:
    """Those of more, of the last kind, that overlap none of base: by the greatest end so far and the next start, over all
    spans in order."""
    last, far = len(KINDS) - 1, F.lit(1 << 30)

    def left(x: Column) -> Column:
        ends = running(F.transform(x, lambda s: F.when(s["kind"] == last, 0).otherwise(s["end"])), F.greatest, F.lit(0))
        starts = F.reverse(running(F.transform(F.reverse(x), lambda s: F.when(s["kind"] == last, far).otherwise(s["start"])), F.least, far))
        clear = lambda e, n: F.filter(x, lambda s, i: (s["kind"] == last) & (F.get(e, i) <= s["start"]) & (F.get(n, i) >= s["end"]))
        return let(ends, lambda e: let(starts, lambda n: clear(e, n)))

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(let(F.sort_array(F.concat(base, more)), left))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, *keep: str, margin: float = MARGIN, sample: int = SAMPLE) -> DataFrame:
    """keep's columns of docs, n_assign, n_access, n_hex, base_sha256, spans and base_spans, for every row.

    Null and empty texts have no spans; a very long text costs a sort of its matches. Offsets are in code points, ends
    exclusive. What the models add overlaps no match of the patterns and has kind `random`. Repeated rows each have
    their row; other columns, whatever their names, don't matter; an empty table gives an empty result.
    """
    table = ratios(word_pairs(docs, *keep, sample=sample))
    text = F.col("text")
    value_long = lambda groups: lambda _, i: F.length(F.get(groups, i)) >= 8
    always = lambda *_: F.lit(True)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.when(F.regexp_like(text, F.lit(ASSIGN)), let(values, lambda g: _spans(text, ASSIGN, 0, value_long(g)))).otherwise(F.array().cast(_SPANS))
    looks_random = lambda x, _: randomness(x, table) > margin
    out = docs.select(F.struct(*keep).alias("own"), text_or_empty().alias("text"))
    out = out.select("own", assign.alias("assign"), _spans(text, ACCESS, 1, always).alias("access"), _spans(text, HEX, 2, always).alias("hex"), _spans(text, TOKEN, 3, looks_random).alias("random"))
    out = out.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    return out.select(
        "own.*", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.sort_array(F.concat("base", _apart(F.col("base"), F.col("random"))))).alias("spans"), _listed(F.col("base")).alias("base_spans"),
    )
