"""URL filters: a broadcast trie over reversed host labels and path segments; the longest fitting rule wins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

#: Bytes of a trie in a worker; a larger rule list doesn't go out by broadcast: urls are joined with it, with the same results.
MAX_TRIE = 160_000_000

Rule = tuple[str, str, str]  # action, host, path
_LOWER = str.maketrans(UPPER, LOWER)


def url_host(url: Column) -> Column:
    """Lower-cased host: from behind the first :// up to /, ?, # or the end; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Node:
    """A host label's node: nodes of the next labels, and the paths of the rules whose host ends here."""

    __slots__ = ("next", "paths")

    def __init__(self) -> None:
        self.next: dict[str, Node] | None = None
        self.paths: Paths | None = None


class Paths:
    """A path folder's node: nodes of its segments, and rules by what the next segment starts with, which may be nothing."""

    __slots__ = ("next", "starts", "lengths", "rule")

    def __init__(self) -> None:
        self.next: dict[str, Paths] | None = None
        self.starts: dict[str, tuple] | None = None
        self.lengths: tuple[int, ...] = ()  # of starts, upwards
        self.rule: tuple | None = None


def build_trie(rules: Iterable[Rule]) -> Node:
    """Hosts by reversed label; at a host's end, paths by whole segment, then by what the next segment starts with.

    Of a rule that is given as allow and as block, block holds. A path that isn't empty and doesn't begin with / fits nothing.
    """
    root = Node()
    for action, host, path in rules:
        if path and not path.startswith("/"):
            continue
        node, host = root, host.translate(_LOWER)
        for label in reversed(host.split(".")):
            node.next = {} if node.next is None else node.next
            node = node.next.setdefault(label, Node())
        at = node.paths = node.paths or Paths()
        found = (len(host) + len(path), len(host), f"{host}{path}", action)
        if not path:
            at.rule = max(found, at.rule or found)
            continue
        *whole, start = path[1:].split("/")
        for segment in whole:
            at.next = {} if at.next is None else at.next
            at = at.next.setdefault(segment, Paths())
        at.starts = {} if at.starts is None else at.starts
        at.starts[start] = max(found, at.starts.get(start) or found)
        if len(start) not in at.lengths:
            at.lengths = tuple(sorted([*at.lengths, len(start)]))
    return root


def trie_bytes(rules: Iterable[Rule]) -> int:
    """What a worker's trie of rules takes at most, about: nodes for each label and segment, and the rule itself."""
    return sum(400 + 330 * (host.count(".") + 1) + 350 * path.count("/") + 6 * (len(host) + len(path)) for _, host, path in rules)


def longest_match(trie: Node, host: str, path: str) -> tuple | None:
    """The fitting rule of the greatest length (host and path; of equal ones, the longer host's)."""
    fits, node = [], trie
    segments = path.split("/")[1:] if path.startswith("/") else []
    for label in reversed(host.split(".")):
        node = node.next and node.next.get(label)
        if node is None:
            break
        at = node.paths
        if at is None:
            continue
        fits.append(at.rule)
        for segment in segments:
            for n in at.lengths:
                if n > len(segment):
                    break
                fits.append(at.starts.get(segment[:n]))
            at = at.next and at.next.get(segment)
            if at is None:
                break
    return max([x for x in fits if x], default=None)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    A null url, or one without ://, has an empty host and path and so fits no rule: rule is null and verdict is
    the default, as for any url that no rule fits. Of a rule given as allow and as block, block holds; rules' hosts are lower-cased,
    and a rule's path that isn't empty begins with /, or it fits nothing. Very long urls are judged whole. Repeated rows stay;
    columns of pages by these four names are replaced, others stay, whatever their names. An empty table gives an
    empty result, and no rules fit nothing.
    """
    rows = pages.select(F.struct(*pages.columns).alias("own"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    found = _by_trie(rows, rules) if trie_bytes(rules) <= MAX_TRIE else _by_join(rows, rules)
    kept = [F.col("own")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return found.select(*kept, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", F.lit(default)).alias("verdict"))


def _by_trie(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    trie = rows.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, action string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [longest_match(trie.value, h, p) for h, p in zip(host, path)]
        return pd.DataFrame({"rule": [f and f[2] for f in found], "action": [f and f[3] for f in found]}, dtype="object")

    return rows.withColumn("found", judge("host", "path"))


def _by_join(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The same for rule lists of any size. A rule stands under its host and its path's folder, up to the last /; a url goes to
    each suffix of its host and each folder of its path, so that it meets no rules but those of its own folders. Equal
    urls go once, and only those that meet a rule of their folders go on.
    """
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.concat(F.slice(parts, F.lit(1), i), F.array(F.lit(""))), "/"))
    each = urls.select("host", "path", F.explode(suffixes).alias("suffix")).select("*", F.explode(folders).alias("folder"))
    own = [(action, host.translate(_LOWER), path) for action, host, path in rules]
    known = rows.sparkSession.createDataFrame(own, "action string, suffix string, start string").withColumn("folder", F.regexp_replace("start", "[^/]*$", ""))
    fits = each.join(known, ["suffix", "folder"]).where(F.startswith("path", "start"))
    rank = F.struct(F.length("suffix") + F.length("start"), F.length("suffix"), F.concat("suffix", "start").alias("rule"), "action")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.struct("best.rule", "best.action").alias("found"))
    return rows.join(best, ["host", "path"], "left")
