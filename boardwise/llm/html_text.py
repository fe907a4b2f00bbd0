"""Main text of web pages: flat text blocks, each judged by a decision tree over its own and its neighbours' values.

A page is read once, tag by tag, into a flat list of blocks with word counts, link densities and what the page's markup says of
where they stand. Spark's decision tree is trained on the labelled blocks of a few pages; tasks judge all blocks of a batch at once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty
from .page_samples import PAGES

#: Elements that end a block. Any other tag is part of its line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never text of a page; the first three hold no tags.
RAW = ("script", "style", "textarea")
HIDDEN = frozenset("button canvas datalist head iframe noscript object optgroup option select svg template title video audio".split())
#: Elements that a place is known by, and those that hold text beside a page's main text.
PLACES = frozenset("article aside body dialog div footer form header main menu nav section table ul ol dl fieldset figure details".split())
BESIDE = frozenset("aside dialog footer form menu nav".split())
#: Words in class, id and role by which places name themselves.
BESIDE_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banners?|breadcrumbs?|comments?|commentlist|complementary|consent|contentinfo|cookies?|dialog|disqus|feedback|footers?|gdpr|login"
    r"|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|notification|pagination|pager|popups?|promos?|promoted|related|replies|reply|reviews?|search|share|sharing|sidebars?"
    r"|signup|social|sponsor\w*|subscribe|subscription|toolbar|widgets?)(?:$|[^a-z])"
)
WITHIN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|articlebody|content|entry|main|post|story)(?:$|[^a-z])")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: A block's values; prev_ and next_ are those of its neighbours.
FEATURES = ["words", "links", "beside", "within", "heading", "prev_words", "prev_links", "prev_beside", "next_words", "next_links", "next_beside"]


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, bool, bool]]:
    """(text, words, share of words in links, beside, within, heading, marked) of the page's blocks, in order.

    beside: in a place for other things than main text, by its element or its name. within: in an article or a place
    named like one, nearer than any such. marked: within an element with the attribute data-main, for labelled pages.
    """
    out: list[tuple] = []
    parts: list[str] = []  # of the block so far
    linked: list[str] = []
    open_: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]  # places around: (element, beside, within, marked)
    in_link, hidden, heading = 0, "", False

    def flush() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
        if text:
            words = text.count(" ") + 1
            of_links = len(_SPACE.sub(" ", html.unescape(" ".join(linked))).split())
            out.append((text, words, min(1.0, of_links / words), *open_[-1][1:3], heading, open_[-1][3]))
        parts, linked = [], []

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            if not hidden:
                parts.append(text)
                if in_link:
                    linked.append(text)
            continue
        tag, ends = (m["tag"] or "").lower(), bool(m["end"])
        if hidden:
            hidden = "" if ends and tag == hidden or tag == "body" else hidden
            continue
        if not tag or tag in ("a", "br"):
            in_link = in_link if tag != "a" else int(not ends)
            if tag == "br":
                parts.append(" ")
            continue
        if tag in HIDDEN and not ends and not m["rest"].endswith("/"):
            hidden = tag
            continue
        if tag not in BLOCKS:
            continue
        flush()
        in_link, heading = 0, not ends and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag not in PLACES:
            continue
        if ends:
            at = next((i for i in range(len(open_) - 1, 0, -1) if open_[i][0] == tag), None)
            del open_[len(open_) if at is None else at :]
            continue
        names = " ".join(_CAMEL.sub("-", a or b or c) for a, b, c in _NAMES.findall(m["rest"])).lower().replace("_", "-")
        _, beside, within, marked = open_[-1]
        own = tag in BESIDE or tag == "header" and not within or bool(BESIDE_WORDS.search(names)) and tag != "body"
        if tag == "article" or tag == "main" or WITHIN_WORDS.search(names) and tag != "body":
            within = not (own or beside) or within
        open_.append((tag, beside or own, within, marked or "data-main" in m["rest"]))
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """A row of FEATURES for each block of one page; beyond its ends are blocks without words."""
    own = np.array([[float(v) for v in b[1:6]] for b in found]).reshape(len(found), 5)
    edge = np.zeros((1, 5))
    before, after = np.concatenate([edge, own])[:-1], np.concatenate([own, edge])[1:]
    return np.concatenate([own, before[:, :3], after[:, :3]], axis=1)


def labelled_blocks(spark: SparkSession, pages: list[str] = PAGES) -> DataFrame:
    """The labelled table: page, place, FEATURES and label (1: main text) of the pages' blocks."""
    rows = []
    for p, page in enumerate(pages):
        found = blocks(page)
        rows += [(p, k, *map(float, x), float(b[6])) for k, (x, b) in enumerate(zip(features(found), found))]
    return spark.createDataFrame(rows, "page int, place int, " + ", ".join(f"{c} double" for c in FEATURES) + ", label double")


class Tree:
    """A decision tree as arrays, which judges many rows at once."""

    def __init__(self, root) -> None:
        self.feature, self.threshold, self.low, self.high, self.label = [], [], [], [], []
        self._add(root)
        self.feature, self.threshold, self.low, self.high, self.label = (np.array(x) for x in (self.feature, self.threshold, self.low, self.high, self.label))

    def _add(self, node) -> int:
        at, inner = len(self.feature), node.subtreeDepth() > 0
        self.feature.append(node.split().featureIndex() if inner else -1)
        self.threshold.append(node.split().threshold() if inner else 0.0)
        self.label.append(node.prediction() > 0.5)
        self.low.append(-1)
        self.high.append(-1)
        if inner:
            self.low[at], self.high[at] = self._add(node.leftChild()), self._add(node.rightChild())
        return at

    def judge(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
            n = at[inner]
            at[inner] = np.where(x[inner, self.feature[n]] <= self.threshold[n], self.low[n], self.high[n])
        return self.label[at]


def train(labelled: DataFrame, depth: int = 6) -> Tree:
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=256, minInstancesPerNode=2, seed=1).fit(table)
    return Tree(model._call_java("rootNode"))


def extract_text(pages: DataFrame, *keep: str, column: str = "html", tree: Tree | None = None) -> DataFrame:
    """keep's columns of pages, text (the main text's blocks, joined by line feeds) and n_chars, for every row.

    A null or empty page, or one without main text, has the empty text. Repeated rows each have theirs. Character references
    are decoded, white space within a block is one space, and a line break within one is white space; a page that ends
    anywhere is read to its end, and a tag that doesn't end hides what follows it in the tag alone. Very long pages are
    read whole, in time that goes with their length; the task holds one batch of pages. Other columns, whatever their
    names, don't matter; an empty table gives an empty result.
    """
    own = train(labelled_blocks(pages.sparkSession)) if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(x.as_py()) for x in b.column("_page")]
            judged = own.judge(np.concatenate([np.zeros((0, len(FEATURES))), *(features(f) for f in found)]))
            texts, at = [], 0
            for f in found:
                texts.append("\n".join(x[0] for x, ok in zip(f, judged[at : at + len(f)]) if ok))
                at += len(f)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {dict(pages.dtypes)[k]}" for k in keep)
    return pages.select(*keep, text_or_empty(column).alias("_page")).mapInArrow(run, f"{kinds}, text string, n_chars long")
