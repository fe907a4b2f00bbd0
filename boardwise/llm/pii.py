"""Personal data: patterns, and a skip-chain conditional random field over what else could be such data.

The field's nodes are a text's tokens that could be such data: what the patterns matched, and numbers of 7 to 19 digits
(no kind has more) and addresses that they did not. Every other token is none for certain, so it needs no node. Neighbouring nodes are linked, and
repeated or similar ones, however far apart, with one of them: a match of the patterns if there is one, else the first.
So n repetitions make n - 1 links, and any two are two links apart. Links favour equal labels. Loopy belief propagation
runs until messages settle and carries labels over the whole text: a number that is a phone number once is one wherever it recurs. Patterns' own
matches are observed labels and stay. Weights are trained here, by pseudo-likelihood, on generated labelled texts.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # index in KINDS, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """From each @: the longest local part before it, not before the previous match's end, and a domain behind it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if at >= end and start < at and (m := _domain.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, by kind and start."""
    out = _emails(text) if "@" in text else []
    if re.search("[0-9]", text) is None:
        return out
    if text.count(".") > 2:
        out += [(1, *m.span()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _phone.finditer(text) if 8 <= len(_not_digit.sub("", m[0])) <= 15]
    return out


# ---- candidates and links

_number = re.compile(r"(?<![\w.,])[(]?[0-9](?:[ ).\-/]{0,2}[0-9]){6,18}+")
_at = re.compile(r" ?(?:@|\[at\]|\(at\)) ?")
_places = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)*+")
_word = re.compile(r"\w")
#: Words that announce a kind, by KINDS.
CUES = (("mail", "contact", "write"), ("ip", "host", "server"), ("card", "visa", "credit"), ("phone", "tel", "call", "fax", "mobile"))
BEFORE, NEAR = 24, 60
N_LABELS, N_OWN = 5, 17
SAME, SIMILAR, CHAIN = range(3)


def _normal(piece: str) -> str:
    if "@" in piece or "at]" in piece or "at)" in piece:
        return re.sub(r" ?[\[(]dot[\])] ?", ".", re.sub(r" ?(?:@|\[at\]|\(at\)) ?", "@", piece)).lower()
    return _not_digit.sub("", piece)


def _addresses(text: str) -> list[tuple[int, int]]:
    """Around each sign for at: local characters before it, not before the last one's end, and the places behind it."""
    out, end = [], 0
    for m in _at.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and m.start() >= end and (rest := _places.match(text, m.end())):
            end = rest.end()
            out.append((start, end))
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """(label or 0, start, end) by start: 1 + kind for the patterns' matches; 0 for others, which overlap none of them."""
    found = []
    if re.search("[0-9]", text):
        found += [m.span() for m in _number.finditer(text) if not _word.match(text, m.end())]
    if "@" in text or "at]" in text or "at)" in text:
        found += _addresses(text)
    nodes = [(k + 1, s, e) for k, s, e in base]
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    i, end = 0, -1
    for s, e in sorted(found):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= end and not (i < len(taken) and taken[i][0] < e):
            nodes.append((0, s, e))
            end = e
    return sorted(nodes, key=lambda x: x[1:])


def features(text: str, start: int, end: int) -> list[float]:
    piece, before = text[start:end], text[max(0, start - BEFORE) : start].lower()
    n = len(digits := _not_digit.sub("", piece))
    address = "@" in piece or "at]" in piece or "at)" in piece
    cues = [float(any(re.search(rf"\b{w}", before) for w in words)) for words in CUES]
    return [
        1.0, float(address), float(address and ("." in piece or "dot" in piece)), *(float(not address and a <= n <= b) for a, b in ((7, 8), (9, 10), (11, 12), (13, 15), (16, 19))),
        float(not address and 16 <= n <= 19 and luhn(digits)), float(piece.count(".") == 3), float("(" in piece and not address), float("-" in piece or " " in piece), *cues, float(any(cues)),
    ]


def _tails(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[str], list[str]]:
    """What nodes are in full, and the part by which they are alike: a local part, or the last seven digits."""
    keys = [_normal(text[s:e]) for _, s, e in nodes]
    return keys, [k.split("@")[0] if "@" in k else k[-7:] for k in keys]


def node_features(text: str, nodes: list[tuple[int, int, int]]) -> np.ndarray:
    """Own features, and the cues of any like: as skip-chain potentials see what stands around either end."""
    own = np.array([features(text, s, e) for _, s, e in nodes]).reshape(-1, N_OWN)
    tails = _tails(text, nodes)[1]
    places = {t: k for k, t in enumerate(dict.fromkeys(tails))}
    group = np.array([places[t] for t in tails], dtype=np.int64)
    cues = np.zeros((len(places), len(CUES) + 1))
    np.maximum.at(cues, group, own[:, -len(CUES) - 1 :])
    return np.hstack([own, cues[group]])


def links(text: str, nodes: list[tuple[int, int, int]]) -> np.ndarray:
    """(node, node, kind): nodes near each other, and each with the one that its likes meet in: a match of the patterns, or
    the first. At most two a node, however often they repeat."""
    keys, tails = _tails(text, nodes)
    hub: dict[str, int] = {}
    for sure in (True, False):
        for i, (label, _, _) in enumerate(nodes):
            if bool(label) == sure:
                hub.setdefault(tails[i], i)
    out = []
    for i, (_, s, _) in enumerate(nodes):
        if i and s - nodes[i - 1][2] <= NEAR:
            out.append((i - 1, i, CHAIN))
        if (j := hub[tails[i]]) != i:
            out.append((j, i, SAME if keys[j] == keys[i] else SIMILAR))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


# ---- model


def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Labels' probabilities by loopy belief propagation, until no message moves by 0.0001 or, where they swing, for `rounds`. unary: log potentials; pair: what a link adds for equal labels."""
    n = len(unary)
    if not len(edges):
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    gain = np.expm1(np.r_[pair[edges[:, 2]], pair[edges[:, 2]]])[:, None]
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    message = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, message)
        out = belief[src] - message[back]
        p = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.maximum(p.sum(axis=1, keepdims=True) + gain * p, 1e-300))
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - message).max()
        message = 0.5 * message + 0.5 * new
        if change < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, dst, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def labelled_texts(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Generated texts with all their personal data: pattern matches, other spellings of them, and numbers that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = ["the", "order", "of", "and", "report", "was", "sent", "to", "us", "item", "number", "in", "stock", "page", "about", "see", "note", "value", "total", "code"]

    def card() -> str:
        body = r.choice("4567") + digits(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    out = []
    for _ in range(n):
        parts: list[tuple[str, int | None]] = []
        kind = r.randrange(10)
        a, b, c = digits(3), digits(3), digits(4)
        name, host = "".join(r.choice("abcdefgh") for _ in range(6)), "".join(r.choice("stuvwxyz") for _ in range(5))
        if kind == 0:
            parts = [(f"+1 ({a}) {b}-{c}", 3)] + [(r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"{b}-{c}"]), 3) for _ in range(r.randrange(4))]
        elif kind == 1:
            x = card()
            parts = [(x, 2)] + [(".".join(x[i : i + 4] for i in range(0, 16, 4)), 2) for _ in range(r.randrange(3))]
        elif kind == 2:
            parts = [(f"{name}@{host}.com", 0)] + [(r.choice([f"{name} [at] {host} [dot] com", f"{name}(at){host}.com", f"{name}@{host}"]), 0) for _ in range(r.randrange(3))]
        elif kind == 3:
            parts = [(f"{r.randrange(1, 255)}.{r.randrange(255)}.{r.randrange(255)}.{r.randrange(1, 255)}", 1)]
        elif kind == 4:
            own = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}"])
            parts = [(own, 3)] * r.randrange(3) + [(r.choice(["phone ", "tel. ", "call ", "fax "]), None)] + [(own, 3)] * r.randrange(1, 3)
        elif kind == 5:
            x = digits(r.randrange(7, 16))
            parts = [(x, None)] * r.randrange(1, 4)
        elif kind == 6:
            x = card()
            parts = [(x[:15] + str((int(x[15]) + 5) % 10), None)] * r.randrange(1, 3)
        elif kind == 7:
            parts = [(f"20{digits(2)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", None), (f"{digits(3)}-{digits(4)}-{digits(3)}", None)]
        elif kind == 8:
            parts = [(r.choice([f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(4)} {digits(4)}", f"{r.randrange(300, 999)}.{r.randrange(300, 999)}.10.20"]), None)]
        else:
            parts = [(r.choice([f"look @ {host}", f"{name} @{host}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"]), None)]
        text, gold, cue = "", [], False
        for piece, label in parts:
            if not cue:
                text += " ".join(r.choice(words) for _ in range(r.randrange(1, 30))) + " "
            if label is not None:
                gold.append((label, len(text), len(text) + len(piece)))
            cue = piece.endswith(" ")
            text += piece + ("" if cue else " ")
        out.append((text + "end.", gold))
    return out


@lru_cache(maxsize=2)
def trained(n: int = 3000, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Node weights (features by labels) and link weights, by gradient ascent on the pseudo-likelihood of n labelled texts."""
    xs, ys, neighbours = [], [], []
    for text, gold in labelled_texts(n, seed):
        base = base_spans(text)
        nodes = candidates(text, base)
        label = [k or next((g + 1 for g, s, e in gold if s < end and start < e), 0) for k, start, end in nodes]
        counts = np.zeros((len(nodes), 3, N_LABELS))
        for i, j, kind in links(text, nodes):
            counts[i, kind, label[j]] += 1
            counts[j, kind, label[i]] += 1
        x = node_features(text, nodes)
        for i, (observed, _, _) in enumerate(nodes):
            if not observed:
                xs.append(x[i])
                ys.append(label[i])
                neighbours.append(counts[i])
    x, y, c = np.array(xs), np.eye(N_LABELS)[ys], np.array(neighbours)
    node, pair = np.zeros((x.shape[1], N_LABELS)), np.zeros(3)
    for _ in range(2500):
        score = x @ node + np.einsum("nkl,k->nl", c, pair)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        node += 1.0 * (x.T @ (y - p) / len(x) - 2e-4 * node)
        pair += 0.5 * (np.einsum("nkl,nl->k", c, y - p) / len(x) - 1e-4 * pair)
    return node, pair


def all_spans(text: str, model: tuple[np.ndarray, np.ndarray], sure: float = 0.8) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those with what the field adds: candidates whose likeliest label is surer than `sure`."""
    base = base_spans(text)
    nodes = candidates(text, base)
    rest = [i for i, x in enumerate(nodes) if not x[0]]
    if not rest:
        return base, base
    node, pair = model
    unary = np.zeros((len(nodes), N_LABELS))
    unary[rest] = node_features(text, nodes)[rest] @ node
    for i, (label, _, _) in enumerate(nodes):
        if label:
            unary[i] = -1e9  # however many likes speak against it
            unary[i, label] = 0.0
    p = marginals(unary, links(text, nodes), pair)
    more = [(int(p[i].argmax()) - 1, *nodes[i][1:]) for i in rest if p[i].argmax() and p[i].max() > sure]
    return base, sorted(base + more)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind's name in angle brackets."""
    out, end, pending = [], 0, None
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if pending and s < pending[2]:
            pending = (pending[0], pending[1], max(e, pending[2]))
            continue
        if pending:
            out += [text[end : pending[1]], f"<{KINDS[pending[0]].upper()}>"]
            end = pending[2]
        pending = (k, s, e)
    if pending:
        out += [text[end : pending[1]], f"<{KINDS[pending[0]].upper()}>"]
        end = pending[2]
    return "".join([*out, text[end:]])


def find_personal_data(docs: DataFrame, into: str = "pii") -> DataFrame:
    """Adds to docs a struct, the column `into`: the patterns' counts by kind, base_sha256, spans and the masked text.

    Every row has its result. Null and empty texts have no spans, and a null text stays null. Offsets are in code points.
    A column of that name is replaced; others, whatever their names, don't matter. An empty table gives an empty result. A
    very long text is one row of one task: matching and links go in proportion to it.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, spans = all_spans(t, model.value)
            counts = [sum(k == i for k, _, _ in base) for i in range(4)]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), masked(t, spans) if spans else None))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"])

    return docs.withColumn(into, scan(text_or_empty()))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars, if there, set to the new length of changed texts.

    Null texts and texts without personal data stay as they are, and every row and column stays, whatever its name; repeated
    rows are masked each, alike. A very long text is masked whole, by the task that reads it. An empty table gives an empty result.
    """
    own = docs.select("text", F.struct(*docs.columns).alias("row"))
    out = find_personal_data(own, "found")
    new = F.coalesce("found.masked", "text")
    changed = {"text": new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("found.masked").isNull(), F.col("row.n_chars")).otherwise(F.length(new)).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
