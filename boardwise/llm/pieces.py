"""Byte-level BPE ids of whole texts, cached by what stands between spaces.

The pattern that cuts texts before merging always cuts ahead of a space that a character other than white space
follows, and around a newline that no white space adjoins. Texts are cut there; each distinct stretch is encoded
once in a worker, by the tiktoken library, and its ids are kept as bytes.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import tiktoken

#: Stretches that a worker keeps before it starts afresh. It changes the speed only.
CACHE = 250_000

_open_newline = re.compile(r"\n\s|\s\n")
_open_space = re.compile(r" (?:\s|\Z)")
_cut = re.compile(r" (?=\S)")


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Ranks by token bytes, from the content of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def encoding(content: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(content), special_tokens={})


def cut_text(text: str) -> list[list[str]]:
    """Stretches by line: a line's first one as it stands, the others without the space ahead of them.

    The text is its lines joined by newlines. Each stretch, with its space, and each of those newlines is cut by the pattern apart.
    """
    lines = text.split("\n") if _open_newline.search(text) is None else [text]
    if _open_space.search(text) is None:
        return [line.split(" ") for line in lines]
    return [_cut.split(line) for line in lines]


class _Kept(dict):
    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[key] = np.array(self.encode(self.before + key), dtype="<u4").tobytes() if self.before or key else b""
        return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers; special strings become the ids given for them."""

    def __init__(self, content: bytes, pattern: str, special: dict[str, int] | None = None):
        encode = encoding(content, pattern).encode_ordinary
        self.spaced, self.plain = _Kept(encode, " "), _Kept(encode, "")
        self.newline = self.plain["\n"]
        self.special = special or {}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if special else None

    def ordinary(self, text: str) -> bytes:
        out, spaced, plain = [], self.spaced, self.plain
        for first, *rest in cut_text(text):
            out.append(b"".join([plain[first], *[spaced[x] for x in rest]]))
        return self.newline.join(out)

    def __call__(self, text: str) -> bytes:
        if self.marks is None or self.marks.search(text) is None:
            return self.ordinary(text)
        return b"".join(np.uint32(self.special[x]).tobytes() if x in self.special else self.ordinary(x) for x in self.marks.split(text))


_workers: dict[int, Encoder] = {}


def of_worker(content: bytes, pattern: str, special: dict[str, int] | None = None) -> Encoder:
    key = hash((content, pattern, tuple((special or {}).items())))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(content, pattern, special)
    return _workers[key]
