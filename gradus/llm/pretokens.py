"""Split texts into the pre-tokens of byte-level BPE with array operations, and remember what each distinct one gives.

The split is that of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

written as rules on neighbouring characters, so that a whole block of documents is split at once. Special strings
inside a text count as one token, as is the library's default.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex

OTHER, LETTER, NUMBER, SPACE, EDGE, SPECIAL = range(6)
#: Code points that the pattern's \s matches.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = 0x9E3779B97F4A7C15
_SPECIAL_HASH = np.uint64(1)
_CLASS_STEP = 1 << 12
BLOCK_CHARS = 1 << 18
PIECE_CHARS = 1 << 17


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point; where two Unicode versions disagree, the library's own split decides."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for low in range(0, 0x110000, _CLASS_STEP):  # a few code points at a time, so that few objects live at once
        order = np.arange(low, low + _CLASS_STEP)
        order = order[(order < 0xD800) | (order >= 0xE000)]
        text = order.astype("<u4").tobytes().decode("utf-32-le")
        table[order] = np.fromiter((kinds.get(unicodedata.category(c)[0], OTHER) for c in text), np.uint8, len(order))
        for pattern, kind, beside in ((r"\p{L}+", LETTER, "a"), (r"\p{N}+", NUMBER, "1")):
            for found in regex.finditer(pattern, text):
                for c in order[found.start():found.end()][table[order[found.start():found.end()]] != kind].tolist():
                    if len(split(beside + chr(c))) == 1:
                        table[c] = kind
    table[WHITE] = SPACE
    return table


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            def steps(base: int) -> np.ndarray:
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                return np.cumprod(factors)

            cls.up, cls.down = steps(_BASE), steps(pow(_BASE, -1, 1 << 64))
        return cls.up[:n], cls.down[:n]


def _cut(text: str) -> Iterator[str]:
    """Cut a very long text at single spaces between words, where a pre-token starts whatever stands around."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = text.find(" ", at + PIECE_CHARS)
        while cut >= 0 and (text[cut - 1].isspace() or text[cut + 1:cut + 2].isspace() or cut + 1 == len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def blocks(texts: Iterable[str | None], special: str | None) -> Iterator[list[tuple[int, str | None]]]:
    """Blocks of (document, piece); a piece of None stands for the special string."""
    block, size = [], 0
    for d, text in enumerate(texts):
        for k, part in enumerate(text.split(special) if text and special and special in text else [text or ""]):
            if k:
                block.append((d, None))
            for piece in _cut(part) if part else ():
                if size + len(piece) > BLOCK_CHARS and block:
                    yield block
                    block, size = [], 0
                block.append((d, piece))
                size += len(piece)
    if block:
        yield block


class Split:
    """Pre-tokens of one block: character ranges, document and hash of each."""

    def __init__(self, block: list[tuple[int, str | None]]):
        self.text = "\n".join("x" if piece is None else piece for _, piece in block) + "\n"
        sizes = np.fromiter((1 if piece is None else len(piece) for _, piece in block), np.int64, len(block))
        edges = np.cumsum(sizes + 1) - 1
        cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _classes()[cp]
        kind[edges] = EDGE
        kind[edges[np.fromiter((piece is None for _, piece in block), bool, len(block))] - 1] = SPECIAL

        before = np.concatenate(([np.uint8(EDGE)], kind[:-1]))
        after = np.concatenate((kind[1:], [np.uint8(EDGE)]))
        after_blank = np.concatenate(([False], cp[:-1] == 32)) & (before == SPACE)
        starts = np.where(kind == SPACE, (before != SPACE) | ((after != SPACE) & (after != EDGE)),
                          (before != kind) & ~after_blank)
        starts &= kind != EDGE
        self._contractions(cp, starts, kind)

        bounds = np.flatnonzero(starts | (kind == EDGE))
        real = np.flatnonzero(starts[bounds])
        self.start, self.end = bounds[real], bounds[real + 1]
        self.doc = np.fromiter((d for d, _ in block), np.int64, len(block))[np.searchsorted(edges, self.start)]
        up, down = _Powers.of(len(cp) + 1)
        sums = np.zeros(len(cp) + 1, np.uint64)
        weighted = cp.astype(np.uint64)
        weighted += np.uint64(1)
        weighted *= up[:-1]
        np.cumsum(weighted, out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        h ^= h >> np.uint64(29)
        h += (self.end - self.start).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        h[kind[self.start] == SPECIAL] = _SPECIAL_HASH
        self.hash = h

    @staticmethod
    def _contractions(cp: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> None:
        at = np.flatnonzero((cp == 39) & starts)
        if not at.size:
            return
        padded = np.concatenate((cp, np.zeros(3, cp.dtype)))
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((at[short], 2), (at[long], 3)):
            starts[hit + 1] = False
            starts[hit + size] = kind[hit + size] != EDGE
        # the character after a contraction may itself be a blank that opens the next pre-token: it already is a start

    def string(self, i: int) -> str:
        return self.text[self.start[i]:self.end[i]]


class Memo:
    """Values of distinct pre-tokens by hash; emptied when it holds ``limit`` of them, which costs time only.

    Hashes lie sorted beside their rows, 16 bytes for each, and not as objects in a dict.
    """

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)

    def rows(self, split: Split) -> np.ndarray:
        """Row of each pre-token of the block; missing ones are worked out first."""
        if len(self.hashes) > self.limit:
            self._forget()
            self.clear()
        codes, distinct = pd.factorize(split.hash)
        place = np.searchsorted(self.hashes, distinct)
        found = np.full(len(distinct), -1, np.int64)
        held = np.flatnonzero(place < len(self.hashes))
        held = held[self.hashes[place[held]] == distinct[held]]
        found[held] = self.numbers[place[held]]
        missing = np.flatnonzero(found < 0)
        if missing.size:
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            words = [None if h == int(_SPECIAL_HASH) else split.string(at)
                     for h, at in zip(distinct[missing].tolist(), first[missing].tolist(), strict=True)]
            base = len(self.hashes)
            self.add(words)
            found[missing] = np.arange(base, base + len(words))
            order = missing[np.argsort(distinct[missing])]
            self.hashes = np.insert(self.hashes, place[order], distinct[order])
            self.numbers = np.insert(self.numbers, place[order], found[order])
        return found[codes]


class Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype: type):
        self.data, self.size = np.empty(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            bigger = np.empty(max(need, 2 * len(self.data)), self.data.dtype)
            bigger[:self.size] = self.data[:self.size]
            self.data = bigger
        self.data[self.size:need] = values
        self.size = need


class LibraryIds(Memo):
    """Ids of pre-tokens as the tokenizers library gives them."""

    def __init__(self, path: str, limit: int = 500_000):
        super().__init__(limit)
        from tokenizers import Tokenizer

        self.tokenizer, self.special, self.special_id = Tokenizer.from_file(path), *byte_level(path)
        self.clear()

    def clear(self) -> None:
        self.flat, self.first, self.count = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def add(self, words: list[str | None]) -> None:
        model, as_symbols = self.tokenizer.model.tokenize, _byte_symbols()
        ids = [[self.special_id] if w is None else
               [t.id for t in model(w.encode().decode("latin-1").translate(as_symbols))] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.first.extend(self.flat.size + np.cumsum(sizes) - sizes)
        self.count.extend(sizes)
        self.flat.extend(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for block in blocks(texts, self.special):
            split = Split(block)
            rows = self.rows(split)
            sizes = self.count.data[rows]
            ends = np.cumsum(sizes)
            at = np.repeat(self.first.data[rows] - (ends - sizes), sizes)
            at += np.arange(len(at))
            ids = self.flat.data[at]
            docs = np.flatnonzero(np.diff(split.doc, prepend=-1))
            cuts = np.append((ends - sizes)[docs], len(ids)).tolist()
            for k, d in enumerate(split.doc[docs].tolist()):
                parts[d].append(ids[cuts[k]:cuts[k + 1]])
        none = np.empty(0, np.uint32)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else none for p in parts]


@lru_cache(1)
def _byte_symbols() -> dict[int, str]:
    """The visible character that stands for each byte in vocabularies of this kind: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_level(path: str) -> tuple[str | None, int]:
    """The special string and its id; refuses tokenizers that are not laid out as this module's split expects."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    layout = told.get("pre_tokenizer") or {}
    if told.get("normalizer") or layout.get("type") != "ByteLevel" or layout.get("add_prefix_space") or not layout.get("use_regex", True):
        raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
    added = [(t["content"], t["id"]) for t in told["added_tokens"]]
    if len(added) > 1:
        raise ValueError("more than one added token")
    return added[0] if added else (None, -1)


@lru_cache(2)
def library_ids(path: str) -> LibraryIds:
    """One memo for each worker process and tokenizer."""
    return LibraryIds(path)
