"""Count tokens of byte-level BPE by merging ragged arrays in rank order.

Distinct pre-tokens of a block lie one after another in an array of symbols. Every round finds the lowest-ranked
neighbouring pair of each sequence and merges it in all sequences at once; sequences without a pair left are done,
and the symbols that survive are counted.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import in_slices, over_batches
from .pretokens import Grown, Memo, Split, _byte_symbols, blocks, byte_level

_NO_RANK = np.int64(1 << 40)


class MergedCounts(Memo):
    """Number of symbols that survive the merges of each distinct pre-token."""

    def __init__(self, path: str, limit: int = 500_000):
        super().__init__(limit)
        self.special, _ = byte_level(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab["".join(p)] for p in pairs], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        # a merge may be applied at all its places at once unless what it makes takes part in an earlier-ranked merge
        earliest = np.full(self.width, _NO_RANK)
        np.minimum.at(earliest, left, np.arange(len(pairs)))
        np.minimum.at(earliest, right, np.arange(len(pairs)))
        self.one_by_one = earliest[made] < np.arange(len(pairs))
        self.symbol = np.array([vocab[_byte_symbols()[b]] for b in range(256)], np.int64)
        self.clear()

    def clear(self) -> None:
        self.count = Grown(np.int64)

    def add(self, words: list[str | None]) -> None:
        data = [b"" if w is None else w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        counts = self.survivors(self.symbol[np.frombuffer(b"".join(data), np.uint8)], sizes)
        counts[[i for i, w in enumerate(words) if w is None]] = 1
        self.count.extend(counts)

    def survivors(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        counts = sizes.copy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        while len(symbols) > 1:
            keys = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where((self.keys[at] == keys) & (owner[:-1] == owner[1:]), self.rank[at], _NO_RANK)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(np.append(rank, _NO_RANK), first)
            alive = lowest < _NO_RANK
            if not alive.any():
                break
            lengths = np.diff(np.append(first, len(owner)))
            hit = np.append(rank == np.repeat(lowest, lengths)[:-1], False) & np.repeat(alive, lengths)
            places = np.flatnonzero(hit)
            run = np.flatnonzero(np.diff(places, prepend=-2) != 1)  # overlapping places of one pair: every second one
            places = places[(np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))) % 2 == 0]
            single = self.one_by_one[rank[places]] & (np.diff(owner[places], prepend=-1) == 0)
            places = places[~single]
            symbols[places] = self.made[rank[places]]
            keep = np.repeat(alive, lengths)
            keep[places + 1] = False
            counts -= np.bincount(owner[places], minlength=len(counts))
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def tokens(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of every text."""
        total = np.zeros(len(texts), np.int64)
        for block in blocks(texts, self.special):
            split = Split(block)
            rows = self.rows(split)
            counted = self.count.data[rows]
            total += np.bincount(split.doc, counted, len(texts)).astype(np.int64)
        return total


@lru_cache(2)
def merged_counts(path: str) -> MergedCounts:
    return MergedCounts(path)


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    One scan without shuffle; other columns are not read. A null text counts as empty: no bytes, no tokens. Rows with
    equal or null ids are counted on their own. Very long texts are cut where a pre-token must start, so memory
    follows the longest single text only.
    """
    def run(source):
        counter = merged_counts(path)
        for batch in source:
            for part in in_slices(batch, text_col):
                texts = part.column(text_col).to_pylist()
                tokens = counter.tokens(texts)
                yield {
                    id_col: part.column(id_col),
                    "n_bytes": np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts)),
                    "n_tokens": tokens, "over_limit": pa.array(tokens > limit),
                }

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df, [id_col, text_col], run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
