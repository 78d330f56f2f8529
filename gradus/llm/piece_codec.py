"""Encode to and decode from SentencePiece BPE pieces by suffix-array matching.

The words of a batch that were not met before (a run of blanks and what follows up to the next one; no piece crosses
such a border) are laid out as one text. A suffix array, as deep as the longest piece, is built over it; every piece of
the vocabulary finds its occurrences by binary search; the occurrences, as edges from start to end, are sorted by
position and relaxed: an edge is taken where its piece and the one before it stand side by side, that is, where the
model's merges leave the two texts joined as just these two pieces. For merge-based models exactly one edge into each
position passes, and the path is the segmentation that the merges give. (A relaxation by sums of scores, as for unigram
models, would give other ids than this model's.) Characters without piece become bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .arrow import in_slices, over_batches

BLANK = "▁"
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_CROSSING = re.compile(f"[^{BLANK}]{BLANK}")


#: Bytes of text whose new words are segmented together: fewer and longer suffix arrays than one for every batch.
SLICE = 1 << 22


class PieceCodec:
    """A model's pieces, and the words and neighbouring pieces met so far (both emptied when they grow past a limit)."""

    def __init__(self, path: str, limit: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("a  é\nﬁ ") != f"{BLANK}a{BLANK}{BLANK}é\nﬁ{BLANK}":
            raise ValueError("only models without normalisation, with a blank before the text, are supported")
        plain = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        if any(_CROSSING.search(p) for p in text.values()):
            raise ValueError("a piece crosses the border of a word")
        self.limit, self.unknown = limit, len(model)
        self.score = {p: model.get_score(i) for i, p in text.items()}
        self.text = [text.get(i, "") for i in range(len(model))]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.said = [p.replace(BLANK, " ").encode() for p in self.text]
        for b, i in enumerate(self.bytes):
            self.said[i] = bytes([b])
        self.ids = np.array(plain)
        self.longest = max(map(len, text.values()))
        self.length = np.array([len(p) for p in self.text] + [1])
        self.points = np.zeros((len(plain), self.longest), np.uint32)
        for row, i in enumerate(plain):
            self.points[row, :len(text[i])] = [ord(c) for c in text[i]]
        self.words: dict[str, tuple[int, ...]] = {}
        self.beside: dict[int, bool] = {}

    def _merge(self, text: str) -> list[str]:
        """The model's merges on a short text: highest score first, leftmost among equals."""
        get, none = self.score.get, -np.inf
        parts = list(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            k = scores.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def _stand(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours holds; ``before`` is the unknown's number where nothing can merge across."""
        keys, back = np.unique(before * (self.unknown + 1) + piece, return_inverse=True)
        keys = keys.tolist()
        holds = list(map(self.beside.get, keys))
        for k, key in enumerate(keys):
            if holds[k] is None:
                a, b = divmod(key, self.unknown + 1)
                pair = [self.text[i] for i in (a, b) if i != self.unknown]
                joined = "".join(pair)
                holds[k] = self.beside[key] = (len(pair) < 2 or joined not in self.score) and self._merge(joined) == pair
        return np.array(holds, bool)[back]

    def _occurrences(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a piece in the text, by binary search in its suffix array."""
        letters, code = np.unique(points, return_inverse=True)  # letters[0] is the 0 between words
        bits = max(1, int(len(letters)).bit_length())
        per_key = 63 // bits
        depth = -(-self.longest // per_key)
        padded = np.concatenate((code.astype(np.uint64), np.zeros(depth * per_key, np.uint64)))

        def pack(columns: list[np.ndarray]) -> np.ndarray:
            key = np.zeros(len(columns[0]), np.uint64)
            for column in columns:
                key = key << np.uint64(bits) | column
            return key

        keys = [pack([padded[level * per_key + k:level * per_key + k + len(points)] for k in range(per_key)]) for level in range(depth)]
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        at = np.minimum(np.searchsorted(letters, self.points), len(letters) - 1)
        usable = ((letters[at] == self.points) | (self.points == 0)).all(axis=1)
        ids = self.ids[usable]
        low = np.where(self.points[usable] == 0, 0, at[usable]).astype(np.uint64)
        high = np.where(self.points[usable] == 0, (1 << bits) - 1, at[usable]).astype(np.uint64)
        fill = [np.full(len(ids), v, np.uint64) for v in (0, (1 << bits) - 1)]

        def bounds(level: int) -> tuple[np.ndarray, np.ndarray]:
            places = range(level * per_key, (level + 1) * per_key)
            return tuple(pack([m[:, p] if p < self.longest else f for p in places]) for m, f in ((low, fill[0]), (high, fill[1])))

        first, last = bounds(0)
        begin, end = np.searchsorted(keys[0], first, "left"), np.searchsorted(keys[0], last, "right")
        for level in range(1, depth):
            first, last = bounds(level)
            for k in np.flatnonzero((end > begin) & (self.length[ids] > level * per_key)).tolist():
                inside = keys[level][begin[k]:end[k]]
                a, b = np.searchsorted(inside, first[k], "left"), np.searchsorted(inside, last[k], "right")
                begin[k], end[k] = begin[k] + a, begin[k] + b
        sizes = end - begin
        where = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return suffixes[where], np.repeat(ids, sizes)

    def _segment(self, words: list[str]) -> list[list[int]]:
        joined = "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4").copy()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(sizes + 1) - (sizes + 1)
        points[start + sizes] = 0
        inside = np.ones(len(points), bool)
        inside[start + sizes] = False
        # a word may itself hold the character 0; it has no piece, so it only has to be told apart from the borders
        source, piece = self._occurrences(points)
        alone = inside.copy()
        alone[source[self.length[piece] == 1]] = False
        lonely = np.flatnonzero(alone)
        source, piece = np.concatenate((source, lonely)), np.concatenate((piece, np.full(len(lonely), self.unknown)))
        target = source + self.length[piece] - 1
        offset = target - np.repeat(start, sizes + 1)[target]
        order = np.argsort(offset, kind="stable")
        source, piece, target, offset = (x[order] for x in (source, piece, target, offset))
        at_start = np.zeros(len(points), bool)
        at_start[start] = True
        taken = np.full(len(points), -1)
        cuts = np.flatnonzero(np.diff(offset, prepend=-1)).tolist() + [len(offset)]
        for a, b in zip(cuts, cuts[1:]):
            s, p = source[a:b], piece[a:b]
            before = np.where(at_start[s] | (p == self.unknown), self.unknown, taken[s - 1])
            holds = (p == self.unknown) | self._stand(before, p)
            taken[target[a:b][holds]] = p[holds]
        found, (live, place) = [], (np.arange(len(words)), start + sizes - 1)
        while len(live):
            now = taken[place]
            found.append((live, place, now))
            place = place - self.length[now]
            more = place >= start[live]
            live, place = live[more], place[more]
        word, place, now = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, word))
        ids, ends = now[order].tolist(), np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        result = [ids[a:b] for a, b in zip([0, *ends], ends)]
        for w in np.unique(word[now == self.unknown]).tolist():  # characters without a piece become bytes
            first, at = ends[w] - len(result[w]), []
            for k, i in zip(result[w], place[order[first:ends[w]]].tolist()):
                at += [k] if k != self.unknown else [self.bytes[b] for b in joined[i].encode()]
            result[w] = at
        return result

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of every text."""
        if len(self.words) > self.limit:
            self.words.clear()
        if len(self.beside) > 5 * self.limit:
            self.beside.clear()
        split = [_WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.words))
        if new:
            # tuples of numbers are not followed by the garbage collector, lists are
            self.words.update(zip(new, map(tuple, self._segment(new)), strict=True))
        return [list(chain.from_iterable(map(self.words.__getitem__, words))) for words in split]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.said[i] for i in ids]).decode(errors="replace").removeprefix(" ")


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids, decoded text and n_chars of every row; a null text counts as empty and has no ids.

    One scan without shuffle; other columns are not read; repeated rows are encoded each on their own. Memory follows
    the longest single text and the distinct words of a slice.
    """
    def run(source) -> Iterator[dict]:
        pieces = codec(path)
        for batch in source:
            for part in in_slices(batch, text_col, SLICE):
                texts = part.column(text_col).to_pylist()
                ids = pieces.encode(texts)
                yield {id_col: part.column(id_col), "ids": ids, "decoded": [pieces.decode(i) for i in ids], "text": [t or "" for t in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df, [id_col, text_col], run, f"`{id_col}` {kind}, ids array<int>, decoded string, text string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`encode_documents` gives, as n_pieces, ids_crc32, decoded_sha256 and round_trip of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(source) -> Iterator[dict]:
        pieces = codec(path)
        for batch in source:
            for part in in_slices(batch, text_col, SLICE):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                ids = pieces.encode(texts)
                back = [pieces.decode(i) for i in ids]
                yield {id_col: part.column(id_col), "n_pieces": [len(i) for i in ids],
                       "ids_crc32": [zlib.crc32(np.array(i, "<u4")) for i in ids],
                       "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in back],
                       "round_trip": [a == b for a, b in zip(texts, back)]}

    return over_batches(df, [id_col, text_col], run, f"`{id_col}` {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
