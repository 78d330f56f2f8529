"""Context-triggered piecewise hashing of documents, and the likeness of two fingerprints.

A hash rolling over the last eight bytes ends a piece wherever its low bits are all ones, so boundaries move with the
content. Each piece gives one of 64 signature characters. The block size is the smallest power of two, from 4, whose
signature has at most 64 characters; a fingerprint holds the signatures at that size and at twice that size, as
``size:signature:signature``. Whole texts count, equal texts have equal fingerprints, an empty text has ``4::``.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .arrow import in_slices, over_batches
from .pretokens import _BASE, _Powers

MOST_PIECES = 64
_ALPHABET = np.frombuffer((string.ascii_letters + string.digits + "+/").encode(), np.uint8)
_WINDOW = 8
_BLOCK = 1 << 20
_MULTIPLIER = 0x01000193


def _rolling(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the last eight bytes at every place after the first eight: three doublings of the window."""
    h = data.astype(np.uint32)
    factor, step = _MULTIPLIER, 1
    while step < _WINDOW:
        h[step:] = h[step:] + h[:-step] * np.uint32(factor)
        factor, step = factor * factor & 0xFFFFFFFF, 2 * step
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of all texts, computed together, a block of bytes at a time."""
    gap = bytes(_WINDOW)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    begin = _WINDOW + np.cumsum(sizes + _WINDOW) - (sizes + _WINDOW)
    last = begin + sizes - 1
    edges = np.unique(np.concatenate((begin - 1, last)))
    up, down = _Powers.of(min(len(data), _BLOCK) + 1)
    places, levels, sums, unshift = [], [], [], []
    carry, scale, unscale = np.uint64(0), 1, 1
    for first in range(0, len(data), _BLOCK):
        block = data[first:first + _BLOCK]
        before = data[max(0, first - _WINDOW):first]
        hashed = _rolling(np.concatenate((before, block)))[len(before):]
        trigger = (hashed & np.uint32(3)) == 3
        trigger[edges[np.searchsorted(edges, first):np.searchsorted(edges, first + len(block))] - first] = True
        at = np.flatnonzero(trigger)
        total = np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:len(block)])
        ones = ~hashed[at]
        low = (ones & -ones).astype(np.float64)
        levels.append(np.where(ones == 0, 30, np.log2(np.maximum(low, 1)) - 2).astype(np.int8))
        places.append(at + first)
        sums.append(carry + total[at] * np.uint64(scale))
        unshift.append(down[at + 1] * np.uint64(unscale))
        carry = np.uint64((int(carry) + int(total[-1]) * scale) % (1 << 64))
        scale = scale * pow(_BASE, len(block), 1 << 64) % (1 << 64)
        unscale = unscale * pow(_BASE, -len(block), 1 << 64) % (1 << 64)
    place, level, total, shift = (np.concatenate(x) for x in (places, levels, sums, unshift))
    owner = np.searchsorted(begin, place, side="right") - 1
    inside = (owner >= 0) & (place <= last[owner])
    closing = inside & (place == last[owner])
    real = inside & (level >= 0)
    counts = np.bincount(owner[real] * 32 + level[real], minlength=32 * len(texts)).reshape(-1, 32)
    at_least = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    chosen = np.argmax(at_least < MOST_PIECES, axis=1)
    start = np.searchsorted(place, begin - 1)

    def signatures(wanted: np.ndarray) -> list[str]:
        end = np.flatnonzero(closing | real & (level >= wanted[np.maximum(owner, 0)]))
        doc = owner[end]
        new = np.diff(doc, prepend=-1) != 0
        since = np.where(new, start[doc], np.roll(end, 1)) if len(end) else end
        h = (total[end] - total[since]) * shift[since]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        letters = _ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        return [letters[a:b] for a, b in zip(cuts, cuts[1:])]

    return [f"{4 << k}:{one}:{two}" for k, one, two in zip(chosen.tolist(), signatures(chosen), signatures(chosen + 1))]


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 at block sizes further apart than a factor of two, else one less the edit distance
    of the signatures at the block size that both have, divided by the longer one's length."""
    def parts(x: Column) -> tuple[Column, Column, Column]:
        cells = F.split(x, ":")
        return cells[0].cast("long"), cells[1], cells[2]

    def alike(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / longer)

    (size_a, a1, a2), (size_b, b1, b2) = parts(a), parts(b)
    return (F.when(a == b, F.lit(1.0)).when(size_a == size_b, alike(a1, b1)).when(size_a == 2 * size_b, alike(a1, b2))
            .when(2 * size_a == size_b, alike(a2, b1)).otherwise(F.lit(0.0)))


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter is replaced by as much of the beginning of ``following``."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def _row(ids, pairs: list[tuple[str, str]], own: list[str], following: list[str]) -> dict:
    changed = [edited(a, b).encode() for a, b in pairs]
    return {
        "id": ids, "n_chars": [len(a) for a, _ in pairs],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": own, "edited_fingerprint": fingerprints(changed) if changed else [], "next_fingerprint": following,
    }


def compare_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    Documents follow one another in ascending id (null ids first; equal ids by a hash of the text, so
    that rows that share an id spread over ranges too), the first after the last. One
    range shuffle of the two columns; a task streams its range and knows each document's follower. Only the first and
    last document of each range meet their neighbours in a second, small step, a row for each range. A null text counts
    as empty. Repeated rows follow one another as they are. An empty table gives no row. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    fields = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    order = ["id", F.xxhash64("text")]
    ordered = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(source) -> Iterator[dict]:
        import pyarrow as pa
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None

        def edge(where: int, ids: pa.Array, text: str, own: str) -> dict:
            return dict.fromkeys(("n_chars", "edited_sha256", "edited_fingerprint", "next_fingerprint"), [None]) | {
                "id": ids, "fingerprint": [own], "part": [part], "place": [where], "text": [text]}

        for batch in source:
            for piece in in_slices(batch, "text", 1 << 20):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                own, ids = fingerprints([t.encode() for t in texts]), piece.column("id")
                if held is None:
                    yield edge(0, ids[:1], texts[0], own[0])
                else:
                    ids, texts, own = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *own]
                held = ids[len(ids) - 1:], texts[-1], own[-1]
                none = [None] * (len(texts) - 1)
                yield _row(ids[:-1], list(zip(texts, texts[1:])), own[:-1], own[1:]) | {"part": none, "place": none, "text": none}
        if held is not None:
            yield edge(1, *held)

    rows = stage(over_batches(ordered, ["id", "text"], run, f"id {kind}, {fields}, part int, place int, text string"), "fingerprints")
    edges = rows.filter(F.col("part").isNotNull())
    # neighbours among the ranges that hold rows; a row for each range, without texts
    ranges = edges.filter("place = 0").select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    lasts = edges.filter("place = 1").select("id", "fingerprint", "text", "part")
    firsts = edges.filter("place = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    meeting = lasts.join(ranges, "part").join(firsts, "next_part")

    def meet(source) -> Iterator[dict]:
        for batch in source:
            values = {n: batch.column(n).to_pylist() for n in ("text", "next_text", "fingerprint", "next_fingerprint")}
            yield _row(batch.column("id"), list(zip(values["text"], values["next_text"])), values["fingerprint"], values["next_fingerprint"])

    met = over_batches(meeting, ["id", "text", "next_text", "fingerprint", "next_fingerprint"], meet, f"id {kind}, {fields}")
    return rows.filter(F.col("part").isNull()).select(met.columns).unionByName(met).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
