"""Pack documents into as few sequences as possible: best fit, then a local search by swaps between underfull bins."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .arrow import in_slices, over_batches
from .pretokens import library_ids

SHARD_PIECES = 4096


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest item first, each into the fullest bin that can take it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that some bin has, ascending
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, sizes[item])
        if at == len(rooms):
            bins.append([])
            number, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[number].append(item)
        room -= sizes[item]
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(number)
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search: move documents, or exchange one for one or two for one, from an emptier to a fuller underfull bin.

    The emptiest bin gives first. Of all its steps to all takers the one is taken that raises the sum of squared fills
    most; a whole number with an upper bound, so the search ends. A bin left empty is dropped, one without a step is
    set aside until others have changed. Where no bin can be saved the steps still gather what room there is in few
    bins, so that bins of other shards can use it.
    """
    size = np.asarray(sizes, np.int64)
    home = np.full(len(size), -1, np.int64)
    for k, items in enumerate(bins):
        home[items] = k
    fill = np.bincount(home[home >= 0], size[home >= 0], len(bins)).astype(np.int64)
    changed = True
    while changed:
        changed, active = False, (fill > 0) & (fill < capacity)
        while np.count_nonzero(active) > 1:
            giver = int(np.where(active, fill, capacity + 1).argmin())
            active[giver] = False
            while fill[giver] and (step := _step(giver, active, size, home, fill, capacity)):
                taker, out, back = step
                home[out] = taker
                home[back] = giver
                gain = size[out].sum() - size[back].sum()
                fill[giver] -= gain
                fill[taker] += gain
                active[taker] = fill[taker] < capacity
                changed = True
    left: list[list[int]] = [[] for _ in bins]
    for item, k in enumerate(home.tolist()):
        if k >= 0:
            left[k].append(item)
    return [b for b in left if b]


def _step(giver: int, takers: np.ndarray, size: np.ndarray, home: np.ndarray, fill: np.ndarray,
          capacity: int) -> tuple[int, list[int], list[int]] | None:
    """(taker, documents that go, documents that come back) of the step that raises the squared fills most."""
    mine = np.flatnonzero(home == giver)
    one, other = np.triu_indices(len(mine), 1)
    alone = len(mine)
    offers, first = np.unique(np.concatenate((size[mine], size[mine][one] + size[mine][other])), return_index=True)
    theirs = np.flatnonzero((home >= 0) & takers[home])
    bins = np.flatnonzero(takers)
    taker = np.concatenate((bins, home[theirs]))  # a taker for each move, then one for each document that may come back
    back = np.concatenate((np.zeros(len(bins), np.int64), size[theirs]))
    fits = np.searchsorted(offers, capacity - fill[taker] + back, side="right") - 1
    gain = np.where(fits >= 0, offers[fits] - back, 0)
    raised = np.where(gain > 0, gain * (fill[taker] - fill[giver] + gain), 0)
    best = int(raised.argmax()) if len(raised) else 0
    if not len(raised) or raised[best] <= 0:
        return None
    at = int(first[fits[best]])
    out = [mine[at]] if at < alone else [mine[one[at - alone]], mine[other[at - alone]]]
    return int(taker[best]), [int(i) for i in out], [int(theirs[best - len(bins)])] if best >= len(bins) else []


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers for sizes from 1 to ``capacity``."""
    return improve(best_fit(sizes, capacity), sizes, capacity)


def cut_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, and ``serial``, a number of its own.

    A document longer than ``capacity`` is cut into full pieces; what is left over is its first piece.
    """
    def run(source):
        from pyspark import TaskContext

        memo, serial = library_ids(tokenizer), TaskContext.get().partitionId() << 40
        for batch in source:
            for part in in_slices(batch, text_col):
                at, piece, start, length, sums = [], [], [], [], []
                for row, ids in enumerate(memo.encode(part.column(text_col).to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        at.append(row), piece.append(k), start.append(a), length.append(b - a)
                        sums.append(zlib.crc32(ids[a:b]))
                yield {id_col: part.column(id_col).take(np.array(at, np.int64)), "piece": piece, "start": start,
                       "length": length, "ids_crc32": sums, "serial": serial + np.arange(len(at))}
                serial += len(at)

    kind = df.schema[id_col].dataType.simpleString()
    return over_batches(df, [id_col, text_col], run,
                        f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, serial long")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Ids are computed once, in a scan; from then on only a narrow row for each piece moves. Full pieces are sequences
    of their own. The others are dealt by hash into shards of about ``shard_pieces``, each packed by best fit and
    local search in one task. Every bin that is not full is then dealt again, whole, among bins of other shards, and
    the local search goes on from there, round after round, until a round saves no bin, or none could be saved: one
    fewer would not hold the tokens that lie in underfull bins. Shards have the same size whatever the input, so no
    task grows with it. A sequence's id is the smallest serial of its pieces.

    A null text counts as empty: one piece, the end id alone. Equal ids and repeated rows are pieces of their own. An
    empty table gives no row. Other columns are not read.
    """
    pieces = stage(cut_documents(df, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    whole = pieces.filter(F.col("length") == capacity).select(
        "*", F.col("serial").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = pack_pieces(pieces.filter(F.col("length") < capacity).select("serial", "length"), capacity, shard_pieces)
    columns = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    result = whole.select(*columns)
    if packed:
        placed = reduce(DataFrame.unionByName, packed).select("serial", "sequence_id", "offset")
        result = result.unionByName(pieces.join(placed, "serial").select(*columns))
    return result


def pack_pieces(loose: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> list[DataFrame]:
    """Stored frames that together place each row (serial, length) once: serial, length, sequence_id, offset, fill."""
    count, before, start, done = loose.count(), None, loose, []
    while count:
        shards = max(1, round(count / shard_pieces))
        packed = stage(_pack_shards(start, shards, capacity, len(done)), "packed")
        first, underfull = F.col("sequence_id") == F.col("serial"), F.col("fill") < capacity  # one row of each bin
        bins, count, left, tokens = packed.agg(
            F.count_if(first), F.count_if(underfull), F.count_if(first & underfull), F.sum(F.when(underfull, F.col("length")))).first()
        if shards == 1 or bins == before or left <= -(-(tokens or 0) // capacity):
            return [*done, packed]
        done.append(packed.filter(~underfull))
        start, before = packed.filter(underfull).select("serial", "length", "sequence_id"), left
    return done


def _pack_shards(pieces: DataFrame, shards: int, capacity: int, round_no: int) -> DataFrame:
    """One round: loose pieces by best fit, pieces that lie in bins as they lie; then the local search."""
    unit = "sequence_id" if "sequence_id" in pieces.columns else "serial"
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.lit(round_no), unit), F.lit(shards)))

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["length", "serial"], ascending=False, ignore_index=True)
        sizes, serial = pdf["length"].tolist(), pdf["serial"].to_numpy()
        bins = best_fit(sizes, capacity) if unit == "serial" else [list(b) for b in pdf.groupby(unit).indices.values()]
        number, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for items in improve(bins, sizes, capacity):
            ends = np.cumsum([sizes[i] for i in items])
            number[items], offset[items], fill[items] = serial[items].min(), ends - [sizes[i] for i in items], ends[-1]
        return pd.DataFrame({"serial": serial, "length": pdf["length"], "sequence_id": number, "offset": offset, "fill": fill})

    return dealt.groupBy("shard").applyInPandas(one, "serial long, length long, sequence_id long, offset long, fill long")
