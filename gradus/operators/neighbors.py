"""Exact k nearest neighbours of every point to the others, by Euclidean distance, ties by key.

Points are placed in cells of similar size by a tree of split values learnt from a bounded sample
(as a range partitioner does for one column; the sample steers the layout only, never the result).
Neighbours are found cell by cell; a point then visits just those other cells its current search
ball reaches, and the candidates are merged. No pair outside those cells is ever formed. A point whose
own cell holds too few others takes its ball from the nearest sampled points instead: any k + 1 points
bound the distance to the k nearest.

Copies: of points with identical coordinates only the k + 1 smallest keys (per fold) can be anyone's
neighbour, so the rest are taken out before and rejoined after. A third of all rows on one spot is
therefore no larger a cell than any other.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.staging import stage

# the functions below run inside tasks: send them along, executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_ROWS = 2048
ONE_CELL_ROWS = 8192  # up to here a single cell is faster than laying out several
MAX_CELLS = 1 << 18
_SAMPLE_PER_CELL = 16
_LEAST_SAMPLE = 1024
_MOST_ANCHORS = 1 << 16  # sampled points that go to every task: at most 8 bytes a feature each
_VISITORS = 16384
_HOT_SPOT_ROWS = 10_000
_CHUNK_VALUES = 1 << 17  # distances held at once: stays in the processor cache
_NO_FOLD = -1


class SplitTree:
    """Complete binary tree in heap order; a leaf number is a cell."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros((1 << depth) - 1, dtype=np.int16)
        self.value = np.full((1 << depth) - 1, np.inf)
        self._grow(sample, 0, 0)

    def _grow(self, rows: np.ndarray, node: int, level: int) -> None:
        if level == self.depth or len(rows) < 2:
            return
        spread = rows.max(axis=0) - rows.min(axis=0)
        dim = int(spread.argmax())
        if spread[dim] > 0:
            column = rows[:, dim]
            value = np.median(column)
            if value == column.max():
                value = column[column < value].max()
            self.dim[node], self.value[node] = dim, value
            left = column <= value
            self._grow(rows[left], 2 * node + 1, level + 1)
            self._grow(rows[~left], 2 * node + 2, level + 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.dim[node]] > self.value[node])
        return node - len(self.dim)

    def reached(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs of all cells that a cube of half-width ``radius`` around x may touch."""
        frontier = [(0, np.arange(len(x)))]
        out_rows, out_cells = [], []
        while frontier:
            node, rows = frontier.pop()
            if not len(rows):
                continue
            if node >= len(self.dim):
                out_rows.append(rows)
                out_cells.append(np.full(len(rows), node - len(self.dim)))
                continue
            at, r = x[rows, self.dim[node]], radius[rows]
            frontier.append((2 * node + 1, rows[at - r <= self.value[node]]))
            frontier.append((2 * node + 2, rows[at + r > self.value[node]]))
        if not out_rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_rows), np.concatenate(out_cells)


def _distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature in order (same rounding as a SQL sum of squares)."""
    total = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        gap = queries[:, j, None] - points[None, :, j]
        total += gap * gap
    return total


def _search_limit(d2: np.ndarray, folds: np.ndarray, need: int) -> np.ndarray:
    """Squared radius holding ``need`` points whichever single fold is left out."""
    n = d2.shape[1]
    if n < need:
        return np.full(len(d2), np.inf)
    if folds[0] == _NO_FOLD:
        return np.partition(d2, need - 1, axis=1)[:, need - 1]
    # a few spare neighbours nearly always outlast the loss of a fold; rows where they do not are
    # decided on all points
    few = min(n, 4 * need)
    index = np.argpartition(d2, few - 1, axis=1)[:, :few]
    near = np.take_along_axis(d2, index, axis=1)
    order = np.argsort(near, axis=1)
    near, near_folds = np.take_along_axis(near, order, axis=1), folds[np.take_along_axis(index, order, axis=1)]
    limit = near[:, need - 1].copy()
    undecided = np.zeros(len(d2), dtype=bool)
    for held_out in np.unique(near_folds):
        kept = np.cumsum(near_folds != held_out, axis=1)
        undecided |= kept[:, -1] < need
        limit = np.maximum(limit, near[np.arange(len(near)), np.minimum((kept < need).sum(axis=1), few - 1)])
    for held_out in np.unique(folds) if undecided.any() else ():
        kept = d2[np.ix_(undecided, folds != held_out)]
        limit[undecided] = np.maximum(
            limit[undecided],
            np.partition(kept, need - 1, axis=1)[:, need - 1] if kept.shape[1] >= need else np.inf)
    return limit


class Anchors:
    """Sampled candidates in the order of their cells: points that bound a search ball from outside."""

    def __init__(self, tree: SplitTree, points: np.ndarray, folds: np.ndarray):
        cells = tree.cells(points)
        order = np.argsort(cells, kind="stable")[::max(1, ceil(len(cells) / _MOST_ANCHORS))]
        self.cells, self.points, self.folds = cells[order], points[order], folds[order]

    def limits(self, queries: np.ndarray, cell: int, need: int) -> np.ndarray:
        """Squared radii for queries of one cell, from a window around it that widens until all are finite."""
        limits = np.full(len(queries), np.inf)
        middle, reach = int(np.searchsorted(self.cells, cell)), 4 * need
        while len(queries):
            window = slice(max(0, middle - reach), middle + reach)
            points, folds = self.points[window], self.folds[window]
            step = max(1, _CHUNK_VALUES // max(1, len(points)))
            for start in range(0, len(queries), step):
                part = slice(start, start + step)
                limits[part] = _search_limit(_distances(queries[part], points), folds, need) if len(points) else np.inf
            if len(points) == len(self.points) or np.isfinite(limits).all():
                break
            reach *= 4
        return limits


def _columns(features: int) -> tuple[list[str], list[str]]:
    return [f"q{j}" for j in range(features)], [f"x{j}" for j in range(features)]


def _pairs(queries, points, keys, folds, limit, need):
    """Frame of (query, neighbour) rows within the limit (found here if not given), and the limits."""
    limits = np.empty(len(queries)) if limit is None else limit
    step = max(1, _CHUNK_VALUES // max(1, len(points)))
    rows, cols, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        d2 = _distances(queries[part], points)
        if limit is None:
            limits[part] = _search_limit(d2, folds, need)
        row, col = np.nonzero(d2 <= limits[part][:, None])
        rows.append(row + start)
        cols.append(col)
        found.append(d2[row, col])
    row, col = np.concatenate(rows), np.concatenate(cols)
    q_names, x_names = _columns(points.shape[1])
    frame = pd.DataFrame(np.hstack([queries[row], points[col]]), columns=[*q_names, *x_names])
    frame["d2"], frame["key"], frame["fold"] = np.concatenate(found), keys[col], folds[col]
    return frame, limits


def nearest_neighbors(
    points: DataFrame, key: str, features: Sequence[str], k: int,
    fold: str | None = None, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, total: int | None = None,
) -> DataFrame:
    """``(key, [fold,] features..., neighbors)``, neighbours nearest first as structs (d2, key, fold, x).

    Without ``fold`` the array has the k nearest other points. With it, the array has enough of the
    nearest ones that k remain whichever fold's points are left out (see :func:`outside_fold`).
    ``points`` is read several times: hand in a stored table. ``total`` is its row count, if known.
    """
    d = len(features)
    q_names, x_names = _columns(d)
    need = k + 1  # the point itself is among its own nearest
    key_type = points.schema[key].dataType
    base = points.select(
        F.col(key).alias("key"),
        (F.col(fold).cast("int") if fold else F.lit(_NO_FOLD)).alias("fold"),
        *[(F.col(f).cast("double") + F.lit(0.0)).alias(x) for f, x in zip(features, x_names)],
    )
    rank = F.row_number().over(Window.partitionBy(*x_names, "fold").orderBy("key"))
    candidates = base.withColumn("__rank", rank).filter(F.col("__rank") <= need).drop("__rank")

    total = points.count() if total is None else total
    one_cell = max(cell_rows, ONE_CELL_ROWS if cell_rows == CELL_ROWS else 0)
    depth, sample, folds_of = 0, np.empty((0, d)), np.empty(0, np.int64)
    if total > one_cell:  # crowded spots leave few candidates, and cells are made for those
        candidates = stage(candidates, "knn-candidates")
        left = candidates.count()
        depth = 0 if left <= one_cell else min(ceil(log2(left / cell_rows)), int(log2(max_cells)))
    if depth:
        share = min(1.0, max(_LEAST_SAMPLE, _SAMPLE_PER_CELL * (1 << depth)) / left)
        drawn = candidates.select(*x_names, "fold").sample(share, 42).toPandas()
        sample, folds_of = drawn[x_names].to_numpy(float), drawn["fold"].to_numpy()
    tree = SplitTree(np.unique(sample, axis=0), depth)
    layout = tree, Anchors(tree, sample, folds_of)
    shared = points.sparkSession.sparkContext.broadcast(layout) if depth > 4 else None

    def get_layout() -> tuple[SplitTree, Anchors]:
        return shared.value if shared is not None else layout

    @F.pandas_udf(T.IntegerType())
    def cell_of(*columns: pd.Series) -> pd.Series:
        return pd.Series(get_layout()[0].cells(np.column_stack(columns)).astype(np.int32))

    def arrays(pdf: pd.DataFrame):
        pdf = pdf.sort_values("key")
        return pdf[x_names].to_numpy(float), pdf["key"].to_numpy(), pdf["fold"].to_numpy()

    def within_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, keys, folds = arrays(pdf)
        queries = np.unique(xs, axis=0)
        found, limits = _pairs(queries, xs, keys, folds, None, need)
        found["dest"], found["limit2"] = -1, np.nan
        own = int(pdf["cell"].iloc[0])
        cells, anchors = get_layout()
        unknown = np.isinf(limits)
        limits[unknown] = anchors.limits(queries[unknown], own, need)
        row, cell = cells.reached(queries, np.sqrt(limits) * (1 + 1e-9))
        row, cell = row[cell != own], cell[cell != own]
        visits = pd.DataFrame(queries[row], columns=q_names)
        visits[x_names] = np.nan
        visits["d2"], visits["key"], visits["fold"] = np.nan, None, _NO_FOLD
        visits["dest"], visits["limit2"] = cell.astype(np.int32), limits[row]
        out = found if visits.empty else pd.concat([found.astype({"key": object}), visits], ignore_index=True)
        return out[out_names]

    pair_schema = T.StructType(
        [T.StructField(c, T.DoubleType()) for c in [*q_names, *x_names, "d2"]]
        + [T.StructField("key", key_type), T.StructField("fold", T.IntegerType())]
    )
    out_schema = T.StructType(pair_schema.fields + [
        T.StructField("dest", T.IntegerType()), T.StructField("limit2", T.DoubleType())])
    pair_names, out_names = pair_schema.names, out_schema.names

    placed = candidates.withColumn("cell", cell_of(*x_names) if depth else F.lit(0))
    if depth:
        placed = stage(placed, "knn-points")
    local = placed.groupBy("cell").applyInPandas(within_cell, out_schema)
    pairs = local.filter("dest < 0").select(*pair_names)
    if depth:
        local = stage(local, "knn-local")
        visits = local.filter("dest >= 0").select("dest", "limit2", *q_names)
        pairs = local.filter("dest < 0").select(*pair_names).unionByName(
            _visiting_pairs(placed, visits, arrays, q_names, pair_schema)
        )

    entry = F.struct("d2", "key", "fold", F.array(*x_names).alias("x"))
    lists = pairs.groupBy(*q_names).agg(F.array_sort(F.collect_list(entry)).alias("__all"))
    joined = _join_spots(base, lists, x_names, q_names, total)
    others = F.filter("__all", lambda e: e["key"] != F.col("key"))
    if fold is None:
        others = F.slice(others, 1, k)
    return joined.select(
        F.col("key").alias(key), *([F.col("fold").alias(fold)] if fold else []),
        *[F.col(x).alias(f) for x, f in zip(x_names, features)], others.alias("neighbors"),
    )


def _join_spots(base: DataFrame, lists: DataFrame, x_names, q_names, total: int) -> DataFrame:
    """Every point with the list of its spot.

    Spots with more than a thousandth of all points -- a thousand at most, hence safe to broadcast --
    are joined apart, so no task receives all copies of one spot.
    """
    def on(left, right):
        return [left[x] == right[q] for x, q in zip(x_names, q_names)]

    if total <= _HOT_SPOT_ROWS:
        return base.join(lists, on(base, lists))
    counts = base.groupBy(*[F.col(x).alias(q) for x, q in zip(x_names, q_names)]).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.filter(F.col("__n") > max(_HOT_SPOT_ROWS, total // 1000)).select(*q_names).collect()
    if not hot:
        return base.join(lists, on(base, lists))
    spark = base.sparkSession
    hot_spots = F.broadcast(spark.createDataFrame(hot, T.StructType([T.StructField(q, T.DoubleType()) for q in q_names])))
    stored = stage(lists, "knn-lists")
    hot_lists = F.broadcast(stored.join(hot_spots, q_names, "left_semi"))
    apart = base.join(hot_lists, on(base, hot_lists))
    cold = base.join(hot_spots, on(base, hot_spots), "left_anti")
    return apart.unionByName(cold.join(stored, on(cold, stored)))


def _visiting_pairs(placed, visits, arrays, q_names, schema):
    """Candidates that points find in foreign cells.

    A cell's visitors are cut into chunks of bounded size, and the cell's points are sent to each
    chunk, so a cell that many points visit is worked on by many tasks.
    """
    chunks = visits.groupBy("dest").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("dest").alias("cell"), F.ceil(F.col("n") / _VISITORS).cast("int").alias("chunks"))
    visitors = visits.join(chunks.withColumnRenamed("cell", "dest"), "dest").withColumn(
        "chunk", F.pmod(F.xxhash64(*q_names), F.col("chunks")).cast("int")
    ).drop("chunks")
    hosts = placed.join(chunks, "cell").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def search(host: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
        if host.empty or visiting.empty:
            return pd.DataFrame(columns=schema.names)
        xs, keys, folds = arrays(host)
        limit = visiting["limit2"].to_numpy()
        return _pairs(visiting[q_names].to_numpy(float), xs, keys, folds, limit, 0)[0][schema.names]

    return hosts.groupBy("cell", "chunk").cogroup(
        visitors.groupBy("dest", "chunk")
    ).applyInPandas(search, schema)


def outside_fold(neighbors: F.Column, fold, k: int) -> F.Column:
    """The k nearest neighbours that are not in ``fold``."""
    return F.slice(F.filter(neighbors, lambda e: e["fold"] != fold), 1, k)
