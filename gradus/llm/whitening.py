"""Whiten embeddings with distributed block matrices: centred blocks, transpose times blocks, eigenvectors, blocks times whitening.

Entries become whole numbers, so equal vectors are equal exactly and sums are exact. The fit runs over each distinct vector
once; the rows are joined back to the whitened distinct vectors at the end.

Two layouts of the same blocks keep the products distributed. Stacked in one block column, the blocks times their transpose
give the scatter matrix; the middle dimension is cut so that partial products are made in parallel. Laid out as a square
grid, the blocks are multiplied by a block diagonal of the whitening matrix, so that the result is a grid as well and is
dealt to as many partitions as wanted (a single block column would go to the square root of them).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage, write_staged
from .arrow import over_batches

# the functions travel to the workers with their code, so no worker has to find this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
#: Rows of a block; with more than ``MOST_BLOCKS`` blocks they grow, as block numbers reach the driver in a product.
BLOCK_ROWS = 1024
MOST_BLOCKS = 1 << 14
#: Blocks that one task of a product holds.
TASK_BLOCKS = 16
_MATRIX = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"
_LONG = 2.0**63


def whole_numbers(vector: Column) -> Column:
    """floor(``SCALE`` * entry) of every entry as long; null where an entry is null, not finite, or would not fit."""
    scaled = F.transform(vector, lambda c: F.lit(float(SCALE)) * c.cast("double"))
    fits = F.forall(scaled, lambda s: F.coalesce((s >= -_LONG) & (s < _LONG), F.lit(False)))
    return F.when(fits, F.transform(scaled, lambda s: F.floor(s).cast("long")))


def _names(x: Column) -> list[Column]:
    """Two 64-bit hashes that name a vector."""
    return [F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")]


def centred_blocks(distinct: DataFrame, sums: list[int], n: int, rows_per_block: int) -> tuple[str, DataFrame, int]:
    """Path of a stored table with a row for each block, the first block number of each task, and how many there are.

    A row holds the task and the block's place there, the matrix, and names and deviations of its vectors in their order.

    A task fills its blocks one after the other from what it reads; its last one is filled up with rows of zeros, which
    change no product, and bear no name. Blocks are numbered through by the counts of blocks of each task.
    """
    d = len(sums)

    def run(source: Iterator) -> Iterator[dict]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        total, held, waiting = np.array(sums, object), [], 0

        def deviations(x: np.ndarray) -> list[int | None]:
            most = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + float(max(map(abs, sums), default=0))
            if d * most * most < _LONG:
                gap = x * n - total.astype(np.int64)
                return (gap * gap).sum(axis=1).tolist()
            exact = ((x.astype(object) * n - total) ** 2).sum(axis=1)
            return [v if v < 1 << 63 else None for v in exact]

        def block(parts: list) -> dict:
            x = np.concatenate([p[0] for p in parts])
            values = np.zeros((rows_per_block, d))
            values[:len(x)] = x - np.array([s / n for s in sums])
            matrix = {"type": 1, "numRows": rows_per_block, "numCols": d, "colPtrs": None, "rowIndices": None,
                      "values": values.ravel(order="F"), "isTransposed": False}
            return {"task": [task], "at": [number], "matrix": [matrix], "h1": [np.concatenate([p[1] for p in parts])],
                    "h2": [np.concatenate([p[2] for p in parts])], "deviation": [deviations(x)]}

        for batch in source:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            first = 0
            while first < len(x):
                last = min(len(x), first + rows_per_block - waiting)
                held.append((x[first:last], h1[first:last], h2[first:last]))
                waiting, first = waiting + last - first, last
                if waiting == rows_per_block:
                    yield block(held)
                    held, waiting, number = [], 0, number + 1
        if held:
            yield block(held)

    schema = f"task int, at int, matrix {_MATRIX}, h1 array<long>, h2 array<long>, deviation array<long>"
    path = write_staged(over_batches(distinct, ["x", "h1", "h2"], run, schema), "blocks")
    spark = distinct.sparkSession
    counts = spark.read.parquet(path).groupBy("task").agg(F.count("*").alias("n")).collect()  # a row for each task
    first, upto = [], 0
    for r in sorted(counts, key=lambda r: r["task"]):
        first.append((r["task"], upto))
        upto += r["n"]
    return path, spark.createDataFrame(first, "task int, first int"), upto


def _block_matrix(blocks: DataFrame, row: Column, col: Column, rows: int, cols: int) -> BlockMatrix:
    """A distributed matrix of stored blocks; they go from the file to the JVM's matrix without passing Python."""
    cells = blocks.select(F.struct(row.cast("long").alias("blockRowIndex"), col.cast("long").alias("blockColIndex")).alias("at"), "matrix")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", cells, rows, cols, 0, 0), rows, cols)


def _product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``a`` times ``b``, the middle dimension cut into ``splits`` (a choice the Python method does not offer)."""
    return BlockMatrix(a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits), a.rowsPerBlock, b.colsPerBlock)


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every row with a usable vector and each of the first components: whitened value and figures of the fit.

    Columns: id, component (from 1), n (distinct vectors), deviation, whitened, explained, identity_error. ``deviation``
    is the sum over dimensions of (n * x - S)^2, null where it exceeds a long. Of equal eigenvalues any order may come.

    Rows go whose vector is null or holds a null or non-finite entry, or one that floor(256 * entry) would not fit a long.
    Vectors of different lengths raise. A component without variance has null for ``whitened``, and is left out of
    ``identity_error``; with no variance at all ``explained`` and ``identity_error`` are null. Empty vectors and an empty
    table give no row. Repeated rows and ids are rows of their own; a null id stays null. Only id and vector are read.
    The driver holds the sums (d numbers), the scatter matrix (d * d) and a number for each block and task.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), whole_numbers(F.col(f"`{vector_col}`")).alias("x")).filter("x IS NOT NULL")
    rows = stage(rows.select("id", "x", *_names(F.col("x"))), "vectors")
    distinct = stage(rows.select("x", "h1", "h2").distinct(), "distinct")
    totals = distinct.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    totals = sorted(totals)  # a row for each dimension
    n = distinct.count()
    if any(r["n"] != n for r in totals):
        raise ValueError("vectors differ in length")
    sums, d = [r["s"] for r in totals], len(totals)
    id_type = df.schema[id_col].dataType.simpleString()
    if not d:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    height = max(BLOCK_ROWS, math.ceil(n / MOST_BLOCKS))
    path, starts, n_blocks = centred_blocks(distinct, sums, n, height)
    plain = spark.read.parquet(path).join(F.broadcast(starts), "task").withColumn("block", F.col("first") + F.col("at"))
    typed = spark.read.schema(T.StructType([T.StructField("task", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("matrix", MatrixUDT())]))
    blocks = typed.parquet(path).join(F.broadcast(starts), "task").withColumn("block", F.col("first") + F.col("at"))

    stacked = _block_matrix(blocks, F.col("block"), F.lit(0), height, d)
    splits = min(n_blocks, max(math.ceil(n_blocks / TASK_BLOCKS), spark.sparkContext.defaultParallelism))
    scatter = _product(stacked.transpose(), stacked, splits).toLocalMatrix().toArray()
    values, vectors = np.linalg.eigh(scatter / n)
    trace = float(np.trace(scatter) / n)
    kept = [k for k in range(d - 1, -1, -1)][:components]
    live = [values[k] > 1e-13 * max(trace, 0.0) for k in kept]
    turn = np.stack([vectors[:, k] / math.sqrt(values[k]) if up else np.zeros(d) for k, up in zip(kept, live)], axis=1)

    side = math.isqrt(n_blocks - 1) + 1
    grid = _block_matrix(blocks, F.floor(F.col("block") / side), F.col("block") % side, height, d)
    diagonal = spark.sparkContext.parallelize([((k, k), DenseMatrix(d, len(kept), turn.ravel(order="F"))) for k in range(side)], max(1, n_blocks // TASK_BLOCKS))
    turned = _product(grid, BlockMatrix(diagonal, d, len(kept)))
    turned = write_staged(callMLlibFunc("getMatrixBlocks", turned._java_matrix_wrapper._java_model), "turned")
    turned = spark.read.schema(f"_1 struct<_1:int,_2:int>, _2 {_MATRIX}").parquet(turned).select(
        (F.col("_1._1") * side + F.col("_1._2")).alias("block"), F.col("_2.values").alias("values"), F.col("_2.isTransposed").alias("by_row"))

    # a block's values stand column by column, so row i of component k is at i + k * height
    k_all, i = len(kept), F.col("i")
    value = [F.get("values", F.when(F.col("by_row"), i * k_all + k).otherwise(i + k * height)) for k in range(k_all)]
    white = stage(plain.join(turned, "block").select(
        "h1", "h2", "deviation", "values", "by_row", F.posexplode("h1").alias("i", "name")).select(
        F.col("name").alias("h1"), F.get("h2", i).alias("h2"), F.get("deviation", i).alias("deviation"), F.array(*value).alias("z")), "whitened")
    pairs = [(a, b) for a in range(k_all) for b in range(a, k_all) if live[a] and live[b]]
    found = white.agg(*(F.covar_pop(F.col("z")[a], F.col("z")[b]) for a, b in pairs)).first() if pairs else []
    error = max((abs(c - (a == b)) for c, (a, b) in zip(found, pairs)), default=None)
    explained = [float(values[k]) / trace if trace > 0 else None for k in kept]

    joined = rows.select("id", "h1", "h2").join(white, ["h1", "h2"])
    parts = F.array(*(F.struct(F.lit(k + 1).alias("component"), (F.col("z")[k] if live[k] else F.lit(None).cast("double")).alias("whitened"),
                               F.lit(explained[k]).cast("double").alias("explained")) for k in range(k_all)))
    return joined.select("id", "deviation", F.explode(parts).alias("p")).select(
        F.col("id").alias(id_col), "p.component", F.lit(n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained",
        F.lit(error).cast("double").alias("identity_error"))
