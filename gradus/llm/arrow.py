"""Run Arrow batch functions over a few columns of a frame."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# the functions travel to the workers with their code, so no worker has to find this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def over_batches(df: DataFrame, columns: list[str], run: Callable[[Iterator], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over ``columns`` only; ``run`` yields dicts of column values, typed by ``schema``.

    Arrow's allocator would keep what batches have left; it is told after each to give that back, since a worker
    process stays with its executor while stages of other kinds run.
    """
    fields = StructType.fromDDL(schema)

    def released(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        for block in run(released(source)):
            arrays = [block[f.name] if isinstance(block[f.name], (pa.Array, pa.ChunkedArray))
                      else pa.array(block[f.name], f.type) for f in target]
            arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target, strict=True)]
            yield from pa.table(arrays, schema=target).to_batches()
        pa.default_memory_pool().release_unused()

    return df.select(*columns).mapInArrow(batches, schema)


def in_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about ``limit`` bytes (one longer text stays whole)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last
