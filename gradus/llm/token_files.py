"""Token ids in Arrow files of equal-length sequences, readable in place.

Every task writes the documents of one range of ids, in ascending order, as a run of token ids cut into sequences of
the same length. A file holds record batches with two fixed-size-list columns, ``input_ids`` and ``mask`` (a bit each; 0 on
the padding of the file's last sequence). All batches but the last hold the same number of sequences, which the
file's metadata tells, so sequence ``i`` is found by division, one batch is read for it, and in a mapped file its ids and
mask are views. Beside it lies a small index of the documents. Only files named in the manifest, which is written by
Spark's own committer, count: what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import new_path, stage
from .arrow import in_slices, over_batches
from .pretokens import library_ids

_ROWS = 256  # sequences in a record batch


def open_folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Cuts appended ids into sequences and writes batches of ``_ROWS`` of them; holds one batch and a document at most."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        if length % 8:
            raise ValueError("the length of sequences must be a multiple of 8, so that masks begin at whole bytes")
        self.length, self.kind = length, kind
        self.schema = pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))],
                                metadata={"sequences_per_batch": str(_ROWS)})
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.written = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.size += len(ids)
        if self.size >= self.length * _ROWS:
            block = self.length * _ROWS
            self._flush(self.size // block * block)

    def _flush(self, count: int, padding: int = 0) -> None:
        ids = np.concatenate(self.held)
        rest, ids = ids[count:], ids[:count]
        mask = np.ones(count + padding, bool)
        mask[count:] = False
        ids = np.concatenate((ids, np.zeros(padding, ids.dtype)))
        whole = pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
                                 pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema)
        for first in range(0, whole.num_rows, _ROWS):
            self.out.write_batch(whole.slice(first, _ROWS))
        self.held, self.size, self.written = [rest], len(rest), self.written + count

    def close(self) -> None:
        if self.size:
            self._flush(self.size, -self.size % self.length)
        self.out.close()


class SequenceFile:
    """Random access to the sequences of a file; arrays are views of the mapped file where the store allows mapping."""

    def __init__(self, folder, path: str):
        from pyarrow import fs

        local = isinstance(folder, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else folder.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.rows = int(self.reader.schema.metadata[b"sequences_per_batch"])
        self._batch = (-1, None)

    def _at(self, k: int) -> pa.RecordBatch:
        if self._batch[0] != k:
            self._batch = k, self.reader.get_batch(k)
        return self._batch[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence ``i`` and its mask, eight tokens a byte, lowest bit first; one batch is read.

        ``np.unpackbits(mask, bitorder="little")`` gives a number for each token.
        """
        batch, at = self._at(i // self.rows), i % self.rows * self.length
        ids, bits = batch.column(0).flatten(), batch.column(1).flatten()
        first = (bits.offset + at) // 8
        mask = np.frombuffer(bits.buffers()[1], np.uint8)[first:first + self.length // 8]
        return ids[at:at + self.length].to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file's run of tokens; only the batches that hold them are read."""
        block, parts = self.rows * self.length, []
        while start < stop:
            k, at = divmod(start, block)
            flat = self._at(k).column(0).flatten()
            parts.append(flat[at:min(at + stop - start, len(flat))].to_numpy(zero_copy_only=True))
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def close(self) -> None:
        self.source.close()


def write_tokens(df: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode all rows, write the files below the shared folder and return the manifest: part, file, tokens, documents.

    Rows are in ascending order of ``id_col`` (nulls first; equal ids by a hash of the text, so that rows that share an
    id spread over ranges too), which takes one range shuffle of the two columns. A null text counts as empty and is the end id alone. An empty table writes no file. Other columns are
    not read.
    """
    target = new_path(df.sparkSession, "tokens")
    order = [F.col(id_col), F.xxhash64(text_col)]
    ordered = df.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order, text_col)

    def run(source):
        from pyspark import TaskContext

        memo, part = library_ids(tokenizer), TaskContext.get().partitionId()
        kind = pa.uint16() if memo.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
        folder, root = open_folder(target)
        out = index = None
        written = documents = 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        for batch in source:
            for piece in in_slices(batch, text_col):
                if out is None:
                    folder.create_dir(root, recursive=True)
                    sinks = [folder.open_output_stream(f"{root}/{name}.{k}") for k in ("arrow", "index")]
                    out = SequenceWriter(sinks[0], length, kind)
                    fields = pa.schema([piece.schema.field(id_col), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    index = pa.ipc.new_file(sinks[1], fields)
                sizes = []
                for ids in memo.encode(piece.column(text_col).to_pylist()):
                    out.append(np.append(ids, np.uint32(end_id)))
                    sizes.append(len(ids) + 1)
                ends = written + np.cumsum(sizes)
                index.write_batch(pa.record_batch([piece.column(id_col), pa.array(ends - sizes), pa.array(sizes, pa.int64())], schema=fields))
                written, documents = int(ends[-1]), documents + len(sizes)
        if out is not None:
            out.close(), index.close()
            for sink in sinks:
                sink.close()
            yield {"part": [part], "file": [f"{target}/{name}.arrow"], "tokens": [written], "documents": [documents]}

    return stage(over_batches(ordered, [id_col, text_col], run, "part long, file string, tokens long, documents long"), "manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running total over files is a window over the manifest, a row for each file. Each task opens whole files.
    """
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = max(1, manifest.count())
    dealt = based.select("part", "file", "base").repartition(files, "part")

    def run(source):
        for batch in source:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                folder, path = open_folder(file)
                sequences = SequenceFile(folder, path)
                with folder.open_input_file(path[:-len("arrow")] + "index") as side:
                    index = pa.ipc.open_file(side)
                    for k in range(index.num_record_batches):
                        rows = index.get_batch(k)
                        start, size = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
                        sums = [zlib.crc32(sequences.tokens(a, a + n).astype("<u4")) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
                        yield {id_col: rows.column(id_col), "start": start + base, "n_tokens": size, "ids_crc32": sums}
                sequences.close()

    return over_batches(dealt, ["file", "base"], run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and read every document back from them."""
    manifest = write_tokens(df, tokenizer, length, id_col=id_col, text_col=text_col)
    return read_tokens(df.sparkSession, manifest, df.schema[id_col].dataType.simpleString(), id_col)
