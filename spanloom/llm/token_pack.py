"""Token-id output packed by best-fit decreasing.

Texts become ids followed by an end id. A document longer than a sequence is split without
loss: its full-length pieces are sequences of their own and its rest is packed. Rests are
packed in pools of bounded size by best-fit decreasing; the fullest open sequence that still
has room is found in a segment tree over free capacities. Each task packs what it reads, so
nothing is shuffled, and the only padding is in the last sequences of a pool.

A row is one sequence: its ids padded to full length (a row of the id matrix), the cumulative
lengths of its segments, the places where positions restart, and the document and start of
each segment. The id matrices are written as raw files, with a table of their rows, and can be read
back by ranges. Defined results: a null text is empty; an empty text is just the end id;
repeated rows and ids are packed each for itself; a null id is carried as null; other columns are
left out; an empty table gives no sequences and no files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, materialise, scratch_path, slices
from .tokens import Encoder, default_vocabulary

LENGTH = 1024
END_ID = 0
#: Rests packed together; more of them make a better fit, and some 2 KB each are held.
POOL = 8192
SCHEMA = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary"


class CapacityTree:
    """Open sequences by free capacity; a segment tree finds the least capacity >= n in use."""

    def __init__(self, most: int):
        self.size = 1
        while self.size < most + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, capacity: int, which: int) -> None:
        if capacity > 0:
            self.open[capacity].append(which)
            self._add(capacity, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the best fit for n, removed from the tree."""
        i, count = n + self.size, self.count
        if n >= len(self.open):
            return None
        if not count[i]:
            # Up to the first right sibling in use, then down to its leftmost leaf.
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], most: int = LENGTH) -> list[list[int]]:
    """Indices of lengths in sequences of at most `most`, longest first, ties in given order."""
    tree, out = CapacityTree(most), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        got = tree.take(n)
        if got is None:
            got = most, len(out)
            out.append([])
        out[got[1]].append(k)
        tree.put(got[0] - n, got[1])
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """Packed sequences of all documents."""
    path, schema = vocabulary or default_vocabulary(), arrow_schema(SCHEMA)

    def run(batches):
        coder, task, made = Encoder(path), None, 0
        item = coder.dtype.itemsize
        end = np.array([end_id], coder.dtype).tobytes()

        def rows(sequences: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            got = []
            for parts in sequences:
                cu = [0]
                for p in parts:
                    cu.append(cu[-1] + len(p[2]) // item)
                ids = b"".join([p[2] for p in parts])
                got.append(((task << 33) + made, cu[-1], [p[0] for p in parts], [p[1] for p in parts], cu, cu[:-1], ids.ljust(length * item, b"\0")))
                made += 1
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

        rests: list[tuple] = []
        for b in slices(batches, 256):
            if task is None:
                task = b.column(2)[0].as_py()
            full = []
            for i, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                whole = len(ids) // (length * item) * length * item
                full += [[(i, at // item, ids[at : at + length * item])] for at in range(0, whole, length * item)]
                if whole < len(ids):
                    rests.append((i, whole // item, ids[whole:]))
            yield from rows(full)
            if len(rests) >= pool:
                yield from rows([[rests[k] for k in s] for s in best_fit_decreasing([len(r[2]) // item for r in rests], length)])
                rests = []
        yield from rows([[rests[k] for k in s] for s in best_fit_decreasing([len(r[2]) // item for r in rests], length)])

    rows_in = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.spark_partition_id().alias("__task"))
    return map_arrow(rows_in, run, SCHEMA)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions that restart at each segment."""
    cu = np.asarray(cu_seqlens)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Writes the id matrices as raw little-endian files below folder, one for each task that has any,
    and gives the table of what is in them: the columns of packed without the ids, file and row.

    It names only files of tasks that succeeded, so what a lost task has left is never read.
    """
    ddl = SCHEMA.rpartition(",")[0] + ", file string, row long"
    schema = arrow_schema(ddl)

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        name, n, out = f"ids-{uuid.uuid4().hex}.bin", 0, None
        try:
            for b in batches:
                out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                for ids in b.column(6):
                    out.write(ids.as_buffer())
                rows = pa.array(np.arange(n, n + b.num_rows))
                n += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array([name] * b.num_rows, pa.string()), rows], schema=schema)
        finally:
            if out is not None:
                out.close()

    return materialise(map_arrow(packed, run, ddl), "matrices")


def read_matrices(index: DataFrame, folder: str, length: int = LENGTH, item: int = 2) -> DataFrame:
    """The packed sequences again: rows of one file that follow each other are read at once. item: bytes of an id."""
    schema, width = arrow_schema(SCHEMA), length * item

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for b in slices(batches, 1024):
            files, rows, ids, at = b.column(6).to_pylist(), b.column(7).to_pylist(), [], 0
            while at < len(rows):
                to = at + 1
                while to < len(rows) and files[to] == files[at] and rows[to] == rows[to - 1] + 1:
                    to += 1
                if files[at] != name:
                    name, source = files[at], store.open_input_file(f"{path}/{files[at]}")
                raw = source.read_at((to - at) * width, rows[at] * width)
                ids += [raw[k : k + width] for k in range(0, len(raw), width)]
                at = to
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(ids, pa.binary())], schema=schema)

    return map_arrow(index, run, SCHEMA)


def op8_token_ids(spark, sf_dir: str) -> DataFrame:
    """Packed sequences, written as matrices of ids and read back."""
    folder = scratch_path(spark, "ids")
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_matrices(write_matrices(packed, folder), folder)


QUERIES = {"op8_token_ids": op8_token_ids}
