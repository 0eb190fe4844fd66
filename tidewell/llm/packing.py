"""Packing documents into sequences of a fixed length by sums of squares.

Each document's ids and the end id are cut into pieces of CAPACITY where they are longer; full pieces are sequences of their own. The other
pieces are dealt by hash into groups of about GROUP; within a group, pieces are placed from the longest to the shortest, each into the open
bin (or a new one) that leaves the sum over all residual gaps of (number of open bins with that gap) squared smallest, ties going to the
smallest remaining gap. Only lengths move between tasks, never ids; a group's size is fixed, so groups grow in number with the corpus.

Defined results: a null text is the end id alone; repeated rows and rows without id are pieces of their own; of equal lengths the row that
was read first is placed first; a very long text is many full pieces and one shorter; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bytes_of, settle
from tidewell.llm.tokens import Encoder, default_path, release, slices, small

CAPACITY, GROUP, END = 4096, 4096, 1


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (all below capacity), by the sum-of-squares rule in descending order of length."""
    open_with = np.zeros(capacity + 1, dtype=np.int64)  # open bins by residual gap; full bins are not open
    bins: dict[int, list[int]] = {}
    bin_of, offset, n = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        gaps = np.flatnonzero(open_with[size:]) + size
        change = np.where(gaps == size, 1 - 2 * open_with[gaps], 2 * (open_with[gaps - size] - open_with[gaps]) + 2)
        k = int(change.argmin()) if len(gaps) else -1
        if k >= 0 and change[k] <= 2 * open_with[capacity - size] + 1:
            gap = int(gaps[k])
            b = bins[gap].pop()
            open_with[gap] -= 1
        else:
            gap, b, n = capacity, n, n + 1
        bin_of[i], offset[i] = b, capacity - gap
        if gap > size:
            open_with[gap - size] += 1
            bins.setdefault(gap - size, []).append(b)
    return bin_of, offset


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row for each piece of each document."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoder, tail = Encoder.at(path), np.array([end], "<u4").tobytes()
        for batch in small(batches):
            data, doc_ids = batch.column("data").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(data):
                rows = []
                for doc_id, chunks in zip(doc_ids[a:b], encoder.batch(data[a:b]), strict=True):
                    ids = encoder.ids(chunks) + tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return bytes_of(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, path: str | None = None) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = settle(pieces(docs, capacity, path=path).withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    short = cut.filter(F.col("length") < capacity)
    groups = max(1, round(short.count() / group))

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece_id")  # the order in which a shuffle delivers rows doesn't matter
        bin_of, offset = place(rows["length"].to_numpy(), capacity)
        rows = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return rows.append_column("sequence_id", pa.array(bin_of * groups + key[0].as_py())).append_column("offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    filled = short.withColumn("of", F.pmod(F.xxhash64("piece_id"), F.lit(groups))).groupBy("of").applyInArrow(fill, schema)
    whole = cut.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("piece_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return filled.unionByName(whole)
