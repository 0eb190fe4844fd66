"""Token ids as flat binary files with 64-bit document offsets.

Documents are dealt into ranges of doc_id in one shuffle; each range becomes three flat little-endian files in the shared folder:
`.ids` (unsigned 16-bit if the vocabulary allows, else 32-bit), `.off` (64-bit, documents + 1 of them) and `.doc` (64-bit doc_id).
The place of a range in the corpus comes from prefix sums over the ranges' totals, a table with one short row for each range. Readers map the
files into memory where the folder is a local or mounted one, and read them through the file system's own client elsewhere.

A task writes under a name of its own attempt, and only the manifest row of the attempt that succeeded refers to it: lost executors and
repeated attempts leave at most unreferenced files.

Defined results: a null text has only the end id; of rows with one doc_id the order is that of the crc32 of the text; a null doc_id comes
first; very long texts are written as they are; an empty table gives no files and an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import settle, shared_dir
from tidewell.llm.order import Buckets
from tidewell.llm.tokens import Encoder, default_path, slices, small

#: The id that ends each document.
END = 1
#: Documents of a range (one set of files), on average.
ROWS = 4000
#: The range of rows without doc_id, for which the file holds zeros.
NONE = -1


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _load(uri: str, dtype: str) -> np.ndarray:
    files, path = _open(uri)
    if files.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


class _Range:
    """Files of one range while they are written."""

    def __init__(self, folder: str, bucket: int, kind: str):
        self.bucket, self.kind, self.n = bucket, kind, 0
        context = TaskContext.get()
        self.stem = f"{folder}/range-{bucket:012d}-{context.taskAttemptId() if context else 0}"
        files, path = _open(self.stem)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.ids, self.off, self.doc = (files.open_output_stream(f"{path}.{x}") for x in ("ids", "off", "doc"))
        self.docs = 0
        self.off.write(np.zeros(1, "<i8").tobytes())

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.write(ids.astype(self.kind).tobytes())
        self.n += len(ids)
        self.docs += 1
        self.off.write(np.array([self.n], "<i8").tobytes())
        self.doc.write(np.array([doc_id or 0], "<i8").tobytes())

    def close(self) -> tuple[int, str, int, int]:
        for f in (self.ids, self.off, self.doc):
            f.close()
        return self.bucket, self.stem, self.docs, self.n


_MANIFEST = "bucket long, stem string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = END) -> DataFrame:
    """Write the files and return their manifest: bucket, stem, n_docs, n_ids and base (ids in all ranges before)."""
    folder, path = folder or shared_dir(docs.sparkSession, "tokens"), path or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        tail, now, done = np.array([end], "<u4").tobytes(), None, []
        for batch in small(batches):
            data, ids, buckets = batch.column("data").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist()
            for a, b in slices(data):
                for i, chunks in enumerate(encoder.batch(data[a:b]), a):
                    if now is None or now.bucket != buckets[i]:
                        if now:
                            done.append(now.close())
                        now = _Range(folder, buckets[i], kind)
                    now.add(ids[i], np.frombuffer(encoder.ids(chunks) + tail, "<u4"))
        if now:
            done.append(now.close())
        if done:
            cols = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["bucket", "stem", "n_docs", "n_ids"])

    order = Buckets(docs.select("doc_id"), ROWS)
    dealt = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"), order.bucket.alias("bucket")).repartition(order.tasks, "bucket")
    manifest = settle(dealt.sortWithinPartitions("bucket", "doc_id", F.crc32("data")).mapInArrow(write, _MANIFEST), "manifest")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range, order.BUCKETS at most
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (its first id's place in the corpus), n_tokens, ids_crc32 (of the ids as <u4)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, stem, n_docs, n_ids, base in zip(*(batch.column(c).to_pylist() for c in ("bucket", "stem", "n_docs", "n_ids", "base")), strict=True):
                off, doc, size = _load(f"{stem}.off", "<i8"), _load(f"{stem}.doc", "<i8"), 0
                raw = _load(f"{stem}.ids", "u1")
                size = len(raw) // n_ids  # bytes of an id
                ids = raw.view("<u2" if size == 2 else "<u4")
                for a in range(0, n_docs, 8192):
                    b = min(n_docs, a + 8192)
                    crc = [zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[a:b], mask=np.full(b - a, bucket == NONE)), pa.array(base + off[a:b]), pa.array(np.diff(off[a : b + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.repartition(max(1, math.ceil(manifest.count() / 4)), "bucket").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    """Write the corpus and read it back."""
    return read_token_files(write_token_files(docs))
