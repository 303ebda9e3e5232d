"""What the operators share: the shared folder, written tables, batches cut by size, packed arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop, new_path, saved  # noqa: F401

#: Rows of an Arrow batch. Small, so that a batch of very long texts still fits a Python worker.
BATCH_ROWS = 1000
#: Bytes of text that a vectorised step takes at once.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(taken: list[str], *names: str) -> list[str]:
    """Column names that no column of taken has, in any case of letters."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


#: At most so many keys can hold this share of all rows each; these are joined by broadcast.
HOT_KEYS = 1000


def with_labels(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """rows joined with labels on key. labels has one row for each key, and copies, the rows with it: keys that hold a
    large share of rows, HOT_KEYS at most, are joined by broadcast, so that none of them passes whole through one task."""
    hot = max(1000, -(-rows.count() // HOT_KEYS))
    big = F.broadcast(labels.where(F.col("copies") >= hot))
    rest = rows.join(F.broadcast(labels.where(F.col("copies") >= hot).select(key)), key, "left_anti")
    return rows.join(big, key).unionByName(rest.join(labels.where(F.col("copies") < hot), key))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What an operator keeps in a Python worker from task to task. Workers outlive a stage, so one operator's goes when another one begins.
_kept: dict = {}


def kept(key, make: Callable):
    """The object of this key, made if this worker has none."""
    release(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def release(but=None) -> None:
    for key in [k for k in _kept if k != but]:
        del _kept[key]


class Task:
    """f over a task's batches; what other operators keep goes first. f.key: what f itself keeps."""

    def __init__(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.f = f

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(getattr(self.f, "key", None))
        yield from self.f(batches)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with small batches. f: a function of a batch iterator, or an object with __call__ of one."""
    small_batches(df.sparkSession)
    return df.mapInArrow(Task(f), schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most limit bytes of text, a longer text alone."""
    if not batch.num_rows:
        return
    _, ends = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the offsets of its texts in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def ids_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(column)


def known_id(column: str = "doc_id"):
    """The id as text, for crc32; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, k: int):
    """crc32 of the id as text, modulo k."""
    return F.crc32(known_id(column).cast("binary")) % k


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string: their lengths in bytes, then their bytes. unpack needs the types again."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, types, strict=True):
        kind = np.dtype(kind)
        out.append(np.frombuffer(blob, kind, int(size) // kind.itemsize, at))
        at += int(size)
    return out


def rows(schema: pa.Schema, **columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=pa.schema([schema.field(n) for n in columns]))


def plain(f: Callable[[pa.Table], pa.Table]):
    """f as a function without annotations, as applyInArrow wants it."""

    def call(table):
        release()
        return f(table)

    return call


def both(f: Callable[[pa.Table, pa.Table], pa.Table]):
    """f of two tables, likewise."""

    def call(left, right):
        release()
        return f(left, right)

    return call


def packed_planes(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpacked_planes(blob: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def blobs(*parts: bytes) -> bytes:
    return pack(*(np.frombuffer(p, np.uint8) for p in parts))


def unblobs(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return [a.tobytes() for a in unpack(blob, *["u1"] * n)]


def least_type(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def numbers(a: np.ndarray) -> bytes:
    """Whole numbers from 0, as planes, with their width before them."""
    a = least_type(a)
    return bytes([a.itemsize]) + packed_planes(a)


def from_numbers(blob: bytes) -> np.ndarray:
    return unpacked_planes(blob[1:], f"u{blob[0]}").astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of a 64-bit hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
