"""Exact dedup: a tree-merge of sorted digest runs.

Every input partition sorts the digests of its texts into a run and keeps one entry for
equal ones: the row that stays so far, and the count. The slots (a power of two) then exchange runs in
binomial rounds. In round k a slot parts its run in two, keeps the half whose digests have bit k of its own number
and sends the other half to the slot whose number differs in bit k. It merges the sorted runs that
it holds then, block by block, and again keeps one entry for equal digests. After the last round all
bits are the digest's: equal digests have met, though nothing passed whole through one
task, and a text that a third of all rows hold has crossed the net as one entry for each
slot and round.

Runs travel as blocks of at most ``BLOCK`` packed entries. Spark orders a slot's blocks by their first entries, so
those below the next block's first one are final: a task holds one block of each run that it merges.

An entry is verified at every level: SHA-256, length in bytes and a second hash must all be
equal before two entries merge.

Defined results. Null text counts as empty, so null and empty texts are equal. The row with
the largest doc_id stays; null ids are the smallest; of repeated rows with one doc_id just
one stays, the one that the scan counted last. An empty table gives an empty result. Other
columns are not read, and keep their values whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, map_batches, pack, saved, unpack

KEY = ["digest", "n_bytes", "check"]
#: Bytes of the SHA-256, the length and the second hash.
KEY_BYTES = 44
BLOCKS = "slot int, first binary, payload binary"
KEPT = "digest binary, n_bytes int, check bigint, keep_id bigint, keep_row bigint, group_size bigint"
#: Entries of a block.
BLOCK = 1 << 15
#: At most so many groups can hold this share of all rows each: these are joined by broadcast.
HOT_GROUPS = 1000


class Run:
    """Entries in the order of their keys: key (bytes), known (whether there is an id), id, row, copies."""

    def __init__(self, key: np.ndarray, *columns: np.ndarray):
        self.key, self.columns = key, columns

    def __len__(self) -> int:
        return len(self.key)

    def take(self, which) -> Run:
        return Run(self.key[which], *(c[which] for c in self.columns))

    def packed(self) -> bytes:
        return pack(self.key.view(np.uint8), *self.columns)

    def octets(self) -> np.ndarray:
        return np.ascontiguousarray(self.key).view(np.uint8).reshape(-1, KEY_BYTES)


def unpacked(payload: bytes) -> Run:
    key, *columns = unpack(payload, "u1", "i1", "i8", "i8", "i8")
    return Run(key.view(f"S{KEY_BYTES}"), *columns)


def merged(a: Run, b: Run) -> Run:
    """Two sorted runs as one. One entry for equal keys: the row with the largest id, then row number, and all copies."""
    n = len(a) + len(b)
    to_b = np.searchsorted(a.key, b.key, side="right") + np.arange(len(b))
    from_a = np.ones(n, bool)
    from_a[to_b] = False

    def woven(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(n, x.dtype)
        out[from_a], out[to_b] = x, y
        return out

    return distinct(Run(woven(a.key, b.key), *map(woven, a.columns, b.columns)))


def distinct(run: Run) -> Run:
    if len(run) < 2:
        return run
    new = np.concatenate([[True], run.key[1:] != run.key[:-1]])
    if new.all():
        return run
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    known, ids, row, copies = run.columns
    last = np.lexsort((row, ids, known, group))
    best = last[np.append(np.flatnonzero(np.diff(group)), len(run) - 1)]
    return Run(run.key[first], known[best], ids[best], row[best], np.add.reduceat(copies, first))


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """Sorted digests of a partition, as runs with each key once but at their edges."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        key = np.empty((n, KEY_BYTES), np.uint8)
        digest = b.column("digest").cast(pa.large_binary())
        at = np.frombuffer(digest.buffers()[1], np.int64, 1, digest.offset * 8)[0]
        key[:, :32] = np.frombuffer(digest.buffers()[2], np.uint8, 32 * n, at).reshape(n, 32)
        key[:, 32:36] = b.column("n_bytes").to_numpy().astype(">i4").view(np.uint8).reshape(n, 4)
        key[:, 36:] = b.column("check").to_numpy().astype(">i8").view(np.uint8).reshape(n, 8)
        known = b.column("id").is_valid().to_numpy(zero_copy_only=False).astype(np.int8)
        run = Run(key.view(f"S{KEY_BYTES}").ravel(), known, b.column("id").fill_null(0).to_numpy(zero_copy_only=False), b.column("row").to_numpy(), np.ones(n, np.int64))
        # Spark sorts lengths and hashes as signed numbers; within one digest that is another order than the bytes'.
        yield distinct(run if (run.key[1:] >= run.key[:-1]).all() else run.take(np.argsort(run.key, kind="stable")))


class Merge:
    """One round: merges the blocks that a slot has got, and parts what comes out by the next bit; after the last round it yields the entries.

    bit None: the entries themselves come in, sorted; a partition's slot is its number."""

    def __init__(self, bit: int | None, slots: int, last: bool):
        self.bit, self.slots, self.last = bit, slots, last

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if self.bit is None:
            blocks = ((TaskContext.get().partitionId() % self.slots, r) for r in runs_of(batches))
        else:
            blocks = ((s, unpacked(p)) for b in batches for s, p in zip(b.column("slot").to_pylist(), b.column("payload").to_pylist(), strict=True))
        slot, held, ready, size = None, None, [], 0
        for s, run in blocks:
            if s != slot and held is not None:
                yield from self.out(slot, [*ready, held])
                held, ready, size = None, [], 0
            slot = s
            if held is not None:
                done = int(np.searchsorted(held.key, run.key[0]))
                ready.append(held.take(slice(0, done)))
                size += done
                run = merged(held.take(slice(done, None)), run)
            held = run
            if size >= BLOCK:
                yield from self.out(slot, ready)
                ready, size = [], 0
        if held is not None:
            yield from self.out(slot, [*ready, held])

    def out(self, slot: int, runs: list[Run]) -> Iterator[pa.RecordBatch]:
        run = Run(np.concatenate([r.key for r in runs]), *(np.concatenate(c) for c in zip(*(r.columns for r in runs), strict=True)))
        if self.last:
            octets = run.octets()
            known, ids, row, copies = run.columns
            digest = pa.array([bytes(x) for x in octets[:, :32]], pa.binary())
            numbers = octets[:, 32:36].copy().view(">i4").ravel().astype(np.int32), octets[:, 36:].copy().view(">i8").ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([digest, *map(pa.array, numbers), pa.array(ids, mask=known == 0), pa.array(row), pa.array(copies)], ["digest", "n_bytes", "check", "keep_id", "keep_row", "group_size"])
            return
        bit = 0 if self.bit is None else self.bit + 1
        one = (run.octets()[:, bit // 8] >> (bit % 8) & 1).astype(bool)
        for half in (0, 1):
            part = run.take(one == bool(half))
            to = slot & ~(1 << bit) | half << bit
            for at in range(0, len(part), BLOCK):
                block = part.take(slice(at, at + BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([block.octets()[0].tobytes()], pa.binary()), pa.array([block.packed()], pa.binary())], ["slot", "first", "payload"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, row number, and what stands for its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check"),
    )


def merged_runs(entries: DataFrame, slots: int | None = None) -> DataFrame:
    """entries: the output of digests(). One row for each different text: KEY, keep_id, keep_row, group_size."""
    slots = slots or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, (slots - 1).bit_length())
    slots = 1 << rounds
    runs = map_batches(entries.sortWithinPartitions(*KEY), Merge(None, slots, False), BLOCKS)
    for k in range(rounds):
        mine = runs.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "first")
        runs = map_batches(mine, Merge(k, slots, k == rounds - 1), KEPT if k == rounds - 1 else BLOCKS)
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """One row for each row of docs: id, row, digest, keep_id, group_size, kept, same_id (rows of the group with the id that stays)."""
    entries = saved(digests(docs, id_col, text_col), "digests")
    runs = saved(merged_runs(entries, slots), "runs")
    total = entries.count()
    hot_size = max(1000, -(-total // HOT_GROUPS))
    hot = runs.where(F.col("group_size") >= hot_size)  # at most HOT_GROUPS rows, as the sizes sum to total
    in_hot = entries.join(F.broadcast(hot), KEY)
    rest = entries.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(runs.where(F.col("group_size") < hot_size), KEY)
    out = in_hot.unionByName(rest)
    return out.withColumn("kept", F.col("row") == F.col("keep_row"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    names = docs.columns
    own, keep_id, keep_digest, place = free_names(names, "own_digest", "keep_id", "keep_digest", "place")
    found = exact_dedup(docs, id_col, text_col)
    keep = found.where("kept").select(F.col("id").alias(keep_id), F.col("digest").alias(keep_digest))
    text = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    on = F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(own) == F.col(keep_digest))
    kept = docs.withColumn(own, text).join(keep, on, "left_semi")
    # Repeated rows with one id all match; they are numbered within (id, digest), which holds nothing else.
    repeated = found.where("not kept").where(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias(keep_id), F.col("digest").alias(keep_digest)).distinct()
    once = kept.join(repeated, on, "left_anti")
    many = kept.join(repeated, on, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(id_col, own).orderBy(F.lit(0)))).where(F.col(place) == 1)
    return once.select(*names).unionByName(many.select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    found = exact_dedup(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
