"""Token-ID output: bit-plane shuffled blocks of ids, a zstandard frame for each plane, a chunk index.

Documents are dealt out by ranges of doc_id, sorted within each range, encoded, and written
in that order. A chunk holds the ids of whole documents, at least ``chunk_ids`` of them but
in a range's last one. Its ids are cut into blocks of ``block`` ids (the last is padded with
0); each block is transposed into bit planes (plane p holds bit p of every id) or byte planes,
and the planes of one number, of all blocks, make one zstandard frame.

Layout of a chunk, little-endian: magic ``LSPLANE1``; uint32 block, n_docs, n_planes, plane
kind (1 or 8 bits); uint64 n_ids; uint64 length of each frame; the frames; at the end the
documents: a frame of n_docs validity bytes, int64 doc_ids and uint64 counts. Chunks are
rows of a Parquet table that Spark writes, and so commits or drops whole, with the index
columns shard, chunk, start (ids before the chunk in its shard), n_docs and n_ids beside
them: a reader can pick chunks by doc or position and opens no other.

Defined results. Null text counts as empty and yields the end id alone. Null doc_ids come
first. Rows with one doc_id are each written, in the order of their texts' hash. An empty
table writes no chunk, and reads back as no row. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, kept, map_batches, new_path, slices, text_buffer

MAGIC = b"LSPLANE1"
HEAD = struct.Struct("<8sIIIIQ")
#: Bytes of text that are gathered and encoded at once: their different words are looked up once.
SLICE = 12 << 20
CHUNK = "shard int, chunk int, start bigint, n_docs int, n_ids bigint, first_doc bigint, last_doc bigint, payload binary"
DOC = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
SPACE, LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
SPACE[[10, 32]] = True
LETTER[65:91] = LETTER[97:123] = True
STOP[[44, 46]] = True
#: The tokenizer's pattern, for printable ASCII in lower case.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class WordEncoder:
    """Encodes texts by their words, each different word once. Words end at spaces and line
    ends, which the tokenizer drops, and between a letter A-Z and a full stop or comma, where it
    always splits: neither its normaliser nor its merges reach across these. As it lower-cases,
    words of ASCII letters are looked up in lower case. Words of printable ASCII are cut by the tokenizer's pattern here, and each piece goes
    to its model alone; all others pass through the whole tokenizer. Holds at most ``most`` words, then starts anew.
    added: added tokens in a text stand for their own ids, as the library has it; texts that hold one are encoded whole."""

    def __init__(self, path: str, most: int = 2_000_000, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True
        self.library, self.tokens = None, []
        if added:
            self.library = Tokenizer.from_file(path)
            self.tokens = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Many words are encoded as one text, with a sign between them that has one id of its own.
        self.mark, self.mark_id = next((c, ids[0]) for c in "\u2122\u00a9\u00ae|~" if len(ids := self.tokenizer.encode(c, add_special_tokens=False).ids) == 1)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, list[int]] = {}
        self.words, self.fresh = pa.array([], pa.large_string()), []
        self.count = 0
        self.flat, self.starts, self.sizes, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of different words; no Python object is made for one that is known."""
        if self.count + len(words) > self.most:
            self.clear()
        found = pc.index_in(words, value_set=self.words)
        number = found.fill_null(-1).to_numpy().astype(np.int64)
        unknown = words.filter(pc.is_null(found))
        if len(unknown):
            first, self.fresh = self.count, []
            self.learn(unknown.to_pylist())
            fresh = pa.array(self.fresh, pa.large_string())
            number[number < 0] = first + pc.index_in(unknown, value_set=fresh).to_numpy()
            self.words = pa.concat_arrays([self.words, fresh])
        return number

    def learn(self, new: list[str]) -> None:
        simple, rest = [], []
        for w in new:
            (simple if w.isascii() and w.isprintable() else rest).append(w)
        if simple:
            ids = [self.by_pieces(w) for w in simple]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.keep(simple, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        left = self.by_ends([w for w in rest if w.isalpha()])
        rest = [w for w in rest if not w.isalpha()] + left
        plain = [w for w in rest if self.mark not in w]
        parts = [plain[at : at + 5000] for at in range(0, len(plain), 5000)] + [[w] for w in rest if self.mark in w]
        for part in parts:
            flat = np.array(self.tokenizer.encode_batch_fast([f" {self.mark} ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(flat == self.mark_id) if len(part) > 1 else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([[-1], marks, [len(flat)]])) - 1
            self.keep(part, np.delete(flat, marks), sizes)

    def by_pieces(self, word: str) -> list[int]:
        """The ids of a word of printable ASCII, in lower case."""
        if word.isalpha():
            return [t.id for t in self.model.tokenize(word)]
        out = []
        for p in PIECE.findall(word):
            if p.isalpha():
                out += [t.id for t in self.model.tokenize(p)]
                continue
            ids = self.pieces.get(p)  # signs and digits come again
            if ids is None:
                ids = self.pieces[p] = [t.id for t in self.model.tokenize(p)]
            out += ids
        return out

    def by_ends(self, words: list[str]) -> list[str]:
        """Takes up words of letters alone, each of which ends with one word end; those that do not count up are given back."""
        left = []
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            flat = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[flat])
            if len(ends) == len(part) and ends[-1] == len(flat) - 1:
                self.keep(part, flat, np.diff(ends, prepend=-1))
            else:
                left += part
        return left

    def keep(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Takes up new words with their ids, one after another in flat."""
        first, n = self.count, len(words)
        self.flat = grown(self.flat, self.used + len(flat))
        self.starts, self.sizes = grown(self.starts, first + n), grown(self.sizes, first + n)
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.used += len(flat)
        self.count += n
        self.fresh += words

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and how many each has."""
        whole = np.zeros(len(column), bool)
        for t in self.tokens:
            whole |= pc.fill_null(pc.match_substring(column, t), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.by_words(column, end)
        ids, sizes = self.by_words(pc.if_else(pa.array(whole), pa.scalar("", column.type), column), end)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k in np.flatnonzero(whole).tolist():
            own = self.library.encode(column[k].as_py(), add_special_tokens=False).ids
            parts[k] = np.array([*own, end], np.uint32)
            sizes[k] = len(own) + 1
        return np.concatenate(parts), sizes

    def by_words(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Likewise, added tokens read as any other text."""
        raw, at = text_buffer(column)
        n = len(at) - 1
        sizes = np.ones(n, np.int64)
        if not raw.size:
            return np.full(n, end, np.uint32), sizes
        inside = ~SPACE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[1:] |= STOP[raw[1:]] & LETTER[raw[:-1]]
        heads = at[:-1][at[:-1] < len(raw)]
        first[heads] = inside[heads]
        begins = np.flatnonzero(first)
        if not len(begins):
            return np.full(n, end, np.uint32), sizes
        sizes_in = np.add.reduceat(inside, begins, dtype=np.int64)
        offsets = np.append(0, np.cumsum(sizes_in))
        octets = raw[inside]
        wide = np.add.reduceat(octets >= 128, offsets[:-1], dtype=np.int64)
        octets = np.where(np.repeat(wide > 0, sizes_in), octets, LOWER[octets])
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(octets)).dictionary_encode()
        word = self.numbers(words.dictionary)[words.indices.to_numpy()]
        doc = np.searchsorted(at, begins, side="right") - 1
        lengths = self.sizes[word]
        past = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.starts[word] - (past - lengths), lengths) + np.arange(past[-1])]
        sizes += np.bincount(doc, lengths, n).astype(np.int64)
        out = np.empty(len(flat) + n, np.uint32)
        out[np.arange(len(flat)) + np.repeat(doc, lengths)] = flat
        out[np.cumsum(sizes) - 1] = end
        return out, sizes


def grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def planes_of(ids: np.ndarray, block: int, bits: int) -> list[np.ndarray]:
    """Planes of bits (1 or 8) bits each, lowest first, of ids cut into blocks."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    n_bytes = -(-width // 8)
    padded = np.zeros(-(-len(ids) // block) * block, "<u4")
    padded[: len(ids)] = ids
    octets = padded.view(np.uint8).reshape(-1, 4)[:, :n_bytes]
    if bits == 8:
        return list(np.ascontiguousarray(octets.T))
    # Every id's bits side by side, then all planes packed at once.
    planes = np.packbits(np.unpackbits(octets, axis=1, count=width, bitorder="little"), axis=0)
    return list(np.ascontiguousarray(planes.T))


def ids_from(planes: list[bytes], n: int, block: int, bits: int) -> np.ndarray:
    size = -(-n // block) * block
    if not size:
        return np.zeros(0, "<u4")
    octets = np.zeros((size, 4), np.uint8)
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if bits == 8:
        octets[:, : len(rows)] = rows.T
    else:
        packed = np.packbits(np.unpackbits(rows, axis=1, count=size).T, axis=1, bitorder="little")
        octets[:, : packed.shape[1]] = packed
    return octets.reshape(-1).view("<u4")[:n]


@lru_cache
def compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def write_chunk(ids: np.ndarray, docs: list[int | None], counts: np.ndarray, block: int = 4096, bits: int = 1, level: int = 3) -> bytes:
    z = compressor(level)
    frames = [z.compress(p) for p in planes_of(ids, block, bits)]
    table = np.array([d is not None for d in docs], np.uint8).tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + counts.astype("<u8").tobytes()
    head = HEAD.pack(MAGIC, block, len(docs), len(frames), bits, len(ids))
    return b"".join([head, np.array([len(f) for f in frames], "<u8").tobytes(), *frames, z.compress(table)])


def read_chunk(payload: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """ids, doc_ids, and how many ids each has."""
    magic, block, n_docs, n_planes, bits, n_ids = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a chunk of token planes")
    z = zstandard.ZstdDecompressor()
    lengths = np.frombuffer(payload, "<u8", n_planes, HEAD.size)
    at, planes = HEAD.size + 8 * n_planes, []
    for k in lengths.tolist():
        planes.append(z.decompress(payload[at : at + k]))
        at += k
    table = z.decompress(payload[at:])
    known, docs = np.frombuffer(table, np.uint8, n_docs), np.frombuffer(table, "<i8", n_docs, n_docs)
    return ids_from(planes, n_ids, block, bits), [d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)], np.frombuffer(table, "<u8", n_docs, 9 * n_docs)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about limit bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Write:
    """Encodes the sorted documents of a partition and yields its chunks."""

    def __init__(self, path: str, end: int, chunk_ids: int, block: int, bits: int, added: bool):
        self.path, self.end, self.chunk_ids, self.block, self.bits, self.added = path, end, chunk_ids, block, bits, added
        self.key = ("words", path, added)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(self.key, lambda: WordEncoder(self.path, added=self.added))
        shard, chunk, start, held, docs = TaskContext.get().partitionId(), 0, 0, [], []
        for b in gathered(batches, SLICE):
            for part in slices(b, "text", SLICE):
                ids, sizes = encoder.encode(part.column("text"), self.end)
                held.append((ids, sizes))
                docs += part.column("doc_id").to_pylist()
                if sum(len(i) for i, _ in held) >= self.chunk_ids:
                    out = self.row(shard, chunk, start, held, docs)
                    chunk, start, held, docs = chunk + 1, start + out.column("n_ids")[0].as_py(), [], []
                    yield out
        if docs:
            yield self.row(shard, chunk, start, held, docs)

    def row(self, shard: int, chunk: int, start: int, held: list, docs: list) -> pa.RecordBatch:
        ids, counts = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        payload = write_chunk(ids, docs, counts, self.block, self.bits)
        values = (shard, chunk, start, len(docs), len(ids), docs[0], docs[-1], payload)
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["shard", "chunk", "start", "n_docs", "n_ids", "first_doc", "last_doc", "payload"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, chunk_ids: int = 1 << 18, block: int = 4096, bits: int = 1, shards: int | None = None, added: bool = False) -> None:
    """Writes the ids of docs (doc_id, text) to path in ascending doc_id order. added: whether added tokens in a text stand for their own ids."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("r"))
    rows = rows.repartitionByRange(shards, "doc_id", "h", "r").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    map_batches(rows, Write(tokenizer, end, chunk_ids, block, bits, added), CHUNK).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index: shard, chunk, start (ids of all chunks before it), n_docs, n_ids, first_doc, last_doc."""
    index = spark.read.schema(CHUNK).parquet(path)
    # One row for each shard, as many as the writer had partitions.
    sizes = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return index.join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, payload in zip(b.column("start").to_pylist(), b.column("payload").to_pylist(), strict=True):
            ids, docs, counts = read_chunk(payload)
            ends = np.cumsum(counts).astype(np.int64)
            starts = ends - counts.astype(np.int64)
            view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + start), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files at path."""
    return map_batches(read_index(spark, path).select("start", "payload"), read_docs, DOC)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-planes")
    write_tokens(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), added=True)
    return read_tokens(spark, path)
