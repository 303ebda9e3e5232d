"""Cross-tokenizer alignment: whitespace-token anchors, windows of ids, memoised alignments, and counts of linked ids.

Tokenizer A is a byte-level BPE, B a sentencepiece model that puts a blank before a text; A gets the text with that blank. After
both have encoded whole texts, tokens that are marked with a blank and begin at the same byte in both are anchors:
the ends before them are shared, which the byte offsets verify. Anchors cut a text into windows, a word each in most
prose. What a window's ids link and how they group depends on the ids alone, so each worker aligns each pair of id
tuples once and looks it up after. Windows of over ``LONG`` tokens are aligned where they stand.

1. Tasks encode and align. A task's documents make chunks of about ``CHUNK_LINKS`` links: a chunk has the results of its
   documents, the windows of each, the pairs of ids of each window, and its different pairs with their numbers of links.
2. Spark sums the links of each pair, and finds the largest sum of each B id. A pair crosses once for each chunk,
   however often it occurs there.
3. The sums return to the chunks that asked for them, which add them up by document.

So what is shuffled is a row for each chunk and different pair, and the chunks; no document's links are.

Defined results. A text is aligned if it is not empty and both tokenizers' bytes, joined, are the blank and the text; null, empty and
other texts have no tokens: zeros, and '' for the digest. Null ids and repeated rows are kept, a row each. An empty table gives
an empty result; other columns are not read. Strings of special tokens within texts are plain text.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, both, documents, from_numbers, kept, map_batches, numbers, rows, saved, slices, text_buffer, unblobs

CHUNK_LINKS, LONG, MOST = 4_000_000, 64, 600_000
CHUNK = "chunk bigint, pairs array<bigint>, links array<bigint>, payload binary"
DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
B_MASK = (1 << 32) - 1


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: the tokenizers file's vocabulary as ranks, which must be those of its merges."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        letters, model = byte_letters(), whole["model"]
        special = {t["content"] for t in whole.get("added_tokens", [])}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        if ids != sorted(ids):
            raise ValueError("ids are not in the order of the merges")
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in self.bytes.items()}, special_tokens={})
        self.path, self.library = path, None

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text) if len(text) < 400_000 else self.long(text)

    def long(self, text: str) -> list[int]:
        """A very long text, whose pattern may need more steps than tiktoken takes."""
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B. Whole texts are encoded, each different word once: as no piece has a blank after another character, no merge
    reaches over the beginning of a word, and what a blank and a word give is the same wherever they stand."""

    def __init__(self, path: str, most: int = MOST):
        import sentencepiece

        self.model, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        self.bytes = {}
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            if "▁" in p.lstrip("▁"):
                raise ValueError("a piece goes over the beginning of a word")
            self.bytes[i] = bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
        self.blank = self.model.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends, self.good = array("I"), array("q", [0]), array("b")

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > self.most:
            self.clear()
        new = [w for w in words if w not in self.number]
        for w, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            ids = ids or [self.blank]  # a blank alone
            self.number[w] = len(self.good)
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
            self.good.append(b"".join([self.bytes[i] for i in ids]) == b" " + w.encode())
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, how many each has, and whether their bytes are the blank and the text; empty texts have none."""
        raw, at = text_buffer(column)
        n = len(at) - 1
        if not raw.size:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
        cut = np.zeros(len(raw), bool)
        cut[1:] = (raw[1:] == 32) & (raw[:-1] != 32)
        heads = at[:-1][np.diff(at) > 0]
        cut[heads] = False
        octets = raw[~cut]  # a word's own blank goes, as the model puts one before
        cut[heads] = True
        begins = np.flatnonzero(cut)
        dropped = np.ones(len(begins), np.int64)
        dropped[np.searchsorted(begins, heads)] = 0
        offsets = np.append(begins - (np.cumsum(dropped) - dropped), len(octets)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(octets)).dictionary_encode()
        word = self.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        ends = np.array(self.ends)
        size = ends[word + 1] - ends[word]
        past = np.cumsum(size)
        ids = np.array(self.ids, np.uint32)[np.repeat(ends[word] - (past - size), size) + np.arange(int(past[-1]))]
        text = np.searchsorted(at, begins, side="right") - 1
        sizes = np.zeros(n, np.int64)
        np.add.at(sizes, text, size)
        good = np.diff(at) > 0
        good[text[np.array(self.good)[word] == 0]] = False
        return ids, sizes, good


def table(tokens: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each id's bytes, and whether they begin with a blank."""
    n = max(tokens) + 1
    size, blank = np.zeros(n, np.int64), np.zeros(n, bool)
    for i, t in tokens.items():
        size[i], blank[i] = len(t), t[:1] == b" "
    return size, blank


class Aligner:
    """Both tokenizers and the windows that a worker has seen: each has a number."""

    def __init__(self, a_path: str, pattern: str, b_path: str, most: int = MOST):
        self.a, self.b, self.most = ByteLevel(a_path, pattern), Pieces(b_path, most), most
        (self.a_size, self.a_blank), (self.b_size, self.b_blank) = table(self.a.bytes), table(self.b.bytes)
        self.digits = np.array([f"{i}{sign}" for i in range(max(len(self.a_size), len(self.b_size))) for sign in ",|;"], object)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.text: list[str] = []
        self.groups = array("q")
        self.pairs, self.ends = array("q"), array("q", [0])

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both of all texts that can be aligned, how many each text has, and which texts these are."""
        b, b_size, good = self.b.encode(column)
        known, parts, a_size = self.a.bytes, [], np.zeros(len(good), np.int64)
        for k in np.flatnonzero(good).tolist():
            text = " " + column[k].as_py()
            ids = self.a.encode(text)
            if b"".join(map(known.__getitem__, ids)) == text.encode():
                parts.append(np.array(ids, np.uint32))
                a_size[k] = len(ids)
            else:
                good[k] = False
        b = b[np.repeat(good, b_size)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), b, a_size[good], b_size[good], np.flatnonzero(good)

    def add(self, a: np.ndarray, b: np.ndarray, a_count: np.ndarray, b_count: np.ndarray) -> int:
        """Aligns windows, given their ids one after another and how many each has; the number of the first."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        end = np.union1d(a_end, b_end)  # each stretch between two ends of either is a link
        shared = np.intersect1d(a_end, b_end, assume_unique=True)  # and between two ends of both a group
        last = a_end[np.cumsum(a_count) - 1]  # of each window
        pair = a[np.searchsorted(a_end, end)].astype(np.int64) << 32 | b[np.searchsorted(b_end, end)]
        n_links, n_groups = (np.diff(np.searchsorted(x, last, side="right"), prepend=0) for x in (end, shared))
        # Ids as text, in groups: a comma after each, but a bar after a group's last id of a, and a semicolon after that of b.
        of_a, of_b = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        a_closes, b_closes = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        a_in, b_in = np.bincount(of_a, minlength=len(shared)), np.bincount(of_b, minlength=len(shared))
        parts = np.empty(len(a) + len(b), object)
        to_a = np.arange(len(a)) + np.repeat(np.cumsum(b_in) - b_in, a_in)
        to_b = np.arange(len(b)) + np.repeat(np.cumsum(a_in), b_in)
        parts[to_a] = self.digits[a.astype(np.int64) * 3 + a_closes]
        parts[to_b] = self.digits[b.astype(np.int64) * 3 + 2 * b_closes]
        parts = parts.tolist()
        bounds = np.cumsum(a_count + b_count).tolist()
        first, i = len(self.text), 0
        for j in bounds:
            self.text.append("".join(parts[i:j])[:-1])
            i = j
        self.groups.frombytes(n_groups.tobytes())
        self.ends.frombytes((len(self.pairs) + np.cumsum(n_links)).tobytes())
        self.pairs.frombytes(pair.tobytes())
        return first

    def windows(self, a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The windows of texts, one after another: their numbers, and each text's first window. a_first, b_first: each text's first token."""
        a_at, b_at = np.cumsum(self.a_size[a]) - self.a_size[a], np.cumsum(self.b_size[b]) - self.b_size[b]
        a_can, b_can = self.a_blank[a], self.b_blank[b]
        a_can[a_first], b_can[b_first] = True, True
        a_begin, b_begin = np.flatnonzero(a_can), np.flatnonzero(b_can)
        a_place, b_place = a_at[a_begin], b_at[b_begin]
        y = np.searchsorted(b_place, a_place)
        shared = b_place[np.minimum(y, len(b_place) - 1)] == a_place  # a verified shared end
        a_begin, b_begin = a_begin[shared], b_begin[y[shared]]
        a_end, b_end = np.append(a_begin[1:], len(a)), np.append(b_begin[1:], len(b))
        # A window's ids side by side: those of a are marked by the highest bit, so that a stretch tells both id tuples.
        mixed = np.empty(len(a) + len(b), np.uint32)
        mixed[np.arange(len(a)) + np.repeat(b_begin, a_end - a_begin)] = a | np.uint32(1 << 31)
        mixed[np.arange(len(b)) + np.repeat(a_end, b_end - b_begin)] = b
        raw, begin, end = mixed.tobytes(), (4 * (a_begin + b_begin)).tolist(), (4 * (a_end + b_end)).tolist()
        number = self.number
        keys = [raw[i:k] for i, k in zip(begin, end, strict=True)]
        out = list(map(number.get, keys))
        if None in out:
            fresh: dict[bytes, int] = {}
            some = []
            for k, w in enumerate(out):
                if w is None and keys[k] not in fresh:
                    fresh[keys[k]] = len(some)
                    some.append(k)
            some = np.array(some)
            a_count, b_count = (a_end - a_begin)[some], (b_end - b_begin)[some]
            spots = [np.arange(int(c.sum())) + np.repeat(x[some] - (np.cumsum(c) - c), c) for x, c in ((a_begin, a_count), (b_begin, b_count))]
            first = self.add(a[spots[0]], b[spots[1]], a_count, b_count)
            for k, w in enumerate(out):
                if w is None:
                    out[k] = first + fresh[keys[k]]
            number.update((key, first + w) for key, w in fresh.items() if len(key) <= 4 * LONG)
        return out, np.searchsorted(a_begin, a_first)


class Encode:
    def __init__(self, a_path: str, pattern: str, b_path: str, chunk_links: int):
        self.paths, self.chunk_links = (a_path, pattern, b_path), chunk_links
        self.key = ("align", *self.paths)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(self.key, lambda: Aligner(*self.paths))
        chunk = Chunk(TaskContext.get().partitionId() << 24, aligner)
        for whole in batches:
            for b in slices(whole, "text"):
                chunk.add(b.column("doc_id").to_pylist(), b.column("text"))
                if chunk.links >= self.chunk_links or len(aligner.text) > aligner.most:
                    yield chunk.row()
                    if len(aligner.text) > aligner.most:
                        aligner.clear()
                    chunk = Chunk(chunk.name + 1, aligner)
        if chunk.docs:
            yield chunk.row()


class Chunk:
    """What a task has gathered since its last chunk."""

    def __init__(self, name: int, aligner: Aligner):
        self.name, self.aligner, self.links = name, aligner, 0
        self.docs: list[int | None] = []
        self.digest: list[str] = []
        self.counts: list[tuple[int, int, int, int]] = []
        self.of: list[np.ndarray] = []  # of each entry the document, its window and how often
        self.window: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: list[int | None], column: pa.Array) -> None:
        al, first = self.aligner, len(self.docs)
        a, b, a_size, b_size, good = al.encoded(column)
        self.docs += ids
        counts, digest = [(0, 0, 0, 0)] * len(ids), [""] * len(ids)
        if len(good):
            found, at = al.windows(a, b, np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size)
            window, text = np.array(found, np.int64), al.text
            n_groups = np.add.reduceat(np.array(al.groups)[window], at).tolist()
            n_links = np.add.reduceat(np.diff(np.array(al.ends))[window], at).tolist()
            bounds = [*at.tolist(), len(found)]
            for n, (k, i, j) in enumerate(zip(good.tolist(), bounds[:-1], bounds[1:], strict=True)):
                counts[k] = (int(a_size[n]), int(b_size[n]), n_groups[n], n_links[n])
                digest[k] = hashlib.sha256(";".join([text[x] for x in found[i:j]]).encode()).hexdigest()
                own, times = np.unique(window[i:j], return_counts=True)
                self.of.append(np.full(len(own), first + k))
                self.window.append(own)
                self.times.append(times)
            self.links += sum(n_links)
        self.counts += counts
        self.digest += digest

    def row(self) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        of, window, times = (np.concatenate(x) if x else none for x in (self.of, self.window, self.times))
        used, window = np.unique(window, return_inverse=True)
        ends = np.array(self.aligner.ends)
        sizes = ends[used + 1] - ends[used]
        place = np.arange(int(sizes.sum())) + np.repeat(ends[used] - (np.cumsum(sizes) - sizes), sizes)
        pairs, pair = np.unique(np.array(self.aligner.pairs)[place], return_inverse=True)
        occurs = np.zeros(len(used), np.int64)
        np.add.at(occurs, window, times)
        links = np.zeros(len(pairs), np.int64)
        np.add.at(links, pair, np.repeat(occurs, sizes))
        known = np.array([d is not None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], np.int64)
        counts = np.array(self.counts, np.int64).reshape(-1)
        payload = blobs(known.tobytes(), ids.tobytes(), numbers(counts), "".join(d or "-" * 64 for d in self.digest).encode(), numbers(np.diff(of, prepend=0)), numbers(window), numbers(times), numbers(sizes), numbers(pair))
        schema = pa.schema([("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())), ("payload", pa.binary())])
        return rows(schema, chunk=[self.name], pairs=[pairs], links=[links], payload=[payload])


def finish(chunks: pa.Table, sums: pa.Table) -> pa.Table:
    """A chunk's documents, given its pairs' sums (in the order of the pairs)."""
    known, ids, counts, digest, of, window, times, sizes, pair = unblobs(chunks.column("payload")[0].as_py())
    known, ids, counts = np.frombuffer(known, np.uint8), np.frombuffer(ids, np.int64), from_numbers(counts).reshape(-1, 4)
    of, window, times, sizes, pair = np.cumsum(from_numbers(of)), *map(from_numbers, (window, times, sizes, pair))
    order = np.argsort(sums.column("place").to_numpy())
    n, best = (sums.column(c).to_numpy()[order] for c in ("n", "best"))
    of_window = np.repeat(np.arange(len(sizes)), sizes)
    out = []
    for value in (best, n):
        in_window, in_doc = np.zeros(len(sizes), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(in_window, of_window, value[pair])
        np.add.at(in_doc, of, in_window[window] * times)
        out.append(in_doc)
    digest = digest.decode()
    return pa.table({
        "doc_id": pa.array(ids, mask=known == 0), "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2], "n_links": counts[:, 3], "n_best": out[0], "count_sum": out[1],
        "groups_sha256": pa.array([digest[64 * k : 64 * k + 64] if counts[k, 0] else "" for k in range(len(ids))], pa.string()),
    })


def chunks(docs: DataFrame, a_path: str, pattern: str, b_path: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """docs: doc_id, text. A row for each chunk of aligned documents: chunk, its pairs (a << 32 | b), links of each, payload."""
    return saved(map_batches(docs.select("doc_id", "text"), Encode(a_path, pattern, b_path, chunk_links), CHUNK), "align-chunks")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, n (links that hold it, corpus-wide), best (1 if no pair with its B id has more)."""
    totals = chunks.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.links").alias("n"))
    totals = saved(totals.withColumn("b", F.col("pair").bitwiseAND(F.lit(B_MASK))), "align-totals")
    most = totals.groupBy("b").agg(F.max("n").alias("most"))
    return totals.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))


def token_align(docs: DataFrame, a_path: str, pattern: str, b_path: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """docs: doc_id, text. One row each, with the columns of DOC."""
    cut = chunks(docs, a_path, pattern, b_path, chunk_links)
    asked = cut.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(cut), "pair").select(F.col("chunk").alias("asker"), "place", "n", "best")
    return cut.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(both(finish), DOC)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_align(documents(spark, sf_dir), P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))
