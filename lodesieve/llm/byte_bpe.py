r"""Byte-level BPE, encoded and decoded by recursive DuckDB queries in each partition.

A text is cut into pieces by the tokenizer's pattern. A piece that is a token is that token.
Of any other piece the bytes are rows (piece, position, token); a recursive query joins
neighbours to the merge table, and contracts the leftmost pair of minimum rank of each piece,
round by round, until no piece has a pair left. Another query decodes: it joins the ids to
the vocabulary and aggregates the bytes in order.

Work is done once for each different stretch of text between two sure piece boundaries
(before a space that a non-space follows, around a line end, between a letter A-Z and a full
stop or comma), and what is known is kept by the Python worker up to ``most`` stretches.

A round contracts one pair of a piece, so a piece of n bytes takes up to n rounds over n
rows (the keyed table holds n of them, not those of all rounds). Pieces beyond ``long`` bytes (runs of thousands of letters or signs) are therefore left
to the tiktoken library's own encoder, which gives the same ids.

Defined results. Null text counts as empty: 0 tokens and the digests of nothing. Ids of rows
are passed through, null and repeated ones too; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, kept, map_batches, slices, text_buffer

#: Pieces of one recursive query, and bytes of text whose new pieces are gathered for it.
PIECES, GATHER = 32_000, 4 << 20
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

# The table is keyed, so it holds each byte's row once, as its last round left it: -1 where a pair has taken it in. A
# piece that has no pair left gives no rows to the next round.
ENCODE = """
WITH RECURSIVE step(piece, pos, tok) USING KEY (piece, pos) AS (
  SELECT piece, pos, tok FROM start
  UNION ALL
  (WITH pair AS (
     SELECT piece, pos, tok, lead(tok) OVER w AS tok2, lead(pos) OVER w AS pos2
     FROM step WHERE tok >= 0 WINDOW w AS (PARTITION BY piece ORDER BY pos)),
   best AS (
     SELECT piece, arg_min(struct_pack(pos := pair.pos, pos2 := pair.pos2, rank := merges.rank), merges.rank::BIGINT * 65536 + pair.pos) AS b
     FROM pair JOIN merges ON pair.tok = merges.a AND pair.tok2 = merges.b GROUP BY piece)
   SELECT pair.piece, pair.pos, CASE WHEN pair.pos = b.pos THEN b.rank WHEN pair.pos = b.pos2 THEN -1 ELSE pair.tok END
   FROM pair JOIN best ON pair.piece = best.piece)
)
SELECT piece, list(tok ORDER BY pos) AS ids FROM step WHERE tok >= 0 GROUP BY piece ORDER BY piece
"""

DECODE = """
SELECT stretch, unhex(string_agg(vocabulary.hex, '' ORDER BY pos)) AS bytes
FROM ids JOIN vocabulary ON ids.tok = vocabulary.tok GROUP BY stretch ORDER BY stretch
"""

WHITE = r"\t-\r \x85\xa0  -     　"
#: After these bytes, or before them, a byte may belong to white space.
DOUBT = np.zeros(256, bool)
DOUBT[[*range(9, 14), 32, *range(128, 256)]] = True
LETTER, STOP, UNSURE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
STOP[[44, 46]] = True
UNSURE[[*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def merges_of(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Every pair of tokens whose bytes together are a token, with that token's rank."""
    out = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return tuple(map(list, zip(*out, strict=True)))


class Codec:
    """Encodes and decodes in one Python worker."""

    def __init__(self, path: str, pattern: str, most: int, long: int):
        import duckdb
        import regex

        self.ranks, self.most, self.long, self.path, self.pattern = ranks_of(path), most, long, path, pattern
        self.split = regex.compile(pattern.replace(r"[^\s\p", rf"[^{WHITE}\p").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        a, b, rank = merges_of(self.ranks)
        merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(rank, pa.int32())})  # noqa: F841
        vocabulary = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.octet = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.library = None
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.counts: list[int] = []
        self.ids: list[bytes] = []
        self.decoded: list[bytes] = []

    def pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        """The ids of different pieces."""
        out, rest = {}, []
        for p in pieces:
            b = p.encode()
            if (one := self.ranks.get(b)) is not None:
                out[p] = [one]
            elif len(b) <= self.long:
                rest.append((p, b))
            else:
                out[p] = self.by_library(p)
        rest.sort(key=lambda x: len(x[1]))  # pieces of one length take about as many rounds
        for at in range(0, len(rest), PIECES):
            part = rest[at : at + PIECES]
            sizes = np.fromiter((len(b) for _, b in part), np.int64, len(part))
            piece = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
            pos = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = pa.table({"piece": piece, "pos": pos.astype(np.int32), "tok": self.octet[np.frombuffer(b"".join(b for _, b in part), np.uint8)]})
            self.db.register("start", rows)
            found = self.db.sql(ENCODE).to_arrow_table().column("ids").to_pylist()
            self.db.unregister("start")
            out.update(zip((p for p, _ in part), found, strict=True))
        return out

    def by_library(self, piece: str) -> list[int]:
        import tiktoken

        self.library = self.library or tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self.library.encode_ordinary(piece)

    def numbers(self, stretches: list[str]) -> list[int]:
        """The number of each stretch; what is new is encoded and decoded."""
        if len(self.number) + len(stretches) > self.most:
            self.clear()
        new = [s for s in stretches if s not in self.number]
        if new:
            cut = [self.split(s) for s in new]
            known = self.pieces(list(dict.fromkeys(p for c in cut for p in c)))
            ids = [known[c[0]] if len(c) == 1 else [i for p in c for i in known[p]] for c in cut]
            sizes = [len(i) for i in ids]
            flat = np.fromiter((i for x in ids for i in x), np.int32, sum(sizes))
            stretch = np.repeat(np.arange(len(new), dtype=np.int32), sizes)
            rows = pa.table({"stretch": stretch, "pos": np.arange(len(flat), dtype=np.int32), "tok": flat})
            self.db.register("ids", rows)
            self.decoded += self.db.sql(DECODE).to_arrow_table().column("bytes").to_pylist()
            self.db.unregister("ids")
            self.ids += [",".join(map(str, i)).encode() for i in ids]
            self.counts += sizes
            first = len(self.number)
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
        return [self.number[s] for s in stretches]


def stretches_of(raw: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The stretches of many texts, in order, and the number of the first one of each text (and their count)."""
    cut = np.zeros(len(raw) + 1, bool)
    before, after = raw[:-1], raw[1:]
    cut[:-2] |= (before == 32) & ~UNSURE[after]
    cut[1:-1] |= (before == 10) & ~UNSURE[after] | (after == 10) & ~DOUBT[before] | STOP[after] & LETTER[before]
    cut[at] = True
    begins = np.flatnonzero(cut)
    texts = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(raw))
    return texts.dictionary_encode(), np.searchsorted(begins, at)


class Encode:
    def __init__(self, path: str, pattern: str, most: int, long: int):
        self.key = (path, pattern, most, long)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(self.key, lambda: Codec(*self.key))
        for whole in batches:
            for b in slices(whole, "text", GATHER):
                yield encoded(codec, b)


def encoded(codec: Codec, b: pa.RecordBatch) -> pa.RecordBatch:
    raw, at = text_buffer(b.column("text"))
    if raw.size:
        words, first = stretches_of(raw, at)
        number = np.array(codec.numbers(words.dictionary.to_pylist()), np.int64)[words.indices.to_numpy()]
    else:
        number, first = np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    counts, ids, decoded = np.array(codec.counts or [0], np.int64), codec.ids, codec.decoded
    n, id_digest, text_digest = [], [], []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = number[a:z].tolist()
        n.append(int(counts[own].sum()) if own else 0)
        id_digest.append(hashlib.sha256(b",".join([ids[k] for k in own])).hexdigest())
        text_digest.append(hashlib.sha256(b"".join([decoded[k] for k in own])).hexdigest())
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(id_digest, pa.string()), pa.array(text_digest, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def byte_bpe(docs: DataFrame, path: str, pattern: str, most: int = 1_000_000, long: int = 128) -> DataFrame:
    """docs: doc_id, text. One row each: tokens, and digests of the ids and of what they decode to."""
    return map_batches(docs.select("doc_id", "text"), Encode(path, pattern, most, long), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
