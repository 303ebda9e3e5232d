"""Token files and byte-level BPE against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodesieve.llm import byte_bpe, token_planes
from lodesieve.llm.common import documents, new_path

ODD = [None, "", " ", "  ", "a  b", "a   b\n\nc", "it's 's 'S don't\n x", "a \n b", "x  y", "  y", "\x1c \x1c", "é" * 300 + "ab.c,d", "....,,,, a.b,c", "日本語 テスト 12 345", "a\r\n b", "tab\t x", "end ", " a.", "\n\na",
       "a .b", "<|endoftext|> hi", "Σ σς ΑΣ", "é ́x", "Á", "x" * 3000, "ab" * 300, "™ ™a", "\u0085x", "İI", "🙂🙂 👩‍👩‍👧"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").limit(120).collect()]
    return rows + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(5, "again"), (None, "no id")]


def test_bpe_equals_library(spark, texts):
    ranks = byte_bpe.ranks_of(P.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for long in (128, 8):
        got = {(r["doc_id"], r["decoded_sha256"]): r for r in byte_bpe.byte_bpe(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, long=long, most=5000).collect()}
        assert len(got) == len(texts)
        for i, t in texts:
            ids = lib.encode_ordinary(t or "")
            r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 2), (7, 49408), (4096, 49408), (5000, 1 << 31), (9000, 200)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        docs, counts = [3, None, 9], np.array([n // 2, 0, n - n // 2])
        back, d, c = token_planes.read_chunk(token_planes.write_chunk(ids, docs, counts, block=512, bits=bits))
        assert (back == ids).all() and d == docs and c.tolist() == counts.tolist()


def test_files_equal_library(spark, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    path = new_path(spark, "tokens")
    token_planes.write_tokens(df, path, P.path("word_bpe_49k.json"), chunk_ids=2000, block=256)
    got = sorted((r.asDict() for r in token_planes.read_tokens(spark, path).collect()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in texts], key=lambda i: (i is not None, i or 0))
    by = {}
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        by.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in by[r["doc_id"]]
        at += r["n_tokens"]
    index = token_planes.read_index(spark, path)
    assert index.count() > 3 and index.agg({"n_docs": "sum"}).first()[0] == len(texts)
    empty = new_path(spark, "tokens")
    token_planes.write_tokens(df.where("false"), empty, P.path("word_bpe_49k.json"))
    assert token_planes.read_tokens(spark, empty).count() == 0


def test_query_equals_unmodified_library(spark, tmp_path):
    texts = ["a <|endoftext|> hi", "A<|startoftext|>B,c. <|endoftext|><|endoftext|>", "plain Words, no more.", "<|ENDOFTEXT|> x", None, "<|endoftext|>", "é\u0301 <|endoftext|>\n É.x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = sorted(token_planes.query(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    assert t.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 1883]
    for r, x in zip(got, texts, strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
