"""Every operator on a table with a very long text, nulls, repeated rows and columns with clashing names, and on an empty one."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodesieve.llm import byte_bpe, chat_format, decontaminate, exact_dedup, jaccard_join, language_gru, pii_crf, pitman_yor, secret_scan, simhash, token_align, token_planes
from lodesieve.llm.common import new_path

LONG = " ".join(f"word{k % 977} in line {k} of it," for k in range(25_000)) + " token = abcdef123 mail a@b.com " + "é" * 5000 + " " + "x" * 20_000
ROWS = [(1, LONG), (2, None), (3, ""), (3, ""), (None, "und die Katze"), (5, "und die Katze"), (6, LONG + " more"), (7, " \t\n")]
NAMES = "row r h h0 key node slot block first payload digest words hits spans start n_tokens held_out chunk kind target source bucket score window windows copies n_shingles text_hash id kept keep_id own place item items hash fp low high side own_ pairs links asker part parts pos conv p".split()
NET = language_gru.Network(["de", "en"], 4)


def planes(spark, docs):
    path = new_path(spark, "edges")
    token_planes.write_tokens(docs, path, P.path("word_bpe_49k.json"))
    return token_planes.read_tokens(spark, path)


def bench(spark):
    return spark.createDataFrame([(1, " ".join(LONG.split()[:300])), (2, "und die Katze"), (2, "und die Katze"), (None, None)], "item_id bigint, text string")


OPS = {
    "op1": (lambda spark, d: secret_scan.secret_scan(d), 8),
    "op3": (planes, 8),
    "op4": (lambda spark, d: jaccard_join.jaccard_groups(d).drop("text_hash", "keep"), 8),
    "op4 links": (lambda spark, d: jaccard_join.link_counts(d), 8),
    "op4 kept": (lambda spark, d: jaccard_join.one_of_each_group(d).select("doc_id", "text"), 6),
    "op5": (lambda spark, d: exact_dedup.exact_dedup(d).select("id", "digest", "keep_id", "group_size"), 8),
    "op5 kept": (lambda spark, d: exact_dedup.without_copies(d).select("text"), 5),
    "op6": (lambda spark, d: language_gru.language_id(d, NET), 8),
    "op7": (lambda spark, d: decontaminate.decontaminate(d, bench(spark)).drop("row", "text_hash"), 8),
    "op7 kept": (lambda spark, d: decontaminate.without_benchmark(d, bench(spark)).select("doc_id", "text"), 4),
    "op8": (lambda spark, d: pii_crf.find_pii(d, pii_crf.Field([])), 8),
    "op9": (lambda spark, d: pitman_yor.score_documents(d, F.col("doc_id") == 1, burn=1, samples=1).select("doc_id", "held_out", "n_tokens", "n_known", "base_score"), 8),
    "op11": (lambda spark, d: simhash.simhash_groups(d), 8),
    "op12": (lambda spark, d: token_align.token_align(d, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model")), 8),
    "op10": (lambda spark, d: byte_bpe.byte_bpe(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), 8),
}


@pytest.mark.parametrize("name", OPS)
def test_long_texts_and_clashing_columns(spark, name):
    f, n = OPS[name]
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    clash = docs.withColumns({c: F.lit(f"own {c}") for c in NAMES})
    rows = lambda d: sorted((tuple(map(str, r)) for r in f(spark, d).collect()))
    got = rows(clash)
    assert got == rows(docs) and len(got) == n
    assert f(spark, clash.where("false")).count() == 0


def test_conversations_with_long_texts_equal_turns_and_clashing_columns(spark):
    turns = [(1, None, "user", LONG)] + [(2, 5, "user", "same")] * 3000 + [(3, 5, "user", "same")] * 2999 + [(None, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    clash = df.withColumns({c: F.lit(f"own {c}") for c in NAMES})
    got = sorted((r["conv_id"] or 0, r["n_turns"], len(r["rendered"])) for r in chat_format.chat_format(clash).collect())
    frame = len("<|im_start|>\n<|im_end|>\n")
    assert got == [(0, 1, frame), (1, 1, frame + 4 + len(LONG)), (2, 3000, 3000 * (frame + 8))]
