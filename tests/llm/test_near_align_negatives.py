"""SimHash links, token alignment and hard negatives against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodesieve.llm import hard_negatives, simhash, token_align
from lodesieve.llm.common import documents


def roots(nodes, linked):
    """The smallest node that each reaches."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(nodes)
    for k, a in enumerate(order):
        for b in order[:k]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


# SimHash ------------------------------------------------------------------------------------

def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    count = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in count.items() if 2 * n > len(grams))


def test_code_is_perfect():
    index = simhash.index()
    assert len(np.unique(index)) == 4096 and (np.bincount(index) == 2048).all()
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    for b in range(23):  # a bit's change leads to one of the near indices
        codes, full = simhash.near_indices(words, 23)
        other = index[words ^ (1 << b)]
        assert ((codes == other[:, None]) & full).any(1).all()
    assert full.sum(1).max() <= 6


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_keys_meet_within_three_bits(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for x in rng.choice(64, bits, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(x)
    own, near = [set() for _ in a], [set() for _ in a]
    for key, of, is_own in zip(*(x.tolist() for x in simhash.keys_of(a)), strict=True):
        if is_own:
            own[of].add(key)
    for key, of, _ in zip(*(x.tolist() for x in simhash.keys_of(b)), strict=True):
        near[of].add(key)
    assert all(x & y for x, y in zip(own, near, strict=True))


@pytest.mark.parametrize("block", [2048, 16])
def test_dense_families(spark, block):
    """Hundreds of fingerprints around few centres, so that keys are of many: runs, blocks and pairs of blocks."""
    rng = random.Random(4)
    nodes = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(90):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            nodes.add(x - (1 << 64) if x >> 63 else x)
    want = roots(nodes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    found = simhash.links(spark.createDataFrame([(n,) for n in nodes], "fp bigint"), block).collect()
    pairs = {(r["a"], r["b"]) for r in found}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in pairs)
    assert roots(nodes, lambda a, b: (a, b) in pairs or (b, a) in pairs) == want


def test_simhash_by_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, " \t"), (9004, "One"), (9005, "one"), (9006, "a b"), (9007, "A  B\n")]
    fp = {i: fingerprint(t) for i, t in rows}
    want = roots(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


# Alignment ----------------------------------------------------------------------------------

ODD = [None, "", " ", "  ", "a  b", "▁ x", "▁", "\x00a", "<s> x</s><unk>", "<|endoftext|> a", "a\n\n b\t", "日本語 テスト 12 345", "x" * 3000, "🙂🙂 👩‍👩‍👧", "  x", " 　x", "\r\n", "ﬁ é é", "ab " * 500, "." * 300]


def aligned(rows):
    """By the libraries, pair by pair."""
    a_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters, count, out = token_align.byte_letters(), Counter(), []
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        a, b = a_lib.encode(" " + (t or ""), add_special_tokens=False).ids, b_lib.encode(t or "")
        a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(x)[3:5], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            out.append((i, 0, 0, [], []))
            continue
        a_end, b_end = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
        links, first = [], 0
        for x, e in enumerate(a_end):
            s = e - len(a_bytes[x])
            while b_end[first] <= s:
                first += 1
            y = first
            while y < len(b) and b_end[y] - len(b_bytes[y]) < e:
                links.append((a[x], b[y]))
                y += 1
        groups, x, y = [], 0, 0
        for e in sorted(set(a_end) & set(b_end)):
            to_x, to_y = a_end.index(e) + 1, b_end.index(e) + 1
            groups.append(",".join(map(str, a[x:to_x])) + "|" + ",".join(map(str, b[y:to_y])))
            x, y = to_x, to_y
        count.update(links)
        out.append((i, len(a), len(b), links, groups))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted((str(i), n, m, len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), digest(g)) for i, n, m, ls, g in out)


@pytest.mark.parametrize("chunk_links", [4_000_000, 5000])
def test_alignment_by_the_libraries(spark, sf_dir, chunk_links):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").limit(80).collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)] + [(5, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = token_align.token_align(df, P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"), chunk_links).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in got) == aligned(rows)


def test_memo_is_bounded_and_exact():
    """Texts through an aligner that starts anew all the time give the same windows."""
    texts = [f"word{k} and {'x' * (k % 200)} the{k % 7}  end" for k in range(300)]
    import pyarrow as pa

    paths = (P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))
    out = []
    for most in (10**9, 5):
        aligner = token_align.Aligner(*paths, most)
        rows = []
        for k in range(0, len(texts), 20):
            chunk = token_align.Chunk(k, aligner)
            chunk.add(list(range(k, k + 20)), pa.array(texts[k : k + 20]))
            rows += list(zip(chunk.digest, chunk.counts, strict=True))
            if len(aligner.text) > most:
                aligner.clear()
        out.append(rows)
    assert out[0] == out[1]


# Hard negatives -----------------------------------------------------------------------------

def mined(rows):
    """rows: (id, label, whole-number vector). By a loop over all pairs."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, label, v in rows:
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            p = -s
            fit = [(n, -t) for t, n, other in scored if other != label and 30 * p <= -100 * t <= 90 * p][:10]
            out += [(i, j, r, n, p, t) for r, (n, t) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("sample, leaf_rows", [(8192, 1024), (120, 12), (1, 1)])
def test_negatives_by_brute_force(spark, sample, leaf_rows):
    rng = random.Random(8)
    rows = [(k, rng.randrange(4), [rng.randint(-90, 90) for _ in range(6)]) for k in range(700)]
    rows += [(k, k % 3, [50, 0, 0, 0, 0, 7]) for k in range(700, 1000)]  # a large share of equal vectors
    rows += [(1000, 9, [1] * 6), (1100, 1, []), (1101, 1, [3]), (1200, 2, [0] * 6), (1201, 2, [0] * 6), (1202, 3, [0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, label bigint, v array<bigint>").withColumns({"leaf": F.lit("own"), "anchor": F.lit(1)}).repartition(5)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, sample=sample, leaf_rows=leaf_rows)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined(rows)


def test_vectors_that_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, -0.001]), (1, None, [1.0]), (2, 1, None), (3, 1, [nan, 1.0]), (4, 1, [inf]), (5, 1, [-inf]), (6, 1, [None, 1.0]), (None, 1, [1.0]), (7, 1, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    assert [tuple(r) for r in hard_negatives.whole_vectors(df).orderBy("vec_id").collect()] == [(0, 1, [128, math.floor(-0.256)]), (7, 1, [])]
    assert hard_negatives.hard_negatives(hard_negatives.whole_vectors(df.where("false")), F.col("vec_id") % 100 == 0).count() == 0


def test_tree_drops_subtrees_and_loses_nothing():
    """Clustered rows: most leaves go, and none that holds a row in a window."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (12, 8)).astype(float)
    x = (centres[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 8))).round()
    tree = hard_negatives.Tree(x[:400], len(x), leaf_rows=100)
    leaf, ranges = tree.down(x)
    tree.set_ranges(ranges)
    scores = x[:50] @ x.T
    best = np.sort(scores, axis=1)[:, -5]
    seen, visits = np.zeros((50, tree.leaves), bool), 0
    for k, rows in tree.alive(x[:50], best, np.full(50, 1e18)):
        seen[rows, k] = True
        visits += len(rows)
    assert all(seen[q, leaf[r]] for q in range(50) for r in np.flatnonzero(scores[q] >= best[q]))
    assert tree.leaves > 8 and visits < 0.7 * 50 * tree.leaves
