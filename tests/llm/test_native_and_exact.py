"""Chat formatting and exact dedup against brute force."""

import hashlib
import random

import numpy as np

from lodesieve.llm import chat_format, exact_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def chats(rows):
    """Brute force: conversations as lists; those that are a proper prefix of another go, of equal ones the smallest id stays."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    lists = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, a in lists.items():
        if any(len(b) > len(a) and b[: len(a)] == a for b in lists.values()):
            continue
        same = [k for k, b in lists.items() if b == a]
        if c == min((k for k in same if k is not None), default=None):
            out[c] = (len(a), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a))
    return out


def test_chat_collapse(spark):
    rng = random.Random(2)
    rows = []
    for c in range(60):
        base = rng.randint(0, 5)
        for t in range(rng.randint(1, 6)):
            rows.append((c, t * (1 + c % 2), rng.choice(["user", "user"]) if t % 2 == 0 else "assistant", f"text {base} {t if rng.random() < 0.9 else rng.random()}"))
    rows += [(100, None, "user", "a"), (100, None, "user", "a"), (101, None, None, None), (102, 500, "user", "x"), (102, 3, "user", "w"), (103, 3, "user", "w"), (104, 1, "user", "p"), (104, 1, "user", "q"), (104, 1, "a", "q"), (105, -70, "user", "m"), (105, -3, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["rendered"]) for r in chat_format.chat_format(df).collect()}
    assert got == chats(rows)


def test_chat_long_conversation_and_empty(spark):
    rows = [(1, t, "user", str(t)) for t in range(1000)] + [(2, t, "user", str(t)) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    (r,) = chat_format.chat_format(df).collect()
    assert (r["conv_id"], r["n_turns"]) == (1, 1000) and r["rendered"].count("<|im_end|>") == 1000
    assert chat_format.chat_format(df.where("false")).count() == 0


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat_format.chat_format(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_dedup(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "A", "a ", "ä", "x" * 200_000]
    rows = [(k if k % 9 else None, rng.choice(texts)) for k in range(400)] + [(7, "twice"), (7, "twice"), (8, "twice")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(7)
    block, exact_dedup.BLOCK = exact_dedup.BLOCK, 3
    try:
        got = exact_dedup.exact_dedup(df, slots=8).collect()
    finally:
        exact_dedup.BLOCK = block
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        t = next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r["digest"]))
        assert r["group_size"] == len(groups[t])
        assert r["keep_id"] == max((i for i in groups[t] if i is not None), default=None)
    for t in groups:
        assert sum(r["kept"] for r in got if bytes(r["digest"]) == hashlib.sha256(t.encode()).digest()) == 1


def test_runs_merge_by_brute_force():
    rng = np.random.default_rng(1)

    def run(n):
        key = np.sort(rng.choice([bytes([x, 0]) + bytes([y]) * 42 for x in range(4) for y in range(3)], n).astype(f"S{exact_dedup.KEY_BYTES}"))
        return exact_dedup.Run(key, rng.integers(0, 2, n).astype(np.int8), rng.integers(0, 5, n), rng.permutation(1000)[:n], rng.integers(1, 4, n))

    for n, m in ((0, 3), (1, 1), (20, 9), (40, 40), (3, 60)):
        a, b = run(n), run(m)
        got = exact_dedup.merged(exact_dedup.distinct(a), exact_dedup.distinct(b))
        rows = [tuple(x) for r in (a, b) for x in zip(r.key.tolist(), *(c.tolist() for c in r.columns), strict=True)]
        want = []
        for k in sorted({r[0] for r in rows}):
            same = [r for r in rows if r[0] == k]
            best = max(same, key=lambda r: r[1:4])
            want.append((k, *best[1:4], sum(r[4] for r in same)))
        assert [tuple(x) for x in zip(got.key.tolist(), *(c.tolist() for c in got.columns), strict=True)] == want


def test_without_copies_keeps_one_row_and_all_columns(spark):
    rows = [(1, "a", "en", "s", 1), (2, "a", "fr", "s", 1), (3, "b", "en", "s", 1), (3, "b", "en", "s", 1), (None, None, None, None, None), (None, "", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    clash = {n: exact_dedup.F.lit(f"own {n}") for n in ("id", "digest", "__d", "__id", "__n", "own_digest", "Keep_ID", "keep_digest", "_keep_digest", "place", "row", "slot")}
    df = df.withColumns(clash)
    got = exact_dedup.without_copies(df)
    assert got.columns == df.columns
    assert all(r[n] == f"own {n}" for r in got.collect() for n in clash)
    assert sorted((r["doc_id"] or -1, r["lang"]) for r in got.where("text <> ''").collect()) == [(2, "fr"), (3, "en")]
    assert got.where("coalesce(text, '') = ''").count() == 1
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0
