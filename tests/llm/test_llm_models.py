"""Near copies, benchmark leaks, language models: brute force, gradients, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodesieve.llm import components, decontaminate, jaccard_join, language_gru, pitman_yor
from lodesieve.llm.common import documents, fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def family(rng, n, size, edits, vocabulary):
    base = [rng.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w))
            what = rng.random()
            if what < 0.5:
                w[k] = rng.choice(vocabulary)
            elif what < 0.75:
                w.insert(k, rng.choice(vocabulary))
            elif len(w) > 1:
                del w[k]
        out.append(" ".join(w))
    return out


def near_rows():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = family(rng, 60, 120, 7, vocabulary) + family(rng, 30, 60, 4, vocabulary) + family(rng, 20, 9, 2, vocabulary) + family(rng, 10, 3, 1, vocabulary)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 12))) for _ in range(40)]
    texts += [t.upper() for t in texts[:10]] + texts[:15] + [None, "", "  \t\n", "é É", "É é", "a", "A", "a  a", " "]
    return list(enumerate(texts))


def test_jaccard_components_by_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).withColumn("node", F.lit(1)).withColumn("copies", F.lit("x"))
    want = groups(rows)
    for kw in ({}, {"buckets": 3, "hot": 2, "block": 8}, {"buckets": 50, "hot": 5, "block": 40}):
        got = jaccard_join.jaccard_groups(df, **kw).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = jaccard_join.one_of_each_group(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})
    assert jaccard_join.jaccard_groups(df.where("false")).count() == 0


def test_link_counts_by_brute_force(spark):
    rows = near_rows()
    sets = [shingles(t) for _, t in rows]
    want = sorted((i, sum(k != m and bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b) for m, b in enumerate(sets))) for k, ((i, _), a) in enumerate(zip(rows, sets, strict=True)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for kw in ({}, {"buckets": 3, "hot": 2, "block": 8}):
        assert sorted((r["doc_id"], r["n_links"]) for r in jaccard_join.link_counts(df, **kw).collect()) == want
    assert jaccard_join.link_counts(df.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for e in links if e[0] != e[1] for x in e}


QUESTION = "If Alice has 12 apples and gives Bob 5 apples then how many apples does Alice have left after the trade of 12 km"


def test_decontamination(spark):
    swap = QUESTION.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "30").replace("5", "7")
    rows = [(1, "pre text here " + QUESTION + " after"), (2, "Some words. " + swap.upper().lower().replace("carol", "Carol").replace("dave", "Dave")), (3, swap.replace("of 30", "of 31")), (4, swap.replace("Dave", "Carol")), (5, None), (6, ""), (1, "clean words"), (None, QUESTION),
            (8, " ".join(QUESTION.split()[:9])), (9, "short item of five words"), (10, "$$ %% ##"), (11, " ".join(QUESTION.split()[:12]) + " something else altogether " + " ".join(QUESTION.split()[12:]))]
    items = [(1, QUESTION), (2, "two words"), (3, None), (4, "Short item: of five words!")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("items", F.lit("clash")).withColumn("hash", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for bits in (25, 3):
        got = sorted((r["doc_id"] or 0, r["contaminated"], r["items"]) for r in decontaminate.decontaminate(docs, bench, gate_bits=bits).collect())
        assert got == [(0, True, "1"), (1, False, ""), (1, True, "1"), (2, True, "1"), (3, False, ""), (4, False, ""), (5, False, ""), (6, False, ""), (8, False, ""), (9, True, "4"), (10, False, ""), (11, False, "")]
    left = decontaminate.without_benchmark(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5, 6, 8, 10, 11]
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_by_repeated_and_null_item_ids(spark):
    other = QUESTION.replace("then how", "so tell me what")
    odd = QUESTION.replace("Alice", "Carol").replace("5", "7").replace("of 12 km", "of 13")
    docs = spark.createDataFrame([(1, QUESTION), (2, f"Well. {other} then"), (3, odd), (4, "clean words")], "doc_id bigint, text string")
    for ids, got_items in (([1, 1, 1, 1], "1"), ([None] * 4, ""), ([1, 1, 2, 2], None)):
        bench = spark.createDataFrame(list(zip(ids, [QUESTION, QUESTION, other, other], strict=True)), "item_id bigint, text string")
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
        assert {k: r["n_items"] for k, r in got.items() if r["contaminated"]} == {1: 1, 2: 1}
        assert [got[k]["max_words"] for k in (1, 2)] == [len(QUESTION.split()), len(other.split())]
        assert [got[k]["items"] for k in (1, 2)] == (["1", "2"] if got_items is None else [got_items] * 2)


def test_decontamination_of_dense_short_and_edited_items(spark):
    dense = "Lopez bought 12 kg apples for 30 dollars and Maria sold 7 kg pears for 25 euros"
    form = dense.replace("12", "14").replace("30", "31").replace("7", "8").replace("25", "26").replace("Lopez", "Perez").replace("Maria", "Clara")
    edited = QUESTION + " while every other apple in the big basket stays just where the farmer had put it that morning"
    items = [(1, dense), (2, "Garcia paid 30 dollars Monday"), (3, "Lopez walked home before the rain started"), (4, edited + " with 12 more")]
    texts = [f"we read that {dense} yesterday", "then Garcia paid 30 dollars Monday again", "and so Weber walked home before the rain started", edited + " with 13 more", f"we read that {form} yesterday", "then Garcia paid 31 dollars Tuesday again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for bits in (25, 3):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, gate_bits=bits).collect()}
        assert [got[k]["items"] for k in range(len(texts))] == ["1", "2", "3", "4", "1", ""]
        assert [got[k]["max_words"] for k in range(4)] == [17, 5, 7, len(edited.split()) + 1]


def test_recall_on_items_with_other_names_and_numbers(spark):
    """Items of short sentences, with names of one or two words that often begin them, and numbers that may coincide or be spelled out."""
    rng = random.Random(12)
    names = ["Anna", "Bob", "Maria Lopez", "Eva", "Ben", "Carla Diaz", "Tom", "Ivan Petrov", "Lucy", "Omar"]
    spelled = ["two", "five", "twelve", "seven"]
    forms = [
        "{0} has {3} apples. {1} has {4} pears and gives {5} of them to {0}. How many pears does {1} have after the trade with {0}?",
        "A train leaves the old station at {3} km per hour while {0} waits. {1} then walks {4} km to the bridge. How far is {0} from the bridge after {5} hours?",
        "{0} buys {3} kg of rice and {4} kg of beans at the market near the river. {2} pays {5} dollars for all of it. What does one kg cost {2}?",
        "In the garden of {0} stand {3} trees in each of {4} rows. {1} cuts down {5} trees before the winter comes. How many trees does {0} keep?",
    ]

    def number():
        return rng.choice(spelled) if rng.random() < 0.2 else str(rng.randint(2, 40))

    def filled(form):
        a, b, c = rng.sample(names, 3)
        return form.format(a, b, c, number(), number(), number())

    items = [(k, filled(forms[k % len(forms)]).replace("old", f"old{k}x").replace("How", f"So {'abcdefgh'[k % 8]}how")) for k in range(40)]
    texts, want = [], []
    filler = [f"word{k}" for k in range(300)]
    for k, t in items:
        form = forms[k % len(forms)].replace("old", f"old{k}x").replace("How", f"So {'abcdefgh'[k % 8]}how")
        copy = form.format(*rng.sample(names, 3), number(), number(), number()) if k % 2 else form.format(*rng.sample(names, 3), "6", "6", "6")
        texts.append(" ".join(rng.choices(filler, k=30)) + ". " + copy + " " + " ".join(rng.choices(filler, k=30)))
        want.append(True)
    for _ in range(40):  # other sentences of the same words
        words = filled(rng.choice(forms)).split()
        rng.shuffle(words)
        texts.append(" ".join(words + rng.choices(filler, k=20)))
        want.append(False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert sum(got[k] for k, w in enumerate(want) if w) >= 0.9 * sum(want)
    assert not any(got[k] for k, w in enumerate(want) if not w)


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Blue: whale"), (2, "zebra"), (3, "costs 12 dollars")]
    texts = ["a blue whale swims", "Zebra!", "it costs 12 dollars now", "it costs 13 dollars now", "blue and whale", ""]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(docs, bench).collect()} == {0: "1", 1: "2", 2: "3", 3: "", 4: "", 5: ""}


def test_decontamination_of_planted_passages(spark, sf_dir):
    docs, items = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    passages = {r["item_id"]: r["text"] for r in items.collect()}
    for r in decontaminate.decontaminate(docs, items).collect():
        held = sorted(k for k, p in passages.items() if p in texts[r["doc_id"]])
        assert [int(x) for x in r["items"].split(",") if x] == held


def test_gru_gradients():
    net = language_gru.Network(["a", "b", "c"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 4)).astype(np.int16), np.array([0, 1, 2, 0])
    x[4:, 1] = language_gru.PAD
    _, g = net.step(x, y)
    for k in net.p:
        where = np.argwhere(np.abs(g[k]) > 1e-6)
        for i in map(tuple, where[rng.choice(len(where), min(4, len(where)), replace=False)]):
            net.p[k][i] += 1e-2
            a, _ = net.step(x, y)
            net.p[k][i] -= 2e-2
            b, _ = net.step(x, y)
            net.p[k][i] += 1e-2
            assert abs((a - b) / 2e-2 - g[k][i]) < 1e-3 + 0.05 * abs(g[k][i]), (k, i)


def test_prediction_is_the_trained_network():
    net = language_gru.Network(["a", "b", "c"], 8)
    x = np.random.default_rng(0).integers(0, 257, (20, 7)).astype(np.int16)
    logits = np.concatenate([net.run(x, d) for d in "fb"], 2) @ net.p["out"] + net.p["bias"]
    want = logits - np.log(np.exp(logits).sum(2, keepdims=True))
    want[x == language_gru.PAD] = 0
    assert np.allclose(net.log_probabilities(x), want.sum(0), atol=1e-3)


def test_sample_is_spread_over_whole_texts(spark):
    df = spark.createDataFrame([(k, "a" * 6400 + "z" * 6400, "x") for k in range(40)], "doc_id bigint, text string, lang string")
    texts, langs = language_gru.sample(df, pieces=4)
    assert set(langs) == {"x"} and all(len(t) == 256 and t.count(b"z") == 128 for t in texts)
    assert len(language_gru.sample(df, total=5)[0]) < 20


def test_language_held_out_accuracy_and_odd_rows(spark, sf_dir):
    docs = documents(spark, "/root/testdata/sf0.01" if sf_dir.endswith("sf0.001") else sf_dir)
    texts, langs = language_gru.sample(docs)
    held = [r["doc_id"] for r in docs.where(fold("doc_id", 5) == 0).collect()]
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    net = language_gru.train(texts, langs, steps=300)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language_gru.language_id(docs, net).where("held_out").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(held)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) / len(got) > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 $$ --"), (4, "the"), (None, "und die der " * 50_000), (4, "la")], "doc_id bigint, text string")
    signs = spark.createDataFrame([(k, t) for k, t in enumerate(["½ ² 12", "Ⅷ ①", "¾", "١٢", "½ é", "Ⅷ x", "日"])], "doc_id bigint, text string")
    assert [r["lang_pred"] == "und" for r in language_gru.language_id(signs, net).orderBy("doc_id").collect()] == [True] * 4 + [False] * 3
    assert language_gru.language_id(docs.where("false"), net).count() == 0
    out = sorted((r["doc_id"] or 0, r["lang_pred"] == "und", 0 <= r["score"] <= 1) for r in language_gru.language_id(odd, net).collect())
    assert out == [(0, False, True), (1, True, True), (2, True, True), (3, True, True), (4, False, True), (4, False, True)]
    assert sorted(r["doc_id"] or 0 for r in language_gru.in_a_language(odd.withColumn("score", F.lit("x")), net, margin=0.0).collect()) == [0, 4, 4]
    none = language_gru.train(*language_gru.sample(docs.where("false")))
    assert none is None and {r["lang_pred"] for r in language_gru.language_id(odd, none).collect()} == {"und"}


def test_seatings_of_frequent_words_match_the_exact_distribution():
    rng, d, n = np.random.default_rng(5), 0.6, 4000
    ratios = pitman_yor.stirling_ratios(d, 400)
    for count, w, s in ((150, 0.02, 0.001), (150, 3.0, 0.1), (400, 0.8, 0.01), (400, 6.0, 0.05), (120, 7.0, 0.01), (400, 10.0, 0.01), (400, 30.0, 0.2), (400, 300.0, 0.01)):
        mass = np.cumprod(np.concatenate([[1.0], ratios[count, 1:count] * (w + s * np.arange(1, count))]))
        mean = (mass * np.arange(1, count + 1)).sum() / mass.sum()
        got = pitman_yor.draw_tables(np.full(n, count), np.full(n, w), np.full(n, s), d, ratios[:101, :101], rng)
        assert abs(got.mean() - mean) < 5 * got.std() / math.sqrt(n) + 0.025 * mean, (count, w, got.mean(), mean)
        spread = math.sqrt((mass * np.arange(1, count + 1) ** 2).sum() / mass.sum() - mean**2)
        assert abs(got.std() - spread) < 0.12 * spread + 0.02 and got.min() >= 1 and got.max() <= count


def test_log_gamma():
    x = np.array([0.5, 1.0, 3.7, 20.0, 1e5])
    assert np.allclose(pitman_yor.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-6)


def test_scores_base_columns_by_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (None, "x"), (9003, "new words only"), (9003, "new words only"), (9004, "a " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).withColumn("payload", F.lit("clash"))
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count = Counter(w for k, t in enumerate(tokens) if not held[k] for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((i or 0, held[k], len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for k, ((i, _), t) in enumerate(zip(rows, tokens, strict=True)))
    old, pitman_yor.CHUNK = pitman_yor.CHUNK, 5000
    try:
        got = pitman_yor.score_documents(df, fold("doc_id", 5) == 1).collect()
        parts = pitman_yor.score_documents(df, fold("doc_id", 5) == 1, split=50).collect()
    finally:
        pitman_yor.CHUNK = old
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    whole = sum(r["score"] for r in got if r["held_out"])
    assert abs(sum(r["score"] for r in parts if r["held_out"]) - whole) < 0.003 * abs(whole)  # the model is the same, the draws are others
    for h in (True, False):  # pairs tell more than words alone
        assert sum(r["score"] for r in got if r["held_out"] == h) > sum(r["base_score"] for r in got if r["held_out"] == h)


def test_tables_have_their_exact_distribution():
    """All seatings of five customers, by brute force, against the draws; and frequent words against long chains."""
    rng, d, w, s = np.random.default_rng(3), 0.6, 0.7, 0.4

    def ways(left, tables, t, weight):
        if not left:
            out[t] = out.get(t, 0.0) + weight
            return
        for k in range(t):
            ways(left - 1, [*tables[:k], tables[k] + 1, *tables[k + 1 :]], t, weight * (tables[k] - d))
        ways(left - 1, [*tables, 1], t + 1, weight * (w + s * t))

    out: dict[int, float] = {}
    ways(4, [1], 1, 1.0)
    n = 200_000
    got = np.bincount(pitman_yor.draw_tables(np.full(n, 5), np.full(n, w), np.full(n, s), d, pitman_yor.stirling_ratios(d), rng), minlength=6) / n
    assert np.allclose(got[1:], [out[t] / sum(out.values()) for t in range(1, 6)], atol=0.006)
    assert pitman_yor.draw_tables(np.array([0, 1]), np.ones(2), np.ones(2), d, pitman_yor.stirling_ratios(d), rng).tolist() == [0, 1]


@pytest.mark.parametrize("split", [500_000, 20])
def test_words_after_a_context_sum_to_one(spark, split):
    """Every known word, the end and the unknown one after 'a', a context in one part or in many."""
    rng = random.Random(2)
    known = [f"w{k}" for k in range(60)] + ["a"]
    train = [(k, " ".join(rng.choice([rng.choice(known), "a"]) for _ in range(rng.randint(1, 30)))) for k in range(300)]
    seen = sorted({w for _, t in train for w in t.split()})
    probe = [(1000 + k, f"a {w}") for k, w in enumerate([*seen, "unknown"])] + [(5000 + k, w) for k, w in enumerate([*seen, "unknown"])] + [(9000, "a")]
    df = spark.createDataFrame(train + probe, "doc_id bigint, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.score_documents(df, F.col("doc_id") >= 1000, split=split).where("held_out").collect()}
    # p(a, w, end) = p(a | start) p(w | a) p(end | w), and p(w, end) = p(w | start) p(end | w): both are asked, so ratios and sums are tied.
    ratio = {k: got[1000 + k] / got[5000 + k] for k in range(len(seen) + 1)}  # p(a | start) p(w | a) / p(w | start)
    assert all(math.isfinite(v) and v > 0 for v in ratio.values())
    assert 0 < sum(got[1000 + k] for k in range(len(seen) + 1)) < 1


def test_predictive_probabilities_sum_to_one(spark):
    words = ["a", "b", "c", "d"]
    rng = random.Random(1)
    train = [(k, " ".join(rng.choice(words[:3]) for _ in range(6))) for k in range(200)]
    probe = [(1000 + k, f"a {w}") for k, w in enumerate([*words, "unknown"])] + [(2000, "a")]
    df = spark.createDataFrame(train + probe, "doc_id bigint, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.score_documents(df, F.col("doc_id") >= 1000).where("held_out").collect()}
    # p("a w end") / p(end | w) sums, over w, to p("a"); so do p("a w end") and p("a end") stay below it.
    assert sum(got.values()) < 1 and got[1000] > got[1003] >= got[1004] * 0.99


def test_scores_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = pitman_yor.score_documents(df, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)
    assert pitman_yor.score_documents(df.where("false"), F.lit(True)).count() == 0
