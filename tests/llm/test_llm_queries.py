"""The registered queries, and the pipeline."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests", "llm")]

import corpus_pipeline  # noqa: E402
from lodesieve.llm import queries  # noqa: E402
from test_llm_models import shingles  # noqa: E402


def test_one_query_for_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, compare, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_pipeline_by_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), [set(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = corpus_pipeline.saved(out, name)
        kept.append({r["doc_id"] for r in docs.collect()})
        assert docs.count() == len(kept[-1]) and kept[-1] <= kept[-2]
    assert all(any(c.isalpha() for c in rows[i]["text"] or "") for i in kept[1])
    assert len(kept[1]) >= 0.99 * len(kept[0])
    assert kept[2] == set({rows[i]["text"]: i for i in sorted(kept[1])}.values())
    ids = sorted(kept[2])
    sets = {i: shingles(rows[i]["text"]) for i in ids}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert kept[3] == {root(i) for i in ids}
    assert kept[4] == {i for i in kept[3] if not any(p in rows[i]["text"] for p in items)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in last} == kept[4]
