"""Verdicts, geometry, metrics and streams."""

import random

import pytest
from pyspark.sql import functions as F

from lodesieve.operators import geometry, metrics, verdicts
from lodesieve.streaming import inspect as streaming

V = "key string, scope string, expires bigint, accessed bigint, rules array<string>, artifact binary, artifact_digest string, size bigint"


def row(key, expires=100, accessed=0, artifact=None, digest=None, size=0):
    return (key, key.split(":")[0], expires, accessed, ["r"], artifact, digest, size)


def test_lookup_checks_time_and_artifact(spark):
    import hashlib

    ok = hashlib.sha256(b"x").hexdigest()
    v = spark.createDataFrame([row("a:1"), row("a:2", 10), row("a:3", artifact=bytearray(b"x"), digest=ok), row("a:4", artifact=bytearray(b"y"), digest=ok), row("a:5", digest=ok)], V)
    req = spark.createDataFrame([("a:1",), ("a:2",), ("a:3",), ("a:4",), ("a:5",), ("a:6",), ("a:6",)], "key string")
    got = sorted((r["key"], r["hit"]) for r in verdicts.lookup(req, v, 50).collect())
    assert got == [("a:1", True), ("a:2", False), ("a:3", True), ("a:4", False), ("a:5", False), ("a:6", False), ("a:6", False)]
    assert sorted(r["key"] for r in verdicts.misses(req, v, 50).collect()) == ["a:2", "a:4", "a:5", "a:6"]


def test_put_against_a_model(spark):
    rng, model, generation = random.Random(3), {}, 0
    v, captured = spark.createDataFrame([], V), 0
    for step in range(8):
        what = rng.choice(["purge", "insert", "capture"])
        if what == "purge":
            v, generation, model = spark.createDataFrame([], V), generation + 1, {}
        elif what == "capture":
            captured = generation
        else:
            v = verdicts.put(v, spark.createDataFrame([row(f"s:{step % 3}", accessed=step)], V).withColumn("generation", F.lit(captured)), generation)
            if captured == generation:
                model[f"s:{step % 3}"] = step
        assert {r["key"]: r["accessed"] for r in v.collect()} == model


def test_refresh_and_scope_purge(spark):
    v = spark.createDataFrame([row("a" * 64 + ":1", 1000 + 7200 - 3601), row("b" * 64 + ":1", 1000 + 7200 - 100)], V)
    got = {r["key"][0]: (r["expires"], r["accessed"]) for r in verdicts.refreshed(v, v.select("key"), 1000, 7200).collect()}
    assert got == {"a": (8200, 1000), "b": (8100, 0)}
    left, generation = verdicts.purged(v, "a" * 64, 4)
    assert [r["key"][0] for r in left.collect()] == ["b"] and generation == 5
    with pytest.raises(ValueError):
        verdicts.purged(v, "x", 1)


def test_greedy_bytes(spark):
    rows = [row("s:a", accessed=9, size=4), row("s:b", accessed=8, size=9), row("s:c", accessed=7, size=3), row("s:d", accessed=6, size=2), row("s:e", accessed=5, size=None)]
    kept = verdicts.within_bytes(spark.createDataFrame(rows, V), ["scope"], 10)
    assert sorted(r["key"] for r in kept.collect()) == ["s:a", "s:c", "s:d"]


def test_greedy_bytes_in_rounds(spark):
    """Many rows of few budgets, worked off in rounds and by folds, against the plain loop."""
    rng = random.Random(7)
    rows = [(f"{k:05d}", rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40), rng.choice([None, 0, 1, 2, 5, 9, 30, 70, 400])) for k in range(600)]
    want = []
    for scope in {r[1] for r in rows}:
        room = 300
        for key, _, _, size in sorted((r for r in rows if r[1] == scope), key=lambda r: (-r[2], r[0])):
            if size is not None and size <= room:
                room -= size
                want.append(key)
    v = spark.createDataFrame(rows, "key string, scope string, accessed bigint, size bigint")
    old = verdicts.FOLD
    try:
        for verdicts.FOLD in (10_000, 20):
            assert sorted(r["key"] for r in verdicts.within_bytes(v, ["scope"], 300).collect()) == sorted(want)
    finally:
        verdicts.FOLD = old


def test_purge_all(spark):
    v = spark.createDataFrame([row("a:1"), row("b:1")], V)
    left, generation = verdicts.purged_all(v, 3)
    assert left.count() == 0 and generation == 4 and left.columns == v.columns


def test_running_sums_and_ranks_of_hot_keys(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.randint(0, 9), rng.choice([None, 1.0, 2.5, rng.random()])) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, pos int, size bigint, ms double")
    got = {(r["key"], r["pos"]): (r["used"], r["error"]) for r in geometry.over_budget(df, "key", "pos", "size", 700).collect()}
    assert len(got) == len(rows)
    ranks = {r["key"]: (r["p50"], r["p95"], r["p100"]) for r in metrics.rank_percentiles(df, "ms", ["key"], {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for key in ("hot", "b", None):
        used, own = 0, [r for r in rows if r[0] == key]
        for r in sorted(own, key=lambda r: r[1]):
            used += r[2]
            assert got[key, r[1]] == (used, "extraction_limit" if used > 700 else None)
        values = sorted((r[3] for r in own), key=lambda x: (x is not None, x or 0))
        assert ranks[key] == tuple(values[min(int(share * len(values)) + 1, len(values)) - 1] for share in (0.5, 0.95, 1.0))


def test_page_redaction_and_selection(spark):
    f = [("d", 1, 1, "x", True), ("d", 2, 1, "x", False), ("d", 3, 1, "y", False), ("d", 4, None, "z", False), ("d", 5, 2, "x", False)]
    df = spark.createDataFrame(f, "doc string, segment int, page int, digest string, has_box boolean")
    assert sorted(r["page"] for r in geometry.unmapped_pages(df.where("page is not null"), "doc").collect()) == [1, 2]
    assert geometry.unmapped_pages(df.where("page is not null"), "doc", True).count() == 0
    assert sorted((r["segment"], r["whole_page"]) for r in geometry.selected(df, "doc", "segment").collect()) == [(1, False), (4, False)]
    assert sorted((r["segment"], r["whole_page"]) for r in geometry.selected(df, "doc", "segment", True).collect()) == [(1, False), (3, True), (4, False), (5, True)]


def test_boxes_keep_their_cover(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        sw, sh, tw, th = rng.randint(1, 5000), rng.randint(1, 5000), rng.randint(1, 10000), rng.randint(1, 10000)
        x1, y1 = rng.randint(0, sw), rng.randint(0, sh)
        rows.append((x1, y1, rng.randint(x1, sw), rng.randint(y1, sh), sw, sh, tw, th))
    df = spark.createDataFrame(rows, "x1 bigint, y1 bigint, x2 bigint, y2 bigint, sw bigint, sh bigint, tw bigint, th bigint")
    for old, new in zip(rows, geometry.scale_box(df, ("sw", "sh"), ("tw", "th")).collect(), strict=True):
        assert new["x1"] * old[4] <= old[0] * old[6] and new["x2"] * old[4] >= old[2] * old[6] and new["x2"] <= old[6]
    for turns in range(4):
        w, h = 30, 20
        page = (w, h) if turns % 2 == 0 else (h, w)
        df = spark.createDataFrame([(0, 0, *page, w, h, turns)], "x1 bigint, y1 bigint, x2 bigint, y2 bigint, w bigint, h bigint, t bigint")
        r = geometry.unrotate_box(df, "w", "h", "t").first()
        assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (0, 0, w, h)


def test_lines(spark):
    words = [(1, 1, 1, 1, 0, 5, 40, 10, "to"), (2, 1, 1, 1, 45, 4, 40, 12, "ken"), (3, 1, 1, 1, 120, 5, 30, 10, "x"), (4, 1, 1, 1, 0, 0, 9, 9, " "), (5, 1, 1, 2, 0, 0, 9, 9, "y")]
    df = spark.createDataFrame([(1, *w) for w in words], "page int, pos int, block_num int, par_num int, line_num int, left int, top int, width int, height int, text string")
    got = sorted((r["line_num"], r["text"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in geometry.lines(df, ["page"], "pos").collect())
    assert got == [(1, "token x", 0, 4, 150, 16), (2, "y", 0, 0, 9, 9)]


def test_metrics_text(spark):
    df = spark.createDataFrame([(200, 1, 0, 0), (409, 2, 1, 3)], "status int, findings bigint, cache_hits bigint, attachments bigint")
    lines = [r["line"] for r in metrics.rendered(metrics.counters(df), "p").collect()]
    assert lines[0] == "# TYPE p_requests_total counter\np_requests_total 2" and lines[1].endswith("p_rejected_total 1")
    h = {r["le"]: r["n"] for r in metrics.histogram(spark.createDataFrame([(5.0,), (5.1,), (1e9,)], "ms double"), F.col("ms")).collect()}
    assert (h["5"], h["10"], h["180000"], h["+Inf"]) == (1, 2, 2, 3)


def test_streams_first_seen(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=k), "r", "d" if k % 2 else f"e{k}") for k in range(6)]
    spark.createDataFrame(rows, "ts timestamp, rule string, digest string").write.parquet(str(tmp_path / "in"))
    stream = streaming.read(spark, str(tmp_path / "in"), "ts timestamp, rule string, digest string")
    streaming.run_once(streaming.first_seen(stream, "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["digest"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["d", "e0", "e2", "e4"]


def test_long_lists_of_allowed_digests_are_tables(spark, tmp_path, monkeypatch):
    import hashlib
    import json

    from lodesieve.sources import rules

    path = tmp_path / "carnet.json"
    path.write_text(json.dumps([hashlib.sha256(bytes([k])).hexdigest() for k in range(4)] * 2))
    assert len(rules.allowed(spark, str(path))) == 4
    monkeypatch.setattr(rules, "MOST_ALLOWED", 3)
    with pytest.raises(ValueError):
        rules.allowed(spark, str(path))
