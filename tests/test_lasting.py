"""The verdict store, streams with state, exact sinks, changing rules, many rules, limits over trees, references in order."""

import random

import pytest
from pyspark.sql import functions as F

from lodesieve.functions.running import running_sums
from lodesieve.operators import attachments, extraction, scan
from lodesieve.sources.config import Config
from lodesieve.sources.rules import Rule
from lodesieve.sources.shared import new_path
from lodesieve.sources.store import Busy, Store, newest
from lodesieve.sources.versions import FindingsSink, Versions
from lodesieve.streaming import requests, ttl

NEW = "key string, scope string, rules array<string>, artifact binary, artifact_digest string, size bigint, generation int"


def new(spark, keys, generation, artifact=None):
    return spark.createDataFrame([(k, k.split(":")[0], ["r"], artifact, None, None, generation) for k in keys], NEW)


def files(spark, store):
    jvm = spark._jvm
    out = {}
    for d in store.fs.listStatus(store._path("verdicts")):
        if d.isDirectory():
            out[d.getPath().getName()] = sorted(f.getPath().getName() for f in store.fs.listStatus(jvm.org.apache.hadoop.fs.Path(d.getPath().toString())))
    return out


def keys(store):
    return {r["key"]: r["expires"] for r in store.read().collect()}


def test_store_over_generations(spark):
    s = Store(spark, new_path(spark, "store"), Config(ttl_secs=100), buckets=8)
    a, b = "a" * 64, "b" * 64
    s.put(new(spark, [f"{a}:{k}" for k in range(20)] + [f"{b}:x"], 0), 1000)
    before = files(spark, s)
    assert len(keys(s)) == 21 and set(keys(s).values()) == {1100}
    s.refresh(spark.createDataFrame([(f"{b}:x",), (f"{b}:x",), ("none",), (None,)], "key string"), 1060)
    after = files(spark, s)
    changed = [d for d in before if before[d] != after[d]]
    assert len(changed) == 1 and keys(s)[f"{b}:x"] == 1160  # all other ranges keep their files
    s.refresh(spark.createDataFrame([(f"{b}:x",)], "key string"), 1061)
    assert files(spark, s) == after  # too early to prolong
    assert s.purge_scope(b) == 1 and f"{b}:x" not in keys(s) and len(keys(s)) == 20
    s.put(new(spark, [f"{b}:x", f"{b}:y"], 0), 1070)
    assert len(keys(s)) == 20  # begun before the purge
    s.put(new(spark, [f"{b}:x"], 1), 1070)
    assert keys(s)[f"{b}:x"] == 1170
    s.sweep(1100)
    assert set(keys(s)) == {f"{b}:x"}
    with pytest.raises(ValueError):
        s.purge_scope("x")
    again = Store(spark, s.path, s.config, buckets=8)  # another process finds the same
    assert again.generation() == 1 and keys(again) == keys(s)
    hit = again.lookup(spark.createDataFrame([(f"{b}:x",), ("no",)], "key string"), 1100)
    assert {r["key"]: r["hit"] for r in hit.collect()} == {f"{b}:x": True, "no": False}
    assert again.purge() == 2 and keys(again) == {} and again.generations() == [2]


def test_store_has_one_writer_and_limits(spark):
    s = Store(spark, new_path(spark, "store"), Config(ttl_secs=1000, max_rows=3, max_artifacts=10, max_artifact=6), buckets=4)
    with s.writing(), pytest.raises(Busy):
        s.sweep(0)
    s.put(new(spark, ["s:1", "s:2"], 0), 10)
    s.put(new(spark, ["s:3", "s:4"], 0), 20)
    assert set(keys(s)) == {"s:1", "s:3", "s:4"}  # the last used ones, ties by key
    s.put(new(spark, ["s:5"], 0, bytearray(b"1234567")), 30)
    assert "s:5" not in keys(s)  # too large
    with_digest = lambda k, n: new(spark, [k], 0, bytearray(b"x" * n)).withColumn("artifact_digest", F.sha2("artifact", 256))
    s.put(with_digest("s:6", 6), 40)
    s.put(with_digest("s:7", 6), 50)
    assert "s:7" in keys(s) and "s:6" not in keys(s)  # the bytes of both are too many
    v = spark.createDataFrame([(f"k{k}", k // 3) for k in range(10)], "key string, accessed bigint")
    assert sorted(r["key"] for r in newest(v, 5).collect()) == ["k3", "k6", "k7", "k8", "k9"]


def lived(events, life):
    """By a loop: key, time, what, n."""
    slack, ends, out = ttl.slack_of(life), {}, []
    for time, key in sorted(events):
        if key in ends and ends[key] <= time:
            out.append((key, ends.pop(key), "expired"))
        if key not in ends:
            what, ends[key] = "miss", time + life
        elif ends[key] - time < life - slack:
            what, ends[key] = "refresh", time + life
        else:
            what = "hit"
        out.append((key, time, what))
    return out + [(k, e, "expired") for k, e in ends.items() if e <= max(t for t, _ in events)]


def test_verdicts_of_a_stream_in_several_batches(spark):
    rng, source = random.Random(2), new_path(spark, "in")
    events = [(1000 + 7 * k + rng.randrange(7), rng.choice("aaabcd")) for k in range(120)] + [(1300, "a")] * 5
    events.sort()
    out, state = new_path(spark, "out"), new_path(spark, "state")
    for at in range(0, len(events), 50):
        rows = [(None if k == "d" else k, t) for t, k in events[at : at + 50]]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "key string, t bigint").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, t bigint").parquet(source)
        ttl.verdicts(stream, "key", "t", 60, "300 seconds").writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    got = {}
    for r in spark.read.schema(ttl.OUT).parquet(out).collect():
        got[r["key"], r["time"], r["what"]] = got.get((r["key"], r["time"], r["what"]), 0) + r["n"]
    want = {}
    for x in lived([e for e in events if e[1] != "d"], 60):
        want[x] = want.get(x, 0) + 1
    late = max(t for t, _ in events) - 300  # timers follow the watermark
    assert {k: n for k, n in want.items() if k[2] != "expired" or k[1] <= late or k in got} == got


def test_a_lost_batch_runs_again_without_double_rows(spark):
    source, out, state = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "state")
    sink = requests.Sink(out, Config(), [Rule("r", "k=[0-9]{4}", ("k=",))])
    calls = []

    def failing(batch, number):
        calls.append(number)
        if calls == [0, 1]:
            batch.sparkSession.createDataFrame([("left",)], "request_id string").write.parquet(f"{out}/decisions/batch=1")  # a part of a batch, as a lost driver leaves it
            raise RuntimeError("lost")
        sink(batch, number)

    for part in (0, 1):
        rows = [(f"{part}-{k}", '{"a":"k=%04d"}' % k if k % 2 else '{"a":"x"}') for k in range(6)]
        spark.createDataFrame(rows, "request_id string, body string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("request_id string, body string").parquet(source)
        if part:
            with pytest.raises(Exception, match="lost"):
                requests.run_once(stream, failing, state)
            assert requests.table(spark, out, "decisions").count() == 6  # half a batch is not seen
        requests.run_once(stream, failing, state)
    assert calls == [0, 1, 1]
    assert sorted(r["request_id"] for r in requests.table(spark, out, "decisions").collect()) == sorted(f"{p}-{k}" for p in (0, 1) for k in range(6))
    assert sorted(r["request_id"] for r in requests.table(spark, out, "findings").collect()) == sorted(f"{p}-{k}" for p in (0, 1) for k in (1, 3, 5))
    assert all("[REDACTED:r]" in r["body"] for r in requests.table(spark, out, "approved").where("decision = 'sanitized'").collect())
    assert requests.table(spark, new_path(spark, "none"), "findings").count() == 0


def test_rules_change_while_a_stream_runs(spark):
    source, out, state = new_path(spark, "in"), new_path(spark, "out"), new_path(spark, "state")
    v = Versions(spark, new_path(spark, "rules"))
    with pytest.raises(ValueError):
        v.current()
    old, sound = [Rule("a", "a=([0-9]+)", ("a=",), 0.0, 1)], [Rule("b", "b=[0-9]+")]
    v.publish(old)
    sink = FindingsSink(v, out, ["id"], "text")
    faulty = ([Rule("x", "(((")], [Rule("x", "a"), Rule("x", "b")], [], [Rule("x", "a", (), 0.0, 2)])
    for step in range(3):
        spark.createDataFrame([(step, "a=12 b=34")], "id int, text string").coalesce(1).write.mode("append").parquet(source)
        requests.run_once(spark.readStream.schema("id int, text string").parquet(source), sink, state)
        if step == 0:
            for rules in faulty:
                v.publish(rules)
        elif step == 1:
            v.publish(sound)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out).orderBy("id").collect()
    assert [(r["id"], r["rule"], r["start"], r["version"]) for r in rows] == [(0, "a", 2, 1), (1, "a", 2, 1), (2, "b", 5, 6)]
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] != rows[2]["fingerprint"] and set(v.refused()) == {2, 3, 4, 5}


def test_many_rules_find_what_each_alone_finds(spark):
    import re

    rng = random.Random(6)
    words = ["sk-", "sk-ant", "sk-ant-api", "tok", "token", "k.y", "a+b", "é=", "_x", "x_"] + [f"w{k:02d}{'ab' * (k % 3)}" for k in range(80)]
    rules = [Rule(f"r{k}", re.escape(w).replace("\\-", "-") + r"[ :]?([0-9]{3,5})(?![0-9])", (w.upper(),)) for k, w in enumerate(words)] + [Rule("free", r"zz[0-9]+")]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ":", " "]) + str(rng.randrange(99_999)) for _ in range(12)) + rng.choice([" zz9", ""]) for _ in range(25)] + ["", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: {(f["rule"], f["start"], f["secret"]) for f in r["f"]} for r in df.select("id", scan.scan(F.col("text"), rules).alias("f")).collect()}
    for k, t in enumerate(texts):
        want = set()
        for r in rules:
            for m in re.finditer(r.regex, t):
                g = 1 if m.re.groups else 0
                want.add((r.id, len(t[: m.start(g)].encode()), m.group(g)))
        assert got[k] == want
    low = "sk-ant-api w00 tokenx"
    assert set(spark.range(1).select(scan.words_in(F.lit(low), sorted(words)).alias("w")).first()["w"]) == {w for w in words if w in low}


def test_limits_over_trees(spark):
    big = 1 << 20
    items = [(k, None if k == 1 else k - 1, "file", 1, 0, 0, 0) for k in range(1, 8)]  # nested too deep: item 6 is the fifth below the root
    items += [(100, None, "file", 0, 0, 0, 0), *[(100 + k, 100, "file", 1, 0, 0, 0) for k in range(1, 19)]]
    items += [(200, None, "file", 0, 0, 0, 0), *[(200 + k, 200, "page", 0, 5000, 5000, 0) for k in range(1, 6)]]  # 25 million each: the fifth is too much in all
    items += [(300, None, "file", 0, 0, 0, 0), (301, 300, "page", 0, 5001, 5000, 0), (400, None, "file", 0, 0, 0, 0), (401, 400, "tool", 17 * big, 0, 0, 0)]
    items += [(500, None, "file", 0, 0, 0, 0), *[(500 + k, 500, "frame", 0, 1, 1, 0) for k in range(1, 18)], (600, None, "file", 0, 0, 0, 0), (601, 600, "page", 0, 1, 1, 0), *[(601 + k, 601, "image", 0, 1, 1, 0) for k in range(1, 18)]]
    items += [(700, None, "file", 0, 0, 0, 0), *[(700 + k, 700, "page", 0, 1, 1, 0) for k in range(1, 22)], (800, None, "file", 0, 0, 0, 5 * big), (801, 800, "file", 60 * big, 0, 0, 3 * big), (802, 801, "file", 5 * big, 0, 0, 0)]
    items += [(900, None, "file", 0, 0, 0, 5 * big), (901, 900, "page", 0, None, None, 4 * big), (950, 951, "file", 0, 0, 0, 0), (951, 950, "file", 0, 0, 0, 0), (990, 989, "file", 1, 0, 0, 0)]
    df = spark.createDataFrame(items, "item bigint, parent bigint, kind string, bytes bigint, width bigint, height bigint, text_bytes bigint").repartition(3)
    got = {r["root"]: (r["error_item"], r["error"]) for r in extraction.nested_limits(df).collect()}
    assert got == {1: (6, "depth_limit"), 100: (117, "embedded_files_limit"), 200: (205, "pixels_limit"), 300: (301, "image_pixels_limit"), 400: (401, "tool_output_limit"), 500: (517, "frames_limit"), 600: (618, "page_images_limit"),
                   700: (721, "pages_limit"), 800: (802, "embedded_bytes_limit"), 900: (901, "text_limit"), 950: (950, "depth_limit"), 951: (951, "depth_limit"), 990: (None, None)}
    assert extraction.nested_limits(df.where("false")).count() == 0


def test_limits_over_repeated_items(spark):
    """Rows of one id count together: five images, each with itself five times over, are more than 16 before the size of any is looked at."""
    items = [(1, None, "file", 0, 0), (2, 1, "page", 1, 1), *[(3, 2, "image", 6000, 5000)] * 5]
    df = spark.createDataFrame([(i, p, k, 0, w, h, 0) for i, p, k, w, h in items], "item bigint, parent bigint, kind string, bytes bigint, width bigint, height bigint, text_bytes bigint").repartition(3)
    assert [tuple(r) for r in extraction.nested_limits(df).select("root", "items", "error_item", "error").collect()] == [(1, 27, 3, "page_images_limit")]


def test_running_sums_of_peers(spark):
    """As with a RANGE frame, also where equal rows lie in several blocks; keys and order may be null, values negative."""
    rng = random.Random(9)
    rows = [(k, rng.choice([None, 1, 2, 3, 3]), rng.choice([None, 7, 7, 7, 7, 7, 8, 9, -1]), rng.choice([None, 5, -3, 2])) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, k int, o int, v bigint").repartition(5)
    got = {r["id"]: r["s"] for r in running_sums(df, ["k"], ["o"], {"s": "v"}, peers=True).collect()}
    rank = lambda o: (o is not None, o or 0)
    assert got == {i: sum(v or 0 for _, k2, o2, v in rows if k2 == k and rank(o2) <= rank(o)) for i, k, o, _ in rows}


def test_references_in_order(spark):
    refs = [(1, k, *r) for k, r in enumerate([("url", "u"), ("file", "f"), ("url", "u"), ("file", "f"), ("url", "none"), ("url", "u")])] + [(2, k, "file", "f") for k in range(18)] + [(3, 0, "url", "u"), (3, 1, "url", "v"), (3, 2, "url", "u")]
    have = spark.createDataFrame([("url", "u", bytearray(5)), ("file", "f", bytearray(7)), ("url", "v", bytearray(90))], "kind string, ref string, content binary")
    rows = attachments.charged_in_order(spark.createDataFrame(refs, "request_id int, pos int, kind string, ref string"), have, total=80 + 7 * 16).orderBy("request_id", "pos").collect()
    of = lambda n: [(r["used"], r["used_bytes"], r["state"]) for r in rows if r["request_id"] == n]
    assert of(1) == [(1, 5, "read"), (2, 12, "read"), (2, 12, "known"), (3, 19, "read"), (4, 19, "unresolved_reference"), (4, 19, "unread")]
    assert [s for _, _, s in of(2)] == ["read"] * 16 + ["reference_limit", "unread"] and [s for _, _, s in of(3)] == ["read", "read", "known"]
