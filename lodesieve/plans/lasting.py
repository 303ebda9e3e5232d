"""Registered queries of what lasts (the verdict store, streams with state, exact sinks and changing rules), and of limits over trees and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import attachments, extraction, scan
from ..sources.config import Config
from ..sources.rules import DEFAULT_RULES, Rule
from ..sources.shared import new_path, saved
from ..sources.store import Store
from ..sources.versions import FindingsSink, Versions
from ..streaming import requests, ttl
from .catalog import query, stream_paths, table

TTL, T0, T1, T2 = 7200, 1_000_000, 1_005_000, 1_008_000


@query(f"""WITH v AS (SELECT o_orderkey AS k, sha256('s' || o_custkey % 10) || ':' || sha256(o_orderkey::VARCHAR) AS key, o_custkey % 10 AS s FROM orders),
put AS (SELECT k, key, s, {T0 + TTL} AS expires, {T0} AS accessed FROM v WHERE k % 3 = 0),
used AS (SELECT k, key, s, CASE WHEN k % 5 = 0 THEN {T1 + TTL} ELSE expires END AS expires, CASE WHEN k % 5 = 0 THEN {T1} ELSE accessed END AS accessed FROM put
  UNION ALL SELECT k, key, s, {T1 + TTL}, {T1} FROM v WHERE k % 3 = 1),
purged AS (SELECT * FROM used WHERE s <> 3),
swept AS (SELECT * FROM purged WHERE expires > {T2} UNION ALL SELECT k, key, s, {T2 + TTL}, {T2} FROM v WHERE k % 3 = 2 AND k % 2 = 0)
SELECT 'put' AS step, key, expires, accessed FROM put UNION ALL SELECT 'used', key, expires, accessed FROM used
UNION ALL SELECT 'purged', key, expires, accessed FROM purged UNION ALL SELECT 'swept', key, expires, accessed FROM swept""")
def verdict_store(spark, sf_dir):
    """A store over two generations, read after each step: put; hits prolonged and more put; a scope purged, while inspections are under way whose verdicts then are not stored; what has expired swept."""
    k = F.col("o_orderkey")
    scope = F.sha2(F.concat(F.lit("s"), F.col("o_custkey") % 10), 256)
    v = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(scope, F.lit(":"), F.sha2(k.cast("string"), 256)).alias("key"), scope.alias("scope"), F.array(F.col("o_orderpriority")).alias("rules"), F.lit(None).cast("binary").alias("artifact"), F.lit(None).cast("string").alias("artifact_digest"), F.lit(None).cast("bigint").alias("size"))
    s = Store(spark, new_path(spark, "store"), Config(ttl_secs=TTL, max_rows=1 << 40), buckets=16)
    steps = []

    def read(step: str) -> None:
        steps.append(saved(s.read().select(F.lit(step).alias("step"), "key", "expires", "accessed"), f"store-{step}"))

    s.put(v.where("k % 3 = 0").withColumn("generation", F.lit(s.generation())), T0)
    read("put")
    s.refresh(v.where("k % 5 = 0").select("key"), T1)
    s.put(v.where("k % 3 = 1").withColumn("generation", F.lit(s.generation())), T1)
    read("used")
    before = s.generation()
    after = s.purge_scope(spark.range(1).select(F.sha2(F.lit("s3"), 256)).first()[0])
    read("purged")
    s.put(v.where("k % 3 = 2").withColumn("generation", F.when(F.col("k") % 2 == 0, after).otherwise(before)), T2)
    read("swept")
    return steps[0].unionByName(steps[1]).unionByName(steps[2]).unionByName(steps[3])


LIFE, SLACK = 7200, ttl.slack_of(7200)


@query(f"""WITH RECURSIVE d AS (SELECT sha256(coalesce(source, 'local')) || ':' || sha256(coalesce(lang, '') || '/' || n_chars % 7) AS key, 1000000 + doc_id * 60 AS t FROM documents),
e AS (SELECT key, t, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY t) AS r FROM d GROUP BY key, t),
f AS (SELECT key, r, t, n, t + {LIFE} AS expires, 'miss' AS what, NULL::BIGINT AS gone FROM e WHERE r = 1
  UNION ALL SELECT e.key, e.r, e.t, e.n, CASE WHEN f.expires <= e.t OR f.expires - e.t < {LIFE - SLACK} THEN e.t + {LIFE} ELSE f.expires END,
    CASE WHEN f.expires <= e.t THEN 'miss' WHEN f.expires - e.t < {LIFE - SLACK} THEN 'refresh' ELSE 'hit' END, CASE WHEN f.expires <= e.t THEN f.expires END FROM f JOIN e ON e.key = f.key AND e.r = f.r + 1),
last AS (SELECT key, max(expires) AS expires FROM f GROUP BY key)
SELECT key, t AS time, what, sum(n)::BIGINT AS n FROM (SELECT key, t, what, 1 AS n FROM f UNION ALL SELECT key, t, 'hit', n - 1 FROM f WHERE n > 1 UNION ALL SELECT key, gone, 'expired', 1 FROM f WHERE gone IS NOT NULL
  UNION ALL SELECT key, expires, 'expired', 1 FROM last WHERE expires <= (SELECT max(t) FROM d)) GROUP BY ALL""")
def stream_verdicts(spark, sf_dir):
    """Documents as requests, a minute apart: which find a verdict for their source and kind, which prolong it, which find none; and when verdicts end."""
    source = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(source.schema).load(f"{sf_dir}/documents.parquet*", format="parquet")
    kind = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), (F.col("n_chars") % 7).cast("string"))
    key = F.concat(F.sha2(F.coalesce("source", F.lit("local")), 256), F.lit(":"), F.sha2(kind, 256))
    out, state = stream_paths(spark)
    rows = ttl.verdicts(stream.select(key.alias("key"), (F.col("doc_id") * 60 + 1_000_000).alias("t")), "key", "t", LIFE)
    rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(ttl.OUT).parquet(out).groupBy("key", "time", "what").agg(F.sum("n").alias("n"))


@query("""WITH t AS (SELECT conv_id || '-' || turn AS request_id, turn % 4 AS k FROM conversations)
SELECT 'decisions' AS name, request_id, CASE k WHEN 0 THEN 'original' WHEN 3 THEN 'failed' ELSE 'sanitized' END || '/' || CASE k WHEN 3 THEN 400 ELSE 200 END AS what, count(*) AS n FROM t GROUP BY ALL
UNION ALL SELECT 'findings', request_id, 'github-pat', count(*) FROM t WHERE k IN (1, 2) GROUP BY ALL UNION ALL SELECT 'approved', request_id, CASE k WHEN 0 THEN 'original' ELSE 'sanitized' END, count(*) FROM t WHERE k < 3 GROUP BY ALL""")
def stream_requests(spark, sf_dir):
    """Turns as a stream of requests: clean ones, with secrets, and broken ones; decisions, findings and approved bodies, though a batch fails once and runs again."""
    source = table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(source.schema).load(f"{sf_dir}/conversations.parquet*", format="parquet")
    name = F.concat_ws("-", "conv_id", "turn")
    secret = F.concat(F.lit(" ghp_"), F.substring(F.sha2(name, 256), 1, 36))
    body = F.to_json(F.struct(F.concat(F.coalesce("text", F.lit("")), F.when((F.col("turn") % 4).isin(1, 2), secret).otherwise(F.lit(""))).alias("text")))
    rows = stream.select(name.alias("request_id"), F.when(F.col("turn") % 4 == 3, F.lit("{")).otherwise(body).alias("body"))
    out, state = stream_paths(spark)
    sink, tries = requests.Sink(out, Config(), [r for r in DEFAULT_RULES if r.id == "github-pat"]), []

    def failing(batch, number):
        tries.append(number)
        sink(batch, number)
        if len(tries) == 1:
            raise RuntimeError("lost after the batch was written")

    for _ in range(2):
        try:
            requests.run_once(rows, failing, state)
        except Exception:
            if len(tries) != 1:
                raise
    found = requests.table(spark, out, "decisions").select(F.lit("decisions").alias("name"), "request_id", F.concat_ws("/", "decision", "status").alias("what"))
    found = found.unionByName(requests.table(spark, out, "findings").select(F.lit("findings").alias("name"), "request_id", F.col("rule_id").alias("what")))
    found = found.unionByName(requests.table(spark, out, "approved").select(F.lit("approved").alias("name"), "request_id", F.col("decision").alias("what")))
    return found.groupBy("name", "request_id", "what").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, doc_id % 2 AS half, coalesce(text, '') || ' old_' || substr(sha256(doc_id::VARCHAR), 1, 20) || ' new_' || substr(sha256(doc_id::VARCHAR), 1, 24) AS text FROM documents)
SELECT doc_id, CASE half WHEN 0 THEN 'old' ELSE 'new' END AS rule, CASE half WHEN 0 THEN 1 ELSE 3 END AS version, count(*) AS n
FROM (SELECT doc_id, half, unnest(CASE half WHEN 0 THEN regexp_extract_all(text, 'old_[0-9a-f]{20}') ELSE regexp_extract_all(text, 'new_[0-9a-f]{24}') END) AS s FROM d) GROUP BY ALL""")
def stream_rule_versions(spark, sf_dir):
    """Documents in two batches: between them one version of the rules that is faulty, and so refused, and one that holds for the second."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" old_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 20), F.lit(" new_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24)).alias("text"))
    source, rules = new_path(spark, "stream-in"), Versions(spark, new_path(spark, "rules"))
    out, state = stream_paths(spark)
    rules.publish([Rule("old", "old_[0-9a-f]{20}", ("old_",))])
    sink = FindingsSink(rules, out, ["doc_id"], "text")
    for half in (0, 1):
        docs.where(F.col("doc_id") % 2 == half).write.mode("append").parquet(source)  # both halves are read, one after the other
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(source)
        requests.run_once(stream, sink, state)
        if half == 0:
            rules.publish([Rule("old", "old_[0-9a-f]{20}", ("old_",)), Rule("new", "new_[0-9a-f{24}", ("new_",))])
            rules.publish([Rule("new", "new_[0-9a-f]{24}", ("new_",))])
    found = spark.read.schema("doc_id bigint, rule string, start int, end int, digest string, version int, fingerprint string").option("recursiveFileLookup", "true").parquet(out)
    return found.groupBy("doc_id", "rule", "version").agg(F.count(F.lit(1)).alias("n"))


def many_rules() -> list[Rule]:
    """Two hundred rules with keywords of their own: digits of their numbers, spelled out."""
    digits = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
    return [Rule(f"r{k:03d}", f"{word}=[0-9a-f]{{{8 + k % 5}}}(?![0-9a-f])", (word,)) for k in range(200) for word in ["-".join(digits[int(c)] for c in f"{k:03d}")]]


@query("""WITH d AS (SELECT doc_id, array_to_string(list_transform(string_split(lpad((doc_id % 200)::VARCHAR, 3, '0'), ''), lambda c: ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][c::INT + 1]), '-') AS word, doc_id % 200 AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'r' || lpad(k::VARCHAR, 3, '0') AS rule, sha256(word || '=' || substr(sha256(doc_id::VARCHAR), 1, (8 + k % 5)::INT)) AS digest FROM d""")
def scan_many_rules(spark, sf_dir):
    """Documents, each with a secret of one of two hundred rules: the rules are a constant of the plan, and their keywords are looked for in one pass."""
    digits = F.split(F.lit("zero one two three four five six seven eight nine"), " ")
    k = F.col("doc_id") % 200
    word = F.array_join(F.transform(F.split(F.lpad(k.cast("string"), 3, "0"), ""), lambda c: F.get(digits, c.cast("int"))), "-")
    secret = F.concat(word, F.lit("="), F.sha2(F.col("doc_id").cast("string"), 256).substr(F.lit(1), (8 + k % 5).cast("int")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" "), secret).alias("text"))
    return scan.find(d, ["doc_id"], "text", many_rules()).select("doc_id", "rule", F.sha2("secret", 256).alias("digest"))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey * 10000000000 AS c, (o_orderkey + 1) * 16 AS place, lag((o_orderkey + 1) * 16) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, floor(o_totalprice)::BIGINT * 50 AS bytes FROM orders),
i AS MATERIALIZED (SELECT c_custkey * 10000000000 AS item, NULL::BIGINT AS parent, 'file' AS kind, 0::BIGINT AS bytes, 0::BIGINT AS area, 0::BIGINT AS text FROM customer
  UNION ALL SELECT c + place, c + CASE WHEN o_orderkey % 3 = 0 THEN coalesce(prev, 0) ELSE 0 END, 'file', bytes, 0, 0 FROM o
  UNION ALL SELECT c + place + l_linenumber, c + place, ['page', 'image', 'frame', 'tool'][(l_linenumber % 4)::INT + 1], (l_partkey % 20000) * 1000, CASE WHEN l_linenumber % 4 = 3 THEN 0 ELSE (l_partkey % 6000) * 5000 END, (l_suppkey % 1000) * 2000 FROM lineitem JOIN o ON l_orderkey = o_orderkey),
t AS (SELECT i.item, i.item AS root, 0 AS depth FROM i LEFT JOIN i AS h ON h.item = i.parent WHERE h.item IS NULL UNION ALL SELECT i.item, t.root, t.depth + (i.kind = 'file')::INT FROM i JOIN t ON i.parent = t.item),
w AS (SELECT i.*, t.root, t.depth, kind = 'file' AND i.item <> root AS emb, sum(text) OVER r AS st, sum(area) OVER r AS sa, sum((kind = 'file' AND i.item <> root)::INT) OVER r AS sf, sum(CASE WHEN kind = 'file' AND i.item <> root THEN bytes ELSE 0 END) OVER r AS sb,
  sum((kind = 'frame')::INT) OVER p AS nf, sum((kind = 'image')::INT) OVER p AS ni, sum((kind IN ('page', 'frame'))::INT) OVER p AS np FROM i JOIN t USING (item)
  WINDOW r AS (PARTITION BY root ORDER BY i.item), p AS (PARTITION BY i.parent ORDER BY i.item)),
e AS (SELECT *, CASE WHEN emb AND depth > 4 THEN 'depth_limit' WHEN emb AND sf > 16 THEN 'embedded_files_limit' WHEN emb AND sb > 67108864 THEN 'embedded_bytes_limit' WHEN kind = 'tool' AND bytes > 16777216 THEN 'tool_output_limit'
  WHEN kind = 'frame' AND nf > 16 THEN 'frames_limit' WHEN kind = 'image' AND ni > 16 THEN 'page_images_limit' WHEN area > 25000000 THEN 'image_pixels_limit' WHEN area > 0 AND sa > 100000000 THEN 'pixels_limit'
  WHEN kind IN ('page', 'frame') AND np > 20 THEN 'pages_limit' WHEN text > 0 AND st > 8388608 THEN 'text_limit' END AS error FROM w)
SELECT root, count(*) AS items, max(depth)::BIGINT AS depth, sum(emb::INT)::BIGINT AS embedded_files, sum(CASE WHEN emb THEN bytes ELSE 0 END)::BIGINT AS embedded_bytes, sum(area)::BIGINT AS pixels, sum(text)::BIGINT AS text_bytes,
  min(item) FILTER (error IS NOT NULL) AS error_item, arg_min(error, item) FILTER (error IS NOT NULL) AS error FROM e GROUP BY root""")
def nested_limits(spark, sf_dir):
    """Customers as files that hold orders, which may hold the next one, and whose lines are pages, images, frames and outputs."""
    custom = lambda c: F.col(c) * 10_000_000_000
    o, n = table(spark, sf_dir, "orders"), F.lit(0).cast("bigint")
    before = F.lag((F.col("o_orderkey") + 1) * 16).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = o.select("o_orderkey", custom("o_custkey").alias("c"), ((F.col("o_orderkey") + 1) * 16).alias("place"), before.alias("prev"), (F.floor("o_totalprice") * 50).alias("bytes"))
    columns = ["item", "parent", "kind", "bytes", "width", "height", "text_bytes"]
    row = lambda *c: [x.alias(name) for x, name in zip(c, columns, strict=True)]
    rows = table(spark, sf_dir, "customer").select(*row(custom("c_custkey"), F.lit(None).cast("bigint"), F.lit("file"), n, n, n, n))
    inside = F.when(F.col("o_orderkey") % 3 == 0, F.coalesce("prev", n)).otherwise(n)
    rows = rows.unionByName(o.select(*row(F.col("c") + F.col("place"), F.col("c") + inside, F.lit("file"), F.col("bytes"), n, n, n)))
    k = (F.col("l_linenumber") % 4).cast("int")
    kind = F.get(F.array(*map(F.lit, ("page", "image", "frame", "tool"))), k)
    line = table(spark, sf_dir, "lineitem").join(o.drop("bytes"), F.col("l_orderkey") == F.col("o_orderkey"))
    width = F.when(k == 3, n).otherwise(F.col("l_partkey") % 6000)
    rows = rows.unionByName(line.select(*row(F.col("c") + F.col("place") + F.col("l_linenumber"), F.col("c") + F.col("place"), kind, (F.col("l_partkey") % 20000) * 1000, width, n + 5000, (F.col("l_suppkey") % 1000) * 2000)))
    return extraction.nested_limits(rows)


@query("""WITH r AS (SELECT o_custkey AS request_id, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'url' ELSE 'file' END AS kind, o_orderkey % 23 AS ref FROM orders),
f AS (SELECT *, kind = 'file' OR row_number() OVER (PARTITION BY request_id, kind, ref ORDER BY pos) = 1 AS charged, CASE WHEN ref < 22 THEN (ref + 1) * 400 END AS size FROM r),
s AS (SELECT *, sum(charged::INT) OVER w::BIGINT AS used, coalesce(sum(CASE WHEN charged THEN size END) OVER w, 0)::BIGINT AS used_bytes FROM f WINDOW w AS (PARTITION BY request_id ORDER BY pos)),
e AS (SELECT *, CASE WHEN charged AND size IS NULL THEN 'unresolved_reference' WHEN used > 16 OR used_bytes > 60000 THEN 'reference_limit' END AS error FROM s)
SELECT request_id, pos, kind, ref, charged, used, used_bytes, CASE WHEN pos > min(pos) FILTER (error IS NOT NULL) OVER (PARTITION BY request_id) THEN 'unread' WHEN error IS NOT NULL THEN error WHEN charged THEN 'read' ELSE 'known' END AS state FROM e""")
def references_in_order(spark, sf_dir):
    """Orders as references of customers, in order: which are read, which are known already, at which one a request fails, and what is not read any more."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), k.alias("pos"), F.when(k % 2 == 0, "url").otherwise("file").alias("kind"), (k % 23).alias("ref"))
    have = r.select("kind", "ref").distinct().where("ref < 22").withColumn("content", F.encode(F.expr("repeat('x', cast((ref + 1) * 400 as int))"), "UTF-8"))
    return attachments.charged_in_order(r, have, total=60_000)
