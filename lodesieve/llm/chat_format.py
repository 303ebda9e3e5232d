"""Chat formatting: cumulative-snapshot collapse, then rendering. DataFrame functions only.

A chat service logs a conversation again after each turn, so a table of conversations holds
many that are a prefix of a longer one. Each turn gets a hash of its position, role and text;
the running sum of these over a conversation is the rolling hash of its turn prefix (four
lanes of 32 bits, so that equal sums stand for equal prefixes). A conversation whose whole
hash is found among the proper prefixes of others goes, by anti-join; of equal conversations
the one with the smallest conv_id stays. What stays is rendered.

The running sum is taken in two levels, over blocks and within blocks. Blocks are ranges of (conversation, turn, digest, row), as
Spark deals them out, so that one conversation with a third of all turns is not summed by one task, though all its turns were the same. Prefixes are made
distinct before the join, which combines copies where they are read. Only digests of the turns
take part in this; texts are shuffled once, those that are rendered.

Defined results. Turns are ordered by turn (null first), then the digest of role and text; the position
is the place in that order, so gaps between turn numbers do not count. Null role or text
counts as empty. Turns without conv_id are one conversation with a null id. Repeated rows
are turns of their own. An empty table gives an empty result; other columns are not read.
A rendered conversation is one row, as it must be, and so has to fit one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

LANES = ["h0", "h1", "h2", "h3"]
START, END = "<|im_start|>", "<|im_end|>"


def clean(turns: DataFrame) -> DataFrame:
    """key (never null), conv, turn, role, text and the digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("key"), F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns: clean(). key, conv, pos (from 1) and the lanes of the prefix hash up to each turn."""
    # Rows that are alike in all of it have the same hash in any order; their numbers only deal them out.
    order = [F.asc_nulls_first("turn"), "digest", "r"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = turns.select("key", "conv", "turn", "digest", F.monotonically_increasing_id().alias("r"))
    t = saved(t.repartitionByRange(parts, "key", *order).withColumn("block", F.spark_partition_id()), "turns")
    own = Window.partitionBy("key", "block").orderBy(*order)
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    t = t.withColumn("own", F.row_number().over(own)).join(starts, ["key", "block"]).withColumn("pos", F.col("start") + F.col("own"))
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    a, b = F.xxhash64(F.lit(1), "pos", "digest"), F.xxhash64(F.lit(2), "digest", "pos")
    lanes = [low(a), F.shiftrightunsigned(a, 32), low(b), F.shiftrightunsigned(b, 32)]
    t = saved(t.select("key", "conv", "block", "pos", *[x.alias(h) for x, h in zip(lanes, LANES, strict=True)]), "turn-hashes")
    sums = t.groupBy("key", "block").agg(*[F.sum(h).alias(f"s_{h}") for h in LANES])
    sums = sums.select("key", "block", *[F.coalesce(F.sum(f"s_{h}").over(before), F.lit(0)).alias(f"s_{h}") for h in LANES])
    past = Window.partitionBy("key", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("key", "conv", "block", "pos", *[F.sum(h).over(past).alias(h) for h in LANES]).join(sums, ["key", "block"])
    return saved(t.select("key", "conv", "pos", *[(F.col(h) + F.col(f"s_{h}")).alias(h) for h in LANES]), "prefix-hashes")


def maximal(hashes: DataFrame) -> DataFrame:
    """hashes: prefix_hashes(). key, n_turns and copies of the conversations that stay."""
    ends = hashes.groupBy("key", "conv").agg(F.max(F.struct("pos", *LANES)).alias("end"))
    # Of the proper prefixes, each conversation gives all but its last position.
    proper = hashes.join(ends.select("key", F.col("end.pos").alias("last")), "key").where("pos < last").select("pos", *LANES).distinct()
    first = F.min_by("key", F.struct(F.col("conv").isNull(), "conv"))
    whole = ends.groupBy("end").agg(first.alias("key"), F.count(F.lit(1)).alias("copies"))
    whole = whole.select("key", "copies", F.col("end.pos").alias("pos"), *[F.col(f"end.{h}").alias(h) for h in LANES])
    return whole.join(proper, ["pos", *LANES], "left_anti").select("key", F.col("pos").alias("n_turns"), "copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """turns: clean(); kept: maximal(). One row for each conversation that stays."""
    part = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    t = turns.join(kept, "key").select("key", "conv", "n_turns", "copies", F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", part.alias("part")).alias("p"))
    done = t.groupBy("key").agg(F.first("conv").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_list("p")).alias("parts"))
    return done.select("conv_id", "n_turns", "copies", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("rendered"))


def chat_format(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. conv_id, n_turns, copies (equal conversations), rendered."""
    t = clean(turns)
    return render(t, maximal(prefix_hashes(t)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations),
p AS (
  SELECT conv_id, pos, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS s,
         string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
w AS (SELECT k, min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS copies, any_value(s) AS rendered FROM p WHERE pos = n GROUP BY k)
SELECT conv_id, n_turns, copies, rendered FROM w
WHERE k NOT IN (SELECT k FROM p WHERE pos < n)
"""
