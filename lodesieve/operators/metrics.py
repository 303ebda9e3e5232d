"""Counters, the latency histogram, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import at_ranks

# Bucket limits in milliseconds.
LIMITS_MS = (5, 10, 50, 100, 1_000, 5_000, 30_000, 180_000)


def counters(requests: DataFrame) -> DataFrame:
    """requests: status, findings, cache_hits, attachments."""
    return requests.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("rejected"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"),
        F.coalesce(F.sum("cache_hits"), F.lit(0)).alias("cache_hits"), F.coalesce(F.sum("attachments"), F.lit(0)).alias("attachments"),
    )


def histogram(df: DataFrame, ms: Column, keys: list[str] = ()) -> DataFrame:
    """Cumulative counts: one row for each limit and +Inf: le, n. One pass; the limits become rows after it."""
    sums = [F.count_if(ms <= limit).alias(str(limit)) for limit in LIMITS_MS] + [F.count(ms).alias("+Inf")]
    one = df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"`{n}`").alias("n")) for n in (*map(str, LIMITS_MS), "+Inf")])
    return one.select(*keys, F.explode(pairs).alias("b")).select(*keys, "b.le", "b.n")


def rendered(counts: DataFrame, prefix: str = "inspection") -> DataFrame:
    """One row of text for each counter: '# TYPE name counter' and its value."""
    lines = [F.format_string(f"# TYPE {prefix}_{c}_total counter\n{prefix}_{c}_total %d", F.col(c)) for c in counts.columns]
    return counts.select(F.explode(F.array(*lines)).alias("line"))


def rank_percentiles(df: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Of each key the values at 1-based rank floor(share * n) + 1, n at most: keys, and a column for each name of shares."""
    return at_ranks(df, value, keys, shares)


def rendered_histogram(buckets: DataFrame, total_ms: str, name: str = "inspection_request_to_headers_seconds") -> DataFrame:
    """buckets: le (milliseconds or +Inf), n, and the sum of all times in the column total_ms. One row for each line of text, limits in seconds."""
    le = F.when(F.col("le") == "+Inf", F.col("le")).otherwise(F.regexp_replace((F.col("le").cast("double") / 1000).cast("string"), r"\.0\z", ""))
    line = F.format_string(name + '_bucket{le="%s"} %d', le, F.col("n"))
    last = F.array(line, F.format_string(name + "_count %d", F.col("n")), F.format_string(name + "_sum %.3f", F.col(total_ms) / 1000))
    return buckets.select(F.explode(F.when(F.col("le") == "+Inf", last).otherwise(F.array(line))).alias("line"))


def responses(chunks: DataFrame, key: str, size: str, state: str) -> DataFrame:
    """Chunks of response bodies: bytes of each response, and its end: failed if any chunk says so, completed if one does, else cancelled."""
    end = F.when(F.bool_or(F.col(state) == "failed"), "failed").when(F.bool_or(F.col(state) == "completed"), "completed").otherwise("cancelled")
    return chunks.groupBy(key).agg(F.sum(size).alias("bytes"), end.alias("ended"))
