"""Streams of texts and requests through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan as scan_ops
from ..operators.metrics import LIMITS_MS
from ..sources.rules import DEFAULT_RULES


def read(spark: SparkSession, path: str, schema, files: int = 100, format: str = "parquet") -> DataFrame:
    """A stream of files; at most so many in a batch, which bounds what is in flight."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files).load(path)


def findings(stream: DataFrame, keys: list[str], text: str, rules: scan_ops.Rules = DEFAULT_RULES) -> DataFrame:
    """The findings of a stream: keys, rule, start, end, digest of the secret. Stateless; a secret itself is not passed on."""
    return scan_ops.find(stream, keys, text, rules).select(*keys, "rule", "start", "end", F.sha2("secret", 256).alias("digest"))


def first_seen(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Findings of a secret not seen before within delay: state is dropped behind the watermark, as verdicts expire."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["rule", "digest"])


def counted(stream: DataFrame) -> DataFrame:
    """Running number of findings of each rule."""
    return stream.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def latency(stream: DataFrame, time: str, ms: str, window: str, delay: str) -> DataFrame:
    """The latency histogram of each time window, late rows within delay included."""
    sums = [F.count_if(F.col(ms) <= limit).alias(f"le_{limit}") for limit in LIMITS_MS]
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, window).alias("w")).agg(*sums, F.count(ms).alias("n")).select(F.col("w.start").alias("start"), *[f"le_{x}" for x in LIMITS_MS], "n")


def run_once(stream: DataFrame, table_path: str, checkpoint: str, mode: str = "append") -> None:
    """Works off all that is there, and stops. Append goes to Parquet files, complete replaces them batch by batch."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", table_path).start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(table_path)).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
