"""Requests as a stream, each batch written once however often it runs.

A batch is inspected once, and its outcome written; decisions with their errors, the findings log and approved bodies come from that. Each has a
folder of its own for each batch, named by the batch's number, which a batch that runs again replaces whole: Spark gives a
batch the same number and the same requests after a restart from the checkpoint. A batch's ``done`` mark comes last, and readers
read the batches that have one: they see all of a batch or nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy
from ..operators.scan import Rules
from ..sources.config import Config
from ..sources.rules import DEFAULT_RULES

TABLES = {
    "decisions": "request_id string, decision string, status int, error string, finding_count int, rule_ids array<string>",
    "findings": "request_id string, finding_id string, rule_id string",
    "approved": "request_id string, decision string, body string",
}


class Sink:
    """For foreachBatch: inspects a batch of requests (request_id, body, and perhaps error) and writes its tables to path."""

    def __init__(self, path: str, config: Config = Config(), scanner: Rules | Callable[[], Rules] = DEFAULT_RULES):
        """scanner: or what gives one, asked anew for each batch."""
        self.path, self.config, self.scanner = path.rstrip("/"), config, scanner

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scanner = self.scanner() if callable(self.scanner) else self.scanner
        at = lambda name: f"{self.path}/{name}/batch={number}"
        done = policy.processed(batch.withColumn("request_id", F.col("request_id").cast("string")), self.config, scanner)
        done.select("request_id", "decision", "status", "error", "rules", "finding_count", "rule_ids", "approved_body").write.mode("overwrite").parquet(at("outcome"))
        out = spark.read.schema("request_id string, decision string, status int, error string, rules array<string>, finding_count int, rule_ids array<string>, approved_body string").parquet(at("outcome"))
        out.select("request_id", "decision", "status", "error", "finding_count", "rule_ids").write.mode("overwrite").parquet(at("decisions"))
        policy.finding_ids(out).select("request_id", "finding_id", "rule_id").write.mode("overwrite").parquet(at("findings"))
        out.where("approved_body IS NOT NULL").select("request_id", "decision", F.col("approved_body").alias("body")).write.mode("overwrite").parquet(at("approved"))
        out.limit(0).select("request_id").write.mode("overwrite").parquet(at("done"))


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a table, of all batches that are done, with their batch."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/done")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    full = [b for b in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/done/{b}/_SUCCESS"))]
    schema = f"{TABLES[name]}, batch bigint"
    if not full:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path.rstrip('/')}/{name}").parquet(*[f"{path.rstrip('/')}/{name}/{b}" for b in full])


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works off all that is there, and stops."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
