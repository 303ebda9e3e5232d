"""Sources of requests, and sinks: approved bodies, findings logs, metrics text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BODY = 64 << 20


def requests(spark: SparkSession, path: str, most: int = MAX_BODY) -> DataFrame:
    """Bodies of JSON-lines files as they are, with a fresh id each; error too_large beyond most bytes, which inspect() keeps."""
    rows = spark.read.text(path).select(F.col("value").alias("body"))
    return rows.select(F.uuid().alias("request_id"), F.when(F.octet_length("body") <= most, F.col("body")).alias("body"), F.when(F.octet_length("body") > most, F.lit("too_large")).alias("error"))


def bounded(files: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """binaryFile rows within limit; the length column prunes before content is read."""
    return files.where(F.col("length") <= limit)


def write_approved(decided: DataFrame, path: str) -> None:
    """Bodies that may be passed on."""
    decided.where("approved_body is not null").select("request_id", "decision", F.col("approved_body").alias("body")).write.mode("append").parquet(path)


def write_findings(ids: DataFrame, path: str) -> None:
    """A log of findings: ids and rules, never what matched."""
    ids.select("request_id", "finding_id", "rule_id").write.mode("append").json(path)


def write_metrics(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_artifacts(outcomes: DataFrame, path: str, most: int) -> None:
    """Replacements by their digests, each once, also over several runs; larger ones are left out."""
    spark = outcomes.sparkSession
    new = outcomes.where(F.col("replacement").isNotNull() & (F.octet_length("replacement") <= most)).select(F.sha2("replacement", 256).alias("digest"), F.col("replacement").alias("artifact")).dropDuplicates(["digest"])
    try:
        there = spark.read.schema("digest string").parquet(path)
    except AnalysisException:
        there = spark.createDataFrame([], "digest string")
    new.join(there, "digest", "left_anti").write.mode("append").parquet(path)


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest string, artifact binary").parquet(path)
