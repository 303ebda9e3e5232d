"""Decisions: what becomes of an inspected request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import Config
from ..sources.rules import DEFAULT_RULES, scanner_of
from . import geometry, jsonwalk
from .scan import Rules
from .spans import unique_rules

MODES = ("redact", "no-go", "advisory")


def decision(rules: Column, unsafe: Column, mode: str) -> Column:
    """original, sanitized or blocked. redact blocks only what it cannot rewrite, no-go all findings, advisory nothing."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    some = (F.size(rules) > 0) | unsafe
    if mode == "advisory":
        return F.lit("original")
    if mode == "no-go":
        return F.when(some, F.lit("blocked")).otherwise(F.lit("original"))
    return F.when(unsafe, F.lit("blocked")).when(some, F.lit("sanitized")).otherwise(F.lit("original"))


def decide(inspected: DataFrame, mode: str = "redact") -> DataFrame:
    """inspected: the output of jsonwalk.inspect(). Adds decision, approved_body (null if blocked or in error), finding_count, rule_ids."""
    what = decision(F.col("rules"), F.col("unsafe"), mode)
    if mode == "redact":  # what was put in goes on with the body
        what = F.when(F.col("changed") & (what == "original"), F.lit("sanitized")).otherwise(what)
    rows = inspected.withColumn("decision", F.when(F.col("error").isNotNull(), F.lit("failed")).otherwise(what))
    # advisory passes on the bytes that came; elsewhere a body without findings is as it came, but for references that were put in.
    body = F.when(F.col("decision") == "original", F.col("original" if mode == "advisory" else "body")).when(F.col("decision") == "sanitized", F.col("body"))
    return rows.withColumn("approved_body", body).withColumn("finding_count", F.size("rules")).withColumn("rule_ids", unique_rules(F.col("rules")))


def status(*, admitted: Column, authorized: Column, encoded: Column, too_large: Column, malformed: Column, failed: Column, blocked: Column, keyed: Column, reached: Column) -> Column:
    """The response status: the first thing that goes wrong, in the order in which a request meets them."""
    return (
        F.when(~admitted, 503).when(~authorized, 401).when(encoded, 415).when(too_large, 413).when(malformed, 400)
        .when(failed, 422).when(blocked, 409).when(~keyed, 500).when(~reached, 502).otherwise(200)
    )


def status_of(decided: DataFrame) -> DataFrame:
    """Adds status, by error and decision: 413 for a body that is too large, 400 for one that is no JSON, 422 for one that could not be inspected, 409 for a blocked one."""
    e = F.coalesce("error", F.lit(""))
    no = F.lit(False)
    what = status(admitted=~no, authorized=~no, encoded=no, too_large=e == "too_large", malformed=e == "bad_json", failed=F.col("decision") == "failed", blocked=F.col("decision") == "blocked", keyed=~no, reached=~no)
    return decided.withColumn("status", what)


def processed(requests: DataFrame, config: Config, scanner: Rules = DEFAULT_RULES, fetched: DataFrame | None = None) -> DataFrame:
    """Requests by a configuration: bodies of more than max_body_bytes refused, references put in (if what was fetched is given), inspected, decided, with a status."""
    from dataclasses import replace

    error = F.col("error").cast("string") if "error" in requests.columns else F.lit(None).cast("string")
    large = F.octet_length(F.col("body").cast("string")) > config.max_body_bytes
    requests = requests.withColumn("error", F.coalesce(error, F.when(large, F.lit("too_large"))))
    rows = requests if fetched is None else jsonwalk.materialize(requests, fetched)
    s = replace(scanner_of(scanner), use_entropy=config.use_entropy)
    return status_of(decide(jsonwalk.inspect(rows, s, config.mode == "redact"), config.mode))


def to_black_out(findings: DataFrame, key: str, segment: str, config: Config) -> tuple[DataFrame, DataFrame]:
    """The segments to black out and the pages that block (see geometry), by a configuration's page_redaction."""
    return geometry.selected(findings, key, segment, config.page_redaction), geometry.unmapped_pages(findings, key, config.page_redaction)


def finding_ids(inspected: DataFrame) -> DataFrame:
    """One row with a fresh id for each different rule of a request, never the secret: request_id, finding_id, rule_id."""
    return inspected.select("request_id", F.explode(unique_rules(F.col("rules"))).alias("rule_id")).withColumn("finding_id", F.uuid())


def scope(authorization: Column) -> Column:
    return F.sha2(F.coalesce(authorization, F.lit("local")), 256)
