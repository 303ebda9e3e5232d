"""Spans: merging overlapping findings, and redacting texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import bind, empty, fold

SPAN = "struct<start:int,end:int,rule:string>"


def merge(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Islands of overlapping spans: keys, start, end, rule (of the first span). Spans that only touch stay apart."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "rule")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    new = (F.coalesce(F.max("end").over(past), F.lit(-1)) <= F.col("start")).cast("int")
    rows = findings.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("rule", F.struct("start", -F.col("end"), "rule"))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("rule")).drop("island")


def merged_array(findings: Column) -> Column:
    """The same on an array in order (see scan()): struct(start, end, rule) of each island."""
    none = empty(f"array<{SPAN}>")

    def span(start: Column, end: Column, rule: Column) -> Column:
        return F.named_struct(F.lit("start"), start, F.lit("end"), end, F.lit("rule"), rule)

    def step(last: Column, f: Column) -> tuple[Column, Column]:
        # The island that is open grows, or is put out, and another one begins.
        grows = F.coalesce(f["start"] < last["end"], F.lit(False))
        now = F.when(grows, span(last["start"], F.greatest(last["end"], f["end"]), last["rule"])).otherwise(span(f["start"], f["end"], f["rule"]))
        return now, F.when(grows | last.isNull(), none).otherwise(F.array(last))

    return fold(findings, F.lit(None).cast(SPAN), step, SPAN, lambda last: F.when(last.isNull(), none).otherwise(F.array(last)))


def spliced(text: Column, spans: Column) -> Column:
    """text with each of its spans (in order, apart) replaced by [REDACTED:rule]. Offsets are bytes."""

    def out(x: Column) -> Column:
        octets, all_ = x["octets"], x["spans"]

        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(all_, i)["end"])
            return F.concat(F.decode(F.substring(octets, before + 1, s["start"] - before), "UTF-8"), F.lit("[REDACTED:"), s["rule"], F.lit("]"))

        tail = F.coalesce(F.try_element_at(all_, F.lit(-1))["end"], F.lit(0))
        last = F.decode(F.substring(octets, tail + 1, F.octet_length(octets)), "UTF-8")
        return F.array_join(F.concat(F.transform(all_, piece), F.array(last)), "")

    return bind(F.named_struct(F.lit("octets"), F.encode(text, "UTF-8"), F.lit("spans"), spans), out)


def redact(text: Column, findings: Column) -> Column:
    """text without its findings (an array in order); texts without findings pass as they are."""
    return F.when(F.size(findings) > 0, spliced(text, merged_array(findings))).otherwise(text)


def redact_rows(df: DataFrame, findings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """df with text redacted by findings rows of the same keys (after allowlists, say)."""
    spans = merge(findings, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "rule"))).alias("__spans"))
    return df.join(spans, keys, "left").withColumn(text, F.when(F.col("__spans").isNotNull(), spliced(F.col(text), F.col("__spans"))).otherwise(F.col(text))).drop("__spans")


def unique_rules(rules: Column) -> Column:
    """Distinct and sorted."""
    return F.array_sort(F.array_distinct(rules))
