"""Texts in parts: findings that run across ordered parts, clipped to each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rules import DEFAULT_RULES
from .scan import Rules, find
from .spans import merge

BOUNDARY = "\n[CONTENT BOUNDARY]\n"
LIMIT = 64 << 20


def placed(parts: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """The byte range of each text part in the whole that its key's parts make: key, pos, text, lead, start, end.

    Parts are joined by a line end, once there is text; a part that is no text (null) puts a
    boundary there instead. The lead is what goes before a part's own text.
    """
    order = Window.partitionBy(key).orderBy(pos)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    some = F.coalesce(F.max(F.octet_length(text) > 0).over(before), F.lit(False))
    rows = parts.select(key, pos, text).withColumn("lead", F.when(~some, F.lit("")).when(F.col(text).isNull(), F.lit(BOUNDARY)).otherwise(F.lit("\n")))
    size = F.octet_length("lead") + F.coalesce(F.octet_length(text), F.lit(0))
    rows = rows.withColumn("end", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("start", F.col("end") - F.coalesce(F.octet_length(text), F.lit(0)))


def joined(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """rows: placed(). The whole of each key's parts, in order: key, whole, error. One whole is one row, as it is scanned as one; beyond the limit none is built."""
    large = rows.groupBy(key).agg(F.max("end").alias("size")).where(F.col("size") > LIMIT).select(F.col(key).alias("__key"))
    small = rows.join(large, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    piece = F.concat("lead", F.coalesce(F.col(text), F.lit("")))
    whole = small.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), piece.alias("t")))), lambda x: x["t"]), "").alias("whole"))
    refused = large.select(F.col("__key").alias(key), F.lit(None).cast("string").alias("whole"), F.lit("reconstruction_limit").alias("error"))
    return whole.withColumn("error", F.lit(None).cast("string")).unionByName(refused)


def clipped_findings(parts: DataFrame, key: str, pos: str, text: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Merged spans of each part, with offsets in the part: key, pos, start, end, rule. An interval join within each key."""
    rows = placed(parts, key, pos, text)
    found = find(joined(rows, key, pos, text).where("error is null"), [key], "whole", rules)
    p = rows.where(F.col(text).isNotNull()).select(key, pos, F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    hit = found.join(p, key).where((F.col("start") < F.col("p_end")) & (F.col("end") > F.col("p_start")))
    clipped = hit.select(key, pos, "rule", (F.greatest("start", "p_start") - F.col("p_start")).cast("int").alias("start"), (F.least("end", "p_end") - F.col("p_start")).cast("int").alias("end"))
    return merge(clipped, [key, pos])
