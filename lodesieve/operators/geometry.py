"""Recognised words as lines, boxes between scales and rotations, and which boxes cover which secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running_sum

LINE = ["block_num", "par_num", "line_num"]


def lines(words: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """words: keys, block_num, par_num, line_num, left, top, width, height, text, and their order pos. One row for each line: text, x1, y1, x2, y2.

    A blank goes between two words if the gap is wider than half a character of the first.
    """
    by = [*keys, *LINE]
    order = Window.partitionBy(*by).orderBy(pos)
    rows = words.where(F.trim("text") != "")
    edge = F.lag(F.col("left") + F.col("width")).over(order)
    half = F.expr("greatest(width div greatest(char_length(text), 1), 1) div 2")
    rows = rows.withColumn("half", half)
    gap = F.greatest(F.col("left") - edge, F.lit(0))
    lead = F.when(gap > F.lag("half").over(order), F.lit(" ")).otherwise(F.lit(""))
    rows = rows.withColumn("piece", F.concat(lead, "text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("piece").alias("t"))))
    return rows.groupBy(*by).agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"), F.min("left").alias("x1"), F.min("top").alias("y1"),
        F.max(F.col("left") + F.col("width")).alias("x2"), F.max(F.col("top") + F.col("height")).alias("y2"),
    )


def scaled_down(x: str, source: str, target: str) -> Column:
    return F.expr(f"({x} * {target}) div {source}")


def scaled_up(x: str, source: str, target: str) -> Column:
    return F.expr(f"({x} * {target} + {source} - 1) div {source}")


def scale_box(df: DataFrame, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
    """Box x1 y1 x2 y2 (whole numbers) from one size to another: lower edges down, upper edges up, so that nothing is uncovered."""
    (sw, sh), (tw, th) = source, target
    return df.withColumns({"x1": scaled_down("x1", sw, tw), "y1": scaled_down("y1", sh, th), "x2": scaled_up("x2", sw, tw), "y2": scaled_up("y2", sh, th)})


def unrotate_box(df: DataFrame, width: str, height: str, turns: str) -> DataFrame:
    """Box of a page that was turned by quarters, back on the page of width and height. Edges stop at 0."""
    w, h, t = F.col(width), F.col(height), F.pmod(F.col(turns), F.lit(4))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    less = lambda a, b: F.greatest(a - b, F.lit(0))
    pick = lambda a, b, c, d: F.when(t == 1, b).when(t == 2, c).when(t == 3, d).otherwise(a)
    return df.withColumns({
        "x1": pick(x1, y1, less(w, x2), less(w, y2)), "y1": pick(y1, less(h, x2), less(h, y2), x1),
        "x2": pick(x2, y2, less(w, x1), less(w, y1)), "y2": pick(y2, less(h, x1), less(h, y1), x2),
    })


def covered(findings: DataFrame, key: str) -> DataFrame:
    """findings: key, page, digest, has_box. Findings of a page without a box, and whether a box on the same page holds each secret: key, page, digest, mapped."""
    boxed = findings.where("has_box").select(key, "page", "digest").distinct().withColumn("mapped", F.lit(True))
    loose = findings.where("not has_box").select(key, "page", "digest").distinct()
    return loose.join(boxed, [key, "page", "digest"], "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))


def unmapped_pages(findings: DataFrame, key: str, allow_page_redaction: bool = False) -> DataFrame:
    """Pages with a finding that no box covers: these block, unless whole pages may be blacked out."""
    rows = covered(findings, key).groupBy(key, "page").agg(F.bool_and("mapped").alias("all_mapped")).where("not all_mapped").select(key, "page")
    return rows.where(F.lit(not allow_page_redaction))


def selected(findings: DataFrame, key: str, segment: str, allow_page_redaction: bool = False) -> DataFrame:
    """findings: key, segment, page (null: not on a page), digest, has_box. The segments to black out: key, segment, page, whole_page.

    Those with a box, or on no page; of the others none if boxes cover all their secrets, else the whole page if that is allowed."""
    boxed = findings.where("has_box").select(key, "page", "digest").distinct().withColumn("mapped", F.lit(True))
    rows = findings.join(boxed, [key, "page", "digest"], "left").groupBy(key, segment, "page").agg(F.bool_or("has_box").alias("has_box"), F.bool_and(F.coalesce("mapped", F.lit(False))).alias("mapped"))
    loose = F.col("page").isNotNull() & ~F.col("has_box")
    keep = ~loose | (~F.col("mapped") & F.lit(allow_page_redaction))
    return rows.where(keep).select(key, segment, "page", (loose & ~F.col("mapped")).alias("whole_page"))


def over_budget(items: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Running sums of size within key; error from the item on that passes the limit."""
    return running_sum(items, [key], [order], size, "used").withColumn("error", F.when(F.col("used") > limit, F.lit("extraction_limit")))


# Limits of an extraction; see operators/extraction.py for those of nested files.
LIMITS = {"text_bytes": 8 << 20, "pages": 20, "files": 16, "depth": 4, "pixels": 25_000_000, "all_pixels": 100_000_000}


def extraction_errors(extracted: DataFrame, key: str, limits: dict[str, int] = LIMITS) -> DataFrame:
    """extracted: one row a segment, with key and those of page, file, depth, width, height, text that are known. Of each key: text_bytes, pages, files, depth, pixels (of the largest image), all_pixels, error (the first limit that is passed, or null)."""
    has = lambda c, kind: F.col(c) if c in extracted.columns else F.lit(None).cast(kind)
    pixels = has("width", "bigint").cast("bigint") * has("height", "bigint")
    most = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("bigint")
    sums = extracted.groupBy(key).agg(
        F.coalesce(F.sum(F.octet_length(has("text", "string")).cast("bigint")), F.lit(0)).alias("text_bytes"), most(has("page", "bigint")).alias("pages"), most(has("file", "bigint")).alias("files"), most(has("depth", "bigint")).alias("depth"),
        most(pixels).alias("pixels"), F.coalesce(F.sum(pixels), F.lit(0)).alias("all_pixels"),
    )
    return sums.withColumn("error", F.coalesce(*[F.when(F.col(n) > m, F.lit(f"{n}_limit")) for n, m in limits.items()]))
