"""Limits of an extraction over nested files: sums over trees of parent links, and the first item that passes one.

An item is what an extraction meets: a file, a page or frame of it, an image on a page, or a tool's output; its parent is the item that
holds it. Roots and depths come from pointer doubling: each item knows an ancestor and how deep it lies below that one, and takes its ancestor's
in turn, so a chain of n files takes log n rounds. Sums go over a root's items in their order, in two levels, so a
root with a third of all items is no one task's.

Defined results. An item whose parent is not there is a root. Items on a circle have no root, and depth_limit as their error; each is
reported as its own root. Null sizes count as 0. Rows that repeat an item id without items of its own count once for each
of them (they double in the joins), and all together before any is tried: each has the sums through the last. Of their errors the first by name is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_sums
from ..sources.shared import drop, saved

# The limits. Of a tree: text, pixels, embedded files and their bytes; of an image; of a file's pages and frames; of a page's images; of a tool's output; nesting.
LIMITS = {
    "text": 8 << 20, "pixels": 100_000_000, "image_pixels": 25_000_000, "pages": 20, "embedded_files": 16, "embedded_bytes": 64 << 20, "depth": 4, "frames": 16, "page_images": 16, "tool_output": 16 << 20,
}


def rooted(items: DataFrame) -> DataFrame:
    """items: item, parent (null: none), kind. Adds root (null on a circle) and depth: how many files lie between an item and its root, the item and not the root counted."""
    known = items.select(F.col("item").alias("parent"), F.lit(True).alias("there"))
    weight = (F.col("kind") == "file").cast("bigint")
    rows = items.join(known, "parent", "left").withColumn("__own", F.coalesce("there", F.lit(False)))
    state = saved(rows.select("item", F.when(F.col("__own"), F.col("parent")).otherwise(F.col("item")).alias("up"), F.when(F.col("__own"), weight).otherwise(F.lit(0)).alias("depth"), (~F.col("__own")).alias("done")), "tree")
    # A chain is no longer than there are items; what is open after so many rounds is on a circle, or leads to one.
    for _ in range(state.count().bit_length() + 1):
        open_ = state.where("NOT done")
        if not open_.head(1):
            break
        far = state.select(F.col("item").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        step = open_.join(far, "up").select("item", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        now = saved(state.where("done").unionByName(step), "tree")
        drop(state)
        state = now
    found = state.select("item", F.when(F.col("done"), F.col("up")).alias("root"), "depth")
    return items.join(found, "item")


def nested_limits(items: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """items: item (its number tells the order), parent, kind (file, page, frame, image, tool), bytes, width, height, text_bytes. Of each root:
    root, items, depth, embedded_files, embedded_bytes, pixels, text_bytes, error_item, error (both null if all limits hold)."""
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    rows = rooted(items.select("item", "parent", "kind", zero("bytes").alias("bytes"), (zero("width") * zero("height")).alias("area"), zero("text_bytes").alias("text_bytes")))
    rows = rows.withColumn("circle", F.col("root").isNull()).withColumn("root", F.coalesce("root", "item"))
    embedded = (F.col("kind") == "file") & (F.col("root") != F.col("item"))
    rows = rows.withColumns({"one": F.lit(1).cast("bigint"), "file": embedded.cast("bigint"), "file_bytes": F.when(embedded, F.col("bytes")).otherwise(F.lit(0))})
    rows = running_sums(rows, ["root"], ["item"], {"sum_text": "text_bytes", "sum_area": "area", "sum_files": "file", "sum_bytes": "file_bytes"}, peers=True)
    # A file's pages and frames count together, as each gives an image.
    rows = rows.withColumns({"shown": F.col("kind").isin("page", "frame").cast("bigint"), "framed": (F.col("kind") == "frame").cast("bigint"), "pictured": (F.col("kind") == "image").cast("bigint")})
    rows = running_sums(rows, ["parent"], ["item"], {"sum_shown": "shown", "sum_framed": "framed", "sum_pictured": "pictured"}, peers=True)
    over = lambda c, name, when=None: F.when((F.col(c) > limits[name]) if when is None else (F.col(c) > limits[name]) & when, F.lit(f"{name}_limit"))
    kind = F.col("kind")
    error = F.coalesce(
        F.when(F.col("circle"), F.lit("depth_limit")), over("depth", "depth", embedded), over("sum_files", "embedded_files", embedded), over("sum_bytes", "embedded_bytes", embedded), over("bytes", "tool_output", kind == "tool"),
        over("sum_framed", "frames", kind == "frame"), over("sum_pictured", "page_images", kind == "image"), over("area", "image_pixels"), over("sum_area", "pixels", F.col("area") > 0), over("sum_shown", "pages", kind.isin("page", "frame")),
        over("sum_text", "text", F.col("text_bytes") > 0),
    )
    rows = rows.withColumn("error", error)
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("item", "error")))
    sums = rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("items"), F.max("depth").alias("depth"), F.sum("file").alias("embedded_files"), F.sum("file_bytes").alias("embedded_bytes"), F.sum("area").alias("pixels"), F.sum("text_bytes").alias("text_bytes"), first.alias("first"),
    )
    return sums.select("root", "items", "depth", "embedded_files", "embedded_bytes", "pixels", "text_bytes", F.col("first.item").alias("error_item"), F.col("first.error").alias("error"))
