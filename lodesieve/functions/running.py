"""Running sums and ranks within keys, of which one may hold most of all rows: no key is sorted by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

BLOCK = "__block"


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equal in these columns, nulls too."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def blocks(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df dealt out by ranges of (keys, order), with the number of the range. Rows that are equal in both are dealt out too, in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    return saved(rows.repartitionByRange(parts, *keys, *order, "__row").drop("__row").withColumn(BLOCK, F.spark_partition_id()), "blocks")


def sums_before(cut: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Of each key's blocks the sum of each value (own_ and its name), and of all blocks before it (before_). One row a block, so a key has no more than there are blocks."""
    sums = cut.groupBy(*keys, BLOCK).agg(*[F.sum(v).alias(f"own_{n}") for n, v in values.items()]).select(*[F.col(c).alias(c) for c in (*keys, BLOCK)], *[f"own_{n}" for n in values])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({f"before_{n}": F.coalesce(F.sum(f"own_{n}").over(before), F.lit(0)) for n in values})


def sums_after(cut: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Rows that are equal in keys and order and lie in more than one block: for each of these blocks the sums (later_ and the name) of those in blocks after it. Two rows a block at most."""
    place = F.struct(*order)
    ends = cut.groupBy(*keys, BLOCK).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy(BLOCK))
    across = ends.withColumn("before", before).where(F.col("first") == F.col("before")).select(*[F.col(k).alias(k) for k in keys], *[F.col(f"first.{c}").alias(c) for c in order]).distinct()
    rows = cut.join(F.broadcast(across), same(cut, across, [*keys, *order]), "left_semi")
    sums = rows.groupBy(*keys, *order, BLOCK).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    after = Window.partitionBy(*keys, *order).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)
    return sums.select(*[F.col(c).alias(c) for c in (*keys, *order, BLOCK)], *[F.sum(n).over(after).alias(f"later_{n}") for n in values])


def running_sums(df: DataFrame, keys: list[str], order: list, values: dict[str, str], peers: bool = False) -> DataFrame:
    """df with the running sums of whole-number columns (by the names that they get) within keys, by order. Nulls add nothing.
    With peers, rows that are equal in keys and order (names of columns) each have the sum through the last of them, wherever they lie."""
    cut = blocks(df, keys, order)
    base = sums_before(cut, keys, **{n: F.col(v) for n, v in values.items()})
    within = Window.partitionBy(*[cut[k] for k in keys], cut[BLOCK]).orderBy(*[cut[c] for c in order] if peers else order)
    within = within.rangeBetween(Window.unboundedPreceding, 0) if peers else within.rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.join(base, same(cut, base, [*keys, BLOCK]))
    sums = {n: F.coalesce(F.sum(cut[v]).over(within), F.lit(0)) + base[f"before_{n}"] for n, v in values.items()}
    if peers:
        later = sums_after(cut, keys, order, values)
        rows = rows.join(F.broadcast(later), same(cut, later, [*keys, *order, BLOCK]), "left")
        sums = {n: c + F.coalesce(later[f"later_{n}"], F.lit(0)) for n, c in sums.items()}
    return rows.select(*[cut[c] for c in df.columns], *[c.alias(n) for n, c in sums.items()])


def running_sum(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    return running_sums(df, keys, order, {name: value})


def at_ranks(df: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys, and for each name of shares the value at 1-based rank floor(share * n) + 1, n at most; nulls first. Only blocks that hold such a rank are sorted."""
    cut = blocks(df.select(*keys, value), keys, [F.col(value).asc_nulls_first()])
    sums = sums_before(cut, keys, n=F.lit(1)).withColumnsRenamed({"own_n": "own", "before_n": "before"})
    whole = Window.partitionBy(*keys)
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), F.least(F.floor(F.lit(s) * F.col("n")) + 1, F.col("n")).alias("rank")) for n, s in shares.items()])
    wanted = sums.withColumn("n", F.sum("own").over(whole)).withColumn("r", F.explode(ranks))
    wanted = wanted.where((F.col("r.rank") > F.col("before")) & (F.col("r.rank") <= F.col("before") + F.col("own")))
    wanted = wanted.select(*[F.col(c).alias(f"w_{c}") for c in (*keys, BLOCK)], F.col("r.name").alias("name"), (F.col("r.rank") - F.col("before")).alias("place"))
    on = F.lit(True)
    for c in (*keys, BLOCK):
        on = on & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    rows = cut.join(wanted, on).select(*keys, BLOCK, value, "name", "place")
    nth = F.row_number().over(Window.partitionBy(*keys, BLOCK, "name").orderBy(F.col(value).asc_nulls_first()))
    found = rows.withColumn("nth", nth).where("nth = place")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in shares])
