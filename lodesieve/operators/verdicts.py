"""The verdict store: a table of what inspections found, by content. All operations take and return DataFrames.

Columns: key, scope, expires, accessed (epoch seconds), rules, artifact (bytes), artifact_digest, size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import empty, fold
from ..functions.running import running_sum, same
from ..sources.shared import saved

TTL, MAX_ROWS, MAX_ARTIFACTS, MAX_ARTIFACT = 7 * 86_400, 100_000, 1 << 30, 64 << 20


def key(scope: Column, profile: str, content: Column, *settings: str) -> Column:
    """scope, then a digest of scope, rule profile, content and all settings that decide on the outcome."""
    parts = [scope, F.lit(profile), F.sha2(content, 256), *map(F.lit, settings)]
    return F.concat(scope, F.lit(":"), F.sha2(F.concat_ws(":", *parts), 256))


def valid(v: DataFrame, now: int) -> DataFrame:
    """Verdicts that still hold: not expired, their artifact (if any) present, not too large and unchanged."""
    sound = F.col("artifact_digest").isNull() | (F.col("artifact").isNotNull() & (F.octet_length("artifact") <= MAX_ARTIFACT) & (F.sha2("artifact", 256) == F.col("artifact_digest")))
    return v.where((F.col("expires") > now) & F.coalesce(sound, F.lit(False)))


def lookup(requests: DataFrame, v: DataFrame, now: int) -> DataFrame:
    """requests: (..., key). Each with hit, rules and artifact of its verdict, if there is one."""
    found = valid(v, now).select("key", "rules", "artifact", F.lit(True).alias("hit"))
    return requests.join(found, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(requests: DataFrame, v: DataFrame, now: int) -> DataFrame:
    """One row for each key that is to be inspected, however many requests wait for it."""
    return requests.dropDuplicates(["key"]).join(valid(v, now), "key", "left_anti")


def refreshed(v: DataFrame, hits: DataFrame, now: int, ttl: int = TTL) -> DataFrame:
    """Verdicts in use are prolonged once they have lost a certain part of their time: half of it, but a second at least and an hour at most."""
    slack = max(1, min(3600, ttl // 2))
    used = hits.select("key").distinct().withColumn("used", F.lit(True))
    old = F.coalesce("used", F.lit(False)) & (F.col("expires") > now) & (F.col("expires") - now < ttl - slack)
    rows = v.join(used, "key", "left").withColumn("old", old)
    return rows.withColumn("expires", F.when(F.col("old"), F.lit(now + ttl)).otherwise(F.col("expires"))).withColumn("accessed", F.when(F.col("old"), F.lit(now)).otherwise(F.col("accessed"))).drop("used", "old")


def put(v: DataFrame, new: DataFrame, generation: int) -> DataFrame:
    """v with new verdicts (with the generation in which their inspection began). Outdated ones and too large artifacts are not stored; a new one replaces the old."""
    fresh = new.where((F.col("generation") == generation) & (F.coalesce(F.octet_length("artifact"), F.lit(0)) <= MAX_ARTIFACT)).drop("generation")
    both = v.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    last = Window.partitionBy("key").orderBy(F.desc("__new"), F.desc("accessed"))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__new")


def live(v: DataFrame, now: int) -> DataFrame:
    return v.where(F.col("expires") > now)


def newest(v: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """The most rows that were used last."""
    return v.orderBy(F.desc("accessed"), "key").limit(most)


#: Rows of one budget that one task folds over, some 20 MB; more of them are worked off in rounds.
FOLD = 200_000


def within_bytes(v: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Greedy, most recent first: a row that would pass the budget goes, and does not count, so that later, smaller ones may stay. A null size never fits.

    keys: what shares one budget. In a round those rows stay, of the candidates in order, whose running sum is within what is left; then only
    rows that fit the rest are candidates, which drops the row that did not fit. Once no budget has more than FOLD candidates a fold ends it.
    """
    names = [*keys, "key"]
    item = v.select(*names, (-F.col("accessed")).alias("age"), F.col("size").cast("bigint").alias("size")).where(F.col("size") <= budget)
    left, kept = v.select(*keys).distinct().withColumn("left", F.lit(budget).cast("bigint")), None
    while True:
        item = saved(item, "candidates")
        most = item.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if most <= FOLD:
            break
        summed = running_sum(item, keys, ["age", "key"], "size", "used")
        summed = saved(summed.join(left, same(summed, left, keys)).select(*[summed[c] for c in summed.columns], "left").withColumn("fits", F.col("used") <= F.col("left")), "rounds")
        fit = summed.where("fits").select(*names)
        kept = fit if kept is None else kept.unionByName(fit)
        left = saved(summed.groupBy(*keys, "left").agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("used"))), F.lit(0)).alias("used")).select(*keys, (F.col("left") - F.col("used")).alias("left")), "left")
        rest = summed.where("not fits").drop("used", "left", "fits")
        item = rest.join(left, same(rest, left, keys)).where(F.col("size") <= F.col("left")).select(*[rest[c] for c in rest.columns])

    def step(room: Column, x: Column) -> tuple[Column, Column]:
        fits = x["size"] <= room
        return F.when(fits, room - x["size"]).otherwise(room), F.when(fits, F.array(x["key"])).otherwise(empty(f"array<{kind}>"))

    kind = v.schema["key"].dataType.simpleString()
    rows = item.join(left, same(item, left, keys)).select(*[item[c] for c in item.columns], "left")
    groups = rows.groupBy(*keys, "left").agg(F.array_sort(F.collect_list(F.struct("age", "key", "size"))).alias("items"))
    last = groups.select(*keys, F.explode(fold(F.col("items"), F.col("left"), step, kind)).alias("key"))
    kept = last if kept is None else kept.unionByName(last)
    return v.join(kept, same(v, kept, names), "left_semi")


def oldest(v: DataFrame) -> DataFrame:
    """The key to evict: the one that was not used for longest."""
    return v.agg(F.min_by("key", F.struct("accessed", "key")).alias("key"))


def orphans(artifacts: DataFrame, v: DataFrame) -> DataFrame:
    """Artifacts that no verdict refers to."""
    return artifacts.join(v, artifacts["digest"] == v["artifact_digest"], "left_anti")


def purged(v: DataFrame, scope: str, generation: int) -> tuple[DataFrame, int]:
    """v without the keys of a scope (64 hex digits), and the next generation: it holds for all scopes."""
    import re

    if not re.fullmatch(r"[0-9a-f]{64}", scope):
        raise ValueError("a scope is 64 hex digits")
    return v.where(~F.startswith("key", F.lit(scope + ":"))), generation + 1


def purged_all(v: DataFrame, generation: int) -> tuple[DataFrame, int]:
    """No verdict, and the next generation: inspections that began before are not stored."""
    return v.where("false"), generation + 1
