"""A verdict store that stays: a table in key ranges, changed by dynamic partition overwrite, with generations.

Layout of a store's folder: ``verdicts/bucket=K`` holds the rows whose key hashes to K, sorted by key; ``generation-N`` is an empty file, the
largest N counts; ``busy`` is there while a writer works. A change reads and writes only the buckets that have new, refreshed or
removed rows; all others keep their files. Buckets are by hash, so a scope with a third of all rows is spread over all of them.

A purge begins a new generation. New verdicts carry the generation in which their inspection began, and those of another one than the
present are not stored: what a purge removed does not come back with an inspection that was under way.

One writer works at a time; another one gets Busy, and may try again. A writer that dies leaves ``busy`` behind, see unlock(). As this is a
cache, losing rows is never wrong: should a writer die while Spark moves the new files of a bucket into place, its verdicts are missed and found out again.
Readers see a bucket before or after a change.

Defined results. An empty store reads as an empty table. Rows with a null key are not stored. Of several new rows with one key the last accessed stays; ties go to
any one of them. Other columns of new rows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.running import running_sum
from ..operators import verdicts
from .config import Config
from .shared import drop, saved

COLUMNS = "key string, scope string, expires bigint, accessed bigint, rules array<string>, artifact binary, artifact_digest string, size bigint"


class Busy(Exception):
    """Another writer works on the store."""


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), buckets: int = 64):
        """buckets: as many for the whole life of a store; a bucket should fit some hundred MB."""
        self.spark, self.path, self.config, self.buckets = spark, path.rstrip("/"), config, buckets
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self.fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("verdicts"))
        if not self.generations():
            self.fs.createNewFile(self._path("generation-0"))

    # Generations and the lock ----------------------------------------------------------------

    def generations(self) -> list[int]:
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("verdicts").getParent())]
        return sorted(int(n.removeprefix("generation-")) for n in names if n.startswith("generation-"))

    def generation(self) -> int:
        return self.generations()[-1]

    def next_generation(self) -> int:
        old = self.generations()
        self.fs.createNewFile(self._path(f"generation-{old[-1] + 1}"))
        for n in old:
            self.fs.delete(self._path(f"generation-{n}"), False)
        return old[-1] + 1

    @contextmanager
    def writing(self) -> Iterator[None]:
        """createNewFile() makes the file or says that it is there: of two writers one gets on."""
        if not self.fs.createNewFile(self._path("busy")):
            raise Busy(self.path)
        try:
            yield
        finally:
            self.unlock()

    def unlock(self) -> None:
        """Also for a writer that died: to be called when it is known to be gone."""
        self.fs.delete(self._path("busy"), False)

    # Reading ---------------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """The store's rows, with their bucket."""
        return self.spark.read.schema(f"{COLUMNS}, bucket int").option("basePath", f"{self.path}/verdicts").parquet(f"{self.path}/verdicts")

    def read(self) -> DataFrame:
        return self.rows().drop("bucket")

    def lookup(self, requests: DataFrame, now: int) -> DataFrame:
        """requests: key and others. Each with hit, rules and artifact, see verdicts.lookup()."""
        return verdicts.lookup(requests, self.read(), now)

    # Writing ---------------------------------------------------------------------------------

    def bucket(self):
        return F.expr(f"cast(pmod(xxhash64(key), {self.buckets}) as int)")

    def write(self, rows: DataFrame, touched: list[int]) -> None:
        """Puts rows in place of all that the touched buckets hold; a bucket without rows goes."""
        full = set()
        if touched:
            new = saved(rows.select(*self.read().columns, "bucket"), "verdicts")
            full = {r[0] for r in new.select("bucket").distinct().collect()}  # at most as many as there are buckets
            out = new.repartition("bucket").sortWithinPartitions("bucket", "key")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/verdicts")
            drop(new)
        for b in set(touched) - full:
            self.fs.delete(self._path(f"verdicts/bucket={b}"), True)

    def of(self, touched: list[int]) -> DataFrame:
        return self.rows().where(F.col("bucket").isin(touched))

    def touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def put(self, new: DataFrame, now: int) -> None:
        """new: key, scope, rules, artifact, artifact_digest, size and generation. They expire when the configured time is over. Then the store is swept."""
        with self.writing():
            limit = min(self.config.max_artifact, self.config.max_artifacts)
            fresh = new.where(F.col("key").isNotNull() & (F.coalesce(F.octet_length("artifact"), F.lit(0)) <= limit))
            fresh = fresh.withColumns({"expires": F.lit(now + self.config.ttl_secs), "accessed": F.lit(now)}).select(*self.read().columns, "generation")
            generation = self.generation()
            fresh = saved(fresh.where(F.col("generation") == generation).dropDuplicates(["key"]), "new-verdicts")
            touched = self.touched(fresh)
            self.write(verdicts.put(self.of(touched).drop("bucket"), fresh, generation).withColumn("bucket", self.bucket()), touched)
            drop(fresh)
            self._sweep(now)

    def refresh(self, hits: DataFrame, now: int) -> None:
        """hits: key, perhaps often. Verdicts that have lost a certain part of their time are prolonged, see verdicts.refreshed(); the others' buckets are not written."""
        with self.writing():
            keys = saved(hits.select("key").where("key IS NOT NULL").distinct(), "hits")
            slack = max(1, min(3600, self.config.ttl_secs // 2))
            due = self.rows().where((F.col("expires") > now) & (F.col("expires") - now < self.config.ttl_secs - slack)).join(keys, "key", "left_semi")
            touched = self.touched(due.select("key"))
            self.write(verdicts.refreshed(self.of(touched), keys, now, self.config.ttl_secs), touched)
            drop(keys)

    def sweep(self, now: int) -> None:
        """Removes what has expired, then all but the rows that were used last, then what is beyond the bytes of artifacts."""
        with self.writing():
            self._sweep(now)

    def _sweep(self, now: int) -> None:
        narrow = self.rows().select("key", "accessed", "expires", "bucket", F.when(F.col("artifact_digest").isNotNull(), F.coalesce(F.octet_length("artifact").cast("bigint"), F.lit(1 << 62))).alias("size"))
        stays = saved(verdicts.live(narrow, now), "live")
        if stays.count() > self.config.max_rows:
            stays = saved(newest(stays, self.config.max_rows), "newest")
        sized = stays.where("size IS NOT NULL").withColumn("store", F.lit(0))
        if (sized.agg(F.sum(F.least("size", F.lit(1 << 40)))).first()[0] or 0) > self.config.max_artifacts:
            kept = verdicts.within_bytes(sized, ["store"], self.config.max_artifacts)
            stays = saved(stays.where("size IS NULL").unionByName(kept.drop("store")), "within")
        gone = saved(narrow.join(stays.select("key"), "key", "left_anti").select("key"), "gone")
        touched = self.touched(gone)
        self.write(self.of(touched).join(gone, "key", "left_anti"), touched)

    def purge(self) -> int:
        """Removes all verdicts. The next generation."""
        with self.writing():
            n = self.next_generation()
            self.fs.delete(self._path("verdicts"), True)
            self.fs.mkdirs(self._path("verdicts"))
            return n

    def purge_scope(self, scope: str) -> int:
        """Removes the verdicts of a scope (64 hex digits). The next generation, which holds for all scopes."""
        with self.writing():
            left, _ = verdicts.purged(self.rows(), scope, 0)
            n = self.next_generation()
            touched = self.touched(self.rows().where(F.startswith("key", F.lit(scope + ":"))).select("key"))
            self.write(left.where(F.col("bucket").isin(touched)), touched)
            return n


def newest(v: DataFrame, most: int) -> DataFrame:
    """The most rows that were used last, ties by key: those after a moment that counts by second tell, and of that second the first by key."""
    by = v.groupBy("accessed").agg(F.count(F.lit(1)).alias("n"))
    last = running_sum(by.withColumn("store", F.lit(0)).withColumn("age", -F.col("accessed")), ["store"], ["age"], "n", "used")
    edge = last.where(F.col("used") > most).agg(F.max("accessed"), F.min(F.col("used") - F.col("n"))).first()
    if edge[0] is None:
        return v
    at = v.where(F.col("accessed") == edge[0]).orderBy("key").limit(most - edge[1])
    return v.where(F.col("accessed") > edge[0]).unionByName(at)
