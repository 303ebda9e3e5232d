"""Rules that change while a stream runs: a table of versions, of which each batch takes the newest sound one.

A version is a folder ``version=N`` with a row for each rule (RULES_SCHEMA). What can't be honoured - a faulty pattern, a capture that is not there,
an id that stands twice, no rule at all - is refused as a whole, and the version before stays; refused() says why.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..sources.rules import RULES_SCHEMA, Rule, Scanner, rules_table


class Versions:
    """The versions at path; what is known to be sound, or faulty, is not read again."""

    def __init__(self, spark: SparkSession, path: str, settings: Scanner = Scanner()):
        """settings: allowed secrets and the use of entropies, for all versions."""
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.sound: dict[int, Scanner] = {}
        self.faults: dict[int, str] = {}

    def numbers(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
        whole = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/_SUCCESS"))]
        return sorted(int(n.removeprefix("version=")) for n in whole if n.startswith("version="))

    def publish(self, rules: list[Rule] | tuple[Rule, ...] | DataFrame) -> int:
        """Writes the next version; it is looked at when a batch comes. Two writers of one version: the second one fails."""
        n = max(self.numbers(), default=0) + 1
        table = rules if isinstance(rules, DataFrame) else rules_table(self.spark, rules)
        table.select("id", "regex", "keywords", "entropy", "group").write.mode("error").parquet(f"{self.path}/version={n}")
        return n

    def load(self, n: int) -> Scanner:
        """A version's scanner; ValueError if it is not sound."""
        rows = self.spark.read.schema(RULES_SCHEMA).parquet(f"{self.path}/version={n}").orderBy("id").collect()  # rules are settings: hundreds
        rules = tuple(Rule(r["id"], r["regex"], tuple(r["keywords"] or ()), r["entropy"] or 0.0, r["group"] or 0) for r in rows)
        if not rules:
            raise ValueError("no rules")
        if len({r.id for r in rules}) < len(rules) or any(r.id is None for r in rules):
            raise ValueError("ids are missing or stand twice")
        for r in rules:
            if r.regex is not None:
                try:
                    self.spark._jvm.java.util.regex.Pattern.compile(scan.compiled(r)["pattern"])
                except Exception as e:  # of the JVM too
                    raise ValueError(f"rule {r.id}: {str(e).splitlines()[0]}") from None
                if r.group and not scan.compiled(r)["captures"]:
                    raise ValueError(f"rule {r.id}: no capture {r.group}")
        return replace(self.settings, rules=rules)

    def current(self) -> tuple[int, Scanner]:
        """The newest sound version. ValueError if there is none."""
        for n in reversed(self.numbers()):
            if n not in self.sound and n not in self.faults:
                try:
                    self.sound[n] = self.load(n)
                except (ValueError, AnalysisException) as e:
                    self.faults[n] = str(e)
            if n in self.sound:
                return n, self.sound[n]
        raise ValueError(f"no sound version at {self.path}")

    def scanner(self) -> Scanner:
        return self.current()[1]

    def refused(self) -> dict[int, str]:
        return dict(self.faults)


class FindingsSink:
    """For foreachBatch: the findings of a batch by the rules of its time: keys, rule, start, end, digest, version, fingerprint. A batch that runs again replaces its rows."""

    def __init__(self, versions: Versions, path: str, keys: list[str], text: str):
        self.versions, self.path, self.keys, self.text = versions, path.rstrip("/"), keys, text

    def __call__(self, batch: DataFrame, number: int) -> None:
        version, scanner = self.versions.current()
        found = scan.find(batch, self.keys, self.text, scanner)
        out = found.select(*self.keys, "rule", "start", "end", F.sha2("secret", 256).alias("digest"), F.lit(version).alias("version"), F.lit(scanner.fingerprint()).alias("fingerprint"))
        out.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
