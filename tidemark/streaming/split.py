"""One pass over a batch: its rows are parsed and marked once, written once, and measured while they are written.

A batch is a folder with two sides, rows that keep the rules and rows that do not; reading one side reads its files only. The
metrics are an ``Observation`` of the write itself, so they cost no job of their own and count just what was written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tidemark.operators.quality import FAILED, METRICS, QUARANTINED, WARNED, Rule, annotate

SIDE = "_side"


def observed(annotated: DataFrame, rules: Sequence[Rule], name: str) -> tuple[DataFrame, Observation]:
    """The rows, and the counts that ``measure`` makes as an observation of whatever action they are used in first."""
    seen = Observation(name)
    counts = [F.count(F.when(F.array_contains(WARNED if r.action == "warn" else FAILED, r.name), 1)).alias(r.name) for r in rules]
    return annotated.observe(seen, F.count(F.lit(1)).alias("_total"), F.count(F.when(F.size(FAILED) > 0, 1)).alias(QUARANTINED), *counts), seen


def metrics_of(spark: SparkSession, found: dict[str, int], rules: Sequence[Rule], source: str, run: str) -> DataFrame:
    """Observed counts as rows for the metrics table, a row a rule; none for an empty batch."""
    kinds = [(r.name, r.action) for r in rules] + [(QUARANTINED, "drop")]
    rows = [(run, source, name, action, found[name], found["_total"]) for name, action in kinds if found["_total"]]
    return spark.createDataFrame(rows, METRICS.rpartition(", ")[0]).withColumn("measured_at", F.current_timestamp())


class SplitTable:
    """Batches of a stream by side: ``<root>/<name>/batch=<n>/_side=good`` or ``rejected``."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, rules: Sequence[Rule]):
        self.spark, self.path, self.rules = spark, f"{root.rstrip('/')}/{name}", list(rules)
        self.name, self.columns = name, schema.names
        self.schema = StructType([*schema.fields]).add(FAILED, ArrayType(StringType())).add(WARNED, ArrayType(StringType()))

    def write(self, rows: DataFrame, batch: int) -> dict[str, int]:
        """Mark and write a batch, or write it again; returns its counts."""
        marked, seen = observed(annotate(rows, self.rules), self.rules, f"{self.name}-{batch}")
        side = F.when(F.size(FAILED) > 0, "rejected").otherwise("good")
        marked.select(*self.columns, FAILED, WARNED, side.alias(SIDE)).write.mode("overwrite").partitionBy(SIDE).parquet(f"{self.path}/batch={batch}")
        return seen.get

    def forget(self, before: int) -> None:
        """Delete the batches before one, where they were only a step on the way."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        filesystem = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in filesystem.listStatus(path(self.path)) if filesystem.exists(path(self.path)) else []:
            name = status.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) < before:
                filesystem.delete(status.getPath(), True)

    def _read(self, side: str, batch: Column) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            df = self.spark.read.schema(StructType([*self.schema.fields]).add("batch", "long").add(SIDE, "string")).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)
        return df.where((F.col(SIDE) == side) & batch).select(*self.schema.names)

    def good(self, batch: int | None = None) -> DataFrame:
        return self._read("good", F.lit(True) if batch is None else F.col("batch") == batch).drop(FAILED, WARNED)

    def rejected(self, batch: int | None = None) -> DataFrame:
        """With the names of the rules that they break."""
        return self._read("rejected", F.lit(True) if batch is None else F.col("batch") == batch)
