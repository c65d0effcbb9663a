"""Late rows: those behind the watermark are kept apart instead of dropped, and can be worked in later.

The watermark of a batch is the newest time of all batches before it, less a delay, as it is for Spark's own operators.
Each batch writes its newest time beside its rows, so a batch that is run again finds the same watermark, and sorts the same
rows out: nothing depends on what a query remembers in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.tables import AppendedTable

NEWEST = StructType().add("batch", "long").add("newest", "timestamp")


class LateRows:
    """Rows of a stream as two appended tables: ``on_time`` and ``late``. A row without a time is late: no window can have it."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, time: str, delay: str = "30 minutes"):
        self.time, self.delay = time, F.expr(f"interval {delay}")
        self.on_time, self.late = (AppendedTable(spark, root, f"{name}_{part}", schema) for part in ("on_time", "late"))
        self.newest = AppendedTable(spark, root, f"{name}_newest", StructType().add("newest", "timestamp"))

    def watermark(self, batch: int) -> Column:
        """The watermark of a batch as a literal; NULL for the first."""
        value = self.newest.read(before=batch).agg((F.max("newest") - self.delay).alias("w")).first()[0]  # a row a batch
        return F.lit(value).cast("timestamp")

    def is_late(self, batch: int) -> Column:
        at = F.col(self.time).cast("timestamp")
        return at.isNull() | F.coalesce(at < self.watermark(batch), F.lit(False))

    def handle(self, rows: DataFrame, batch: int) -> None:
        """A batch handler: the rows are held while both sides are written, so the batch is computed once."""
        late, held = self.is_late(batch), rows.persist()
        try:
            self.on_time.write(held.where(~late), batch)
            self.late.write(held.where(late), batch)
            self.newest.write(held.agg(F.max(F.col(self.time).cast("timestamp")).alias("newest")), batch)
        finally:
            held.unpersist()


def corrected(windows: DataFrame, late: DataFrame, time: str, keys: Sequence[str], length: str, count: Callable[[], Column] = lambda: F.count("*")) -> DataFrame:
    """Windowed counts (window_start, keys..., events) with late rows worked in: only windows that have any change."""
    more = late.where(F.col(time).isNotNull()).groupBy(F.window(F.col(time).cast("timestamp"), length)["start"].alias("window_start"), *keys).agg(count().alias("events"))
    return windows.select("window_start", *keys, "events").unionByName(more).groupBy("window_start", *keys).agg(F.sum("events").alias("events"))
