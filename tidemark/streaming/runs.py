"""Running streams: triggers, reports, resets, idempotent batches, windows and de-duplication within a watermark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.merge import insert_new
from tidemark.operators.quality import QualityError, Rule, quarantine
from tidemark.sources.seen import SeenKeys
from tidemark.sources.tables import AppendedTable, VersionedTable
from tidemark.streaming.split import SplitTable, metrics_of


#: A window's sketch of its sessions has 2 to this power places.
SKETCH = 12


@dataclass(frozen=True)
class Report:
    name: str
    batches: int
    input_rows: int


def trigger(choice: str) -> dict:
    """``availableNow`` or ``processingTime=<interval>``, as keywords of ``writeStream.trigger``."""
    if choice == "availableNow":
        return {"availableNow": True}
    kind, _, interval = choice.partition("=")
    if kind != "processingTime" or not interval.strip():
        raise ValueError(f"unknown trigger {choice!r}")
    return {"processingTime": interval.strip()}


def run_stream(df: DataFrame, name: str, checkpoint: str, path: str | None = None, handler: Callable[[DataFrame, int], None] | None = None, when: str = "availableNow", timeout: float | None = None) -> Report:
    """Run a stream into a Parquet folder or a batch handler, exactly one of them, and report once it has ended."""
    if (path is None) == (handler is None):
        raise ValueError("give a path or a handler")
    writer = df.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(**trigger(when))
    query = writer.foreachBatch(handler).start() if handler else writer.format("parquet").outputMode("append").option("path", path).start()
    if not query.awaitTermination(timeout) if timeout else query.awaitTermination():
        query.stop()
    progress = query.recentProgress
    return Report(name, sum(1 for p in progress if p["numInputRows"]), sum(p["numInputRows"] for p in progress))


def reset_stream(spark, checkpoint: str, *tables: VersionedTable) -> None:
    """Forget a stream's progress and empty its targets, so that the next run replays the source."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for table in tables:
        table.delete_all()


def windowed_counts(events: DataFrame, time: str, kind: str, session: str | None, length: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Tumbling windows with a watermark: events, and about how many sessions, by kind. Later rows are dropped.

    Sessions are counted by sketches of 2 ** ``SKETCH`` places, which list what they have seen while that is little: a few hundred
    sessions are told exactly but for collisions of hashes, more with a standard error under 1.7 in 100.
    """
    hashed = F.when(F.col(session).isNotNull(), F.xxhash64(session)) if session else None
    counts = [F.count("*").alias("events")] + ([F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(SKETCH))).alias("sessions")] if session else [])
    grouped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, length), kind).agg(*counts)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, *(c for c in ("events", "sessions") if c in grouped.columns))


def deduplicate_stream(events: DataFrame, keys: Sequence[str], time: str, within: str = "2 hours") -> DataFrame:
    """Each key once; a key is forgotten once the watermark is ``within`` past it."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def checked(batch: DataFrame, rules: Sequence[Rule], source: str, key: str, payload: str, file: str, batch_id: int, metrics: AppendedTable, rejected: AppendedTable, staged: str) -> DataFrame:
    """The batch's valid rows. Metrics and rejected rows are slices of their batch, so a retry replaces them.

    The batch is parsed, marked and written once, under ``staged``, and measured by that write; what comes after it reads the
    written rows. Those of earlier batches are deleted, for a batch begins once the one before it is done.
    """
    split = SplitTable(batch.sparkSession, staged, source, batch.schema, rules)
    split.forget(before=batch_id)
    run, found = f"{source}-{batch_id}", split.write(batch, batch_id)
    metrics.write(metrics_of(batch.sparkSession, found, rules, source, run), batch_id)
    rejected.write(quarantine(split.rejected(batch_id), source, key, payload, file, run), batch_id)
    if failed := {r.name: found[r.name] for r in rules if r.action == "fail" and found[r.name]}:
        raise QualityError(f"rows break {failed}")
    return split.good(batch_id)


def merge_handler(table: VersionedTable, prepare: Callable[[DataFrame, int], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 10) -> Callable[[DataFrame, int], None]:
    """A handler that makes version N from the newest one before N: a retried batch writes the same version again.

    Of a table with buckets it writes those that hold the batch's keys. The newest ``keep`` versions stay, two at least.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.merge(prepare(batch, batch_id), merge, version=batch_id)
        table.vacuum(max(keep, 2))

    return handle


def insert_handler(table: AppendedTable, prepare: Callable[[DataFrame, int], DataFrame], keys: Sequence[str], date: str | None = None, seen: SeenKeys | None = None, fold_every: int = 50) -> Callable[[DataFrame, int], None]:
    """A handler that appends unseen keys; batch N is compared with the batches before it, so a retry is harmless.

    With ``seen``, an index of the keys, only those of its parts are read that keys of the batch may be in; without it the table
    itself, or its rows within the batch's dates.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if seen is None:
            table.write(insert_new(table.read(before=batch_id), prepare(batch, batch_id), keys, date), batch_id)
            return
        rows = prepare(batch, batch_id).persist()  # looked at twice: where its keys may be, and which they are
        try:
            table.write(seen.unseen(rows, batch_id), batch_id)
        finally:
            rows.unpersist()
        seen.add(table.read_batch(batch_id), batch_id)
        if batch_id % fold_every == fold_every - 1:
            seen.fold(batch_id)

    return handle


def split_handler(table: SplitTable, metrics: AppendedTable, source: str) -> Callable[[DataFrame, int], None]:
    """A handler for both sinks of a stream: a batch is parsed once, its rows go to either side, and the write counts them."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = table.write(batch, batch_id)
        metrics.write(metrics_of(batch.sparkSession, found, table.rules, source, f"{source}-{batch_id}"), batch_id)

    return handle


def split_stream(parsed: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """A parsed stream as two streams for sinks that are no tables of ours; each query parses on its own. See ``split_handler``."""
    from tidemark.operators.quality import broken, expect_all_or_drop

    return expect_all_or_drop(parsed, rules), broken(parsed, rules)
