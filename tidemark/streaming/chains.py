"""Chains of streams in one session: each step runs on its own trigger and reads what the step before it has written.

A step's sink is a Parquet folder with Spark's own log of committed files, which the next step's file source reads, so every
row goes through each step once. A listener follows all steps; a step that fails is reported and the others are stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from tidemark.streaming.runs import Report, trigger


@dataclass(frozen=True)
class Step:
    """``build`` makes the step's frame from the stream that it reads: the source's for the first, else the step's before it."""

    name: str
    build: Callable[[DataFrame], DataFrame]
    when: str = "processingTime=1 second"


@dataclass
class Watch(StreamingQueryListener):
    """What has been seen of the queries whose ids are in ``names``."""

    names: dict[str, str] = field(default_factory=dict)
    batches: dict[str, set[int]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    ended: dict[str, str | None] = field(default_factory=dict)

    def __post_init__(self):
        super().__init__()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        name = self.names.get(str(progress.id))
        if name and progress.batchId not in self.batches.setdefault(name, set()):
            if progress.numInputRows:
                self.batches[name].add(progress.batchId)
            self.rows[name] = self.rows.get(name, 0) + progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if name := self.names.get(str(event.id)):
            self.ended[name] = event.exception


class ChainError(RuntimeError):
    """A step has failed."""


class Chain:
    """Steps under ``root``: ``<root>/<step>/out`` has what a step wrote, ``<root>/<step>/checkpoint`` how far it is."""

    def __init__(self, spark: SparkSession, root: str, source: DataFrame, steps: Sequence[Step]):
        if len({s.name for s in steps}) != len(steps) or not steps:
            raise ValueError("a chain has steps, each with a name of its own")
        self.spark, self.root, self.source, self.steps = spark, root.rstrip("/"), source, list(steps)
        self.queries: list[StreamingQuery] = []
        self.watch = Watch()

    def out(self, step: str) -> str:
        return f"{self.root}/{step}/out"

    def start(self) -> Chain:
        """Start all steps; with checkpoints from before, each goes on where it was."""
        self.spark.streams.addListener(self.watch)
        stream = self.source
        try:
            for step in self.steps:
                frame = step.build(stream)
                writer = frame.writeStream.queryName(step.name).option("checkpointLocation", f"{self.root}/{step.name}/checkpoint").trigger(**trigger(step.when))
                self._prepare(step.name, frame.schema)
                query = writer.format("parquet").outputMode("append").option("path", self.out(step.name)).start()
                self.watch.names[str(query.id)] = step.name
                self.queries.append(query)
                stream = self.spark.readStream.schema(frame.schema).parquet(self.out(step.name))
        except BaseException:
            self.stop()
            raise
        return self

    def _prepare(self, step: str, schema: StructType) -> None:
        """The folder that a step writes to has to be there before the next one reads it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.out(step))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)

    def check(self) -> None:
        """Raise if a step has failed, once the others are stopped."""
        for step, query in zip(self.steps, self.queries, strict=False):
            if error := query.exception():
                self.stop()
                raise ChainError(f"step {step.name}: {error}") from error

    def drain(self) -> None:
        """Wait until all that the source has now is through the last step, windows that the watermark has closed included."""
        for query in self.queries:
            try:
                query.processAllAvailable()
            except Exception:
                self.check()
                raise
        self.check()

    def stop(self, patience: float = 60.0) -> None:
        """End all steps, the first one first, so that none waits for more; a batch that is running is run again next time."""
        for query in self.queries:
            query.stop()
        limit = time.monotonic() + patience
        while time.monotonic() < limit and any(n not in self.watch.ended for n in self.watch.names.values()):
            time.sleep(0.05)  # the listener hears of it later
        self.spark.streams.removeListener(self.watch)

    def reports(self) -> list[Report]:
        return [Report(s.name, len(self.watch.batches.get(s.name, ())), self.watch.rows.get(s.name, 0)) for s in self.steps]

    def __enter__(self) -> Chain:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()
