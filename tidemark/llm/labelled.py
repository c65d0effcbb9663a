"""Bounded samples of labelled documents, and the calibration that both classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import TEXT_BYTES, slices, written

#: A document is predicted positive from this score on.
THRESHOLD = 0.3


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, held: Callable[[Column], Column], rows_per_class: int) -> DataFrame:
    """(text, label 0/1, part 0/1): up to ``rows_per_class`` labelled rows of each class, none of them held out.

    The ids with the smallest seeded hashes are taken, so the choice does not depend on order; ``rows_per_class`` bounds them
    and so their broadcast. An id that has both labels is not used. Of documents that repeat an id the smallest text counts,
    so there are not more rows than ids. ``part`` splits the sample in two by another hash.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held(F.col("doc_id")))
    sure = usable.groupBy(F.col("doc_id").alias("__id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).where("label = other")
    order = [F.xxhash64(F.lit(11), "__id"), F.col("__id")]
    picked = [sure.where(F.col("label") == c).select("__id", "label").orderBy(*order).limit(rows_per_class) for c in (0, 1)]
    joined = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), F.col("doc_id") == F.col("__id"))
    once = joined.groupBy("__id", "label").agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    part = F.pmod(F.xxhash64(F.lit(12), "__id"), F.lit(2)).cast("int")
    return written(docs.sparkSession, once.select("text", "label", part.alias("part")), "labelled")


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, weights) of a ridge logistic regression by Newton steps; constant if a class is missing."""
    width = features.shape[1]
    centre, scale = (features.mean(0), features.std(0)) if len(features) else (np.zeros(width), np.ones(width))
    scale = np.where(scale > 1e-12, scale, 1.0)
    weights = np.zeros(width + 1)
    positive = (labels.sum() + 0.5) / (len(labels) + 1)
    weights[0] = np.log(positive / (1 - positive))
    if len(labels) and 0 < labels.sum() < len(labels):
        x = np.hstack([np.ones((len(features), 1)), (features - centre) / scale])
        penalty = ridge * np.diag([1e-9] + [1.0] * width)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -35, 35)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(width + 1), x.T @ (p - labels) + penalty @ weights)
            weights = weights - step
            if np.abs(step).max() < 1e-9:
                break
    return centre, scale, weights


def logistic(model: tuple[np.ndarray, np.ndarray, np.ndarray], features: np.ndarray) -> np.ndarray:
    centre, scale, weights = model
    return 1 / (1 + np.exp(-np.clip(weights[0] + (features - centre) / scale @ weights[1:], -35, 35)))


def score_rows(docs: DataFrame, scorer: Callable[[], Callable[[list], np.ndarray]], held: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; ``scorer()`` is made once a task."""
    schema = "doc_id long, held_out boolean, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in slices(batches, most_bytes=TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score(batch.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_rows(docs: DataFrame, scorer: Callable[[], Callable[[list], np.ndarray]], positive: bool) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted positive (or those that are not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in slices(batches, most_bytes=TEXT_BYTES):
            yield batch.filter(pa.array((score(batch.column("text").to_pylist()) >= THRESHOLD) == positive))

    return docs.mapInArrow(run, docs.schema)
