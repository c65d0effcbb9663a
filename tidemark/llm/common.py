"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Bytes of text that a task holds as Python objects at a time, where a function makes many small objects of them.
TEXT_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and every executor can reach.

    It lies under ``spark.checkpoint.dir`` of the session. Only where that is unset, as in tests on one
    machine, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    path = shared_dir(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table_ in tables:
        spark = table_.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table_.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@lru_cache(maxsize=1)
def one_thread() -> int:
    """Let matrix products use one thread in this process: an executor runs as many tasks as it has cores already.

    Returns how many libraries were told so; without a library that can be told, nothing happens.
    """
    import ctypes

    try:
        with open("/proc/self/maps") as maps:
            loaded = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:
        return 0
    told = 0
    for path in loaded:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                told += 1
                break
    return told


def give_back() -> None:
    """Return memory that is free in this process to the system: a worker is kept between tasks, and an executor's memory counts with its workers'."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of so many rows, or of so many bytes or one row, so that few are held as Python objects at a time."""
    one_thread()
    for batch in batches:
        if most_bytes is None:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
            continue
        sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)), np.full(batch.num_rows, 8, np.int64))
        begin = before = 0
        ends = np.cumsum(sizes)
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin, before = end, int(ends[end - 1])


def map_batches(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str, setup: Callable | None = None, most_bytes: int | None = None) -> DataFrame:
    """``mapInArrow`` over columns as Python lists; ``function(columns, state)`` gets what ``setup()`` made once a task."""
    target = arrow_schema(df.sparkSession, schema)

    def mapped(batch: pa.RecordBatch, state: object) -> pa.RecordBatch:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        out = function(columns, state)
        arrays = [v.cast(f.type) if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in target]
        return pa.RecordBatch.from_arrays(arrays, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in slices(batches, most_bytes=most_bytes):
            yield mapped(batch, state)
            pa.default_memory_pool().release_unused()
        batch = state = None
        give_back()

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies: in ``TIDEMARK_TOKENIZERS`` if set, else as its package says."""
    if folder := os.environ.get("TIDEMARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
