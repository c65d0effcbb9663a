"""Tolerant file sources: every field a string, unknown fields rescued, each file loaded once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

RESCUED, FILE, MODIFIED, INGESTED = "_rescued_data", "_source_file", "_file_modified_at", "_ingested_at"


def string_schema(names: Sequence[str]) -> StructType:
    """Nullable strings; nested JSON arrives as its text."""
    return StructType([StructField(n, StringType()) for n in names])


def file_columns() -> list[Column]:
    """Where a record came from; to be selected straight off a file source."""
    return [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_modification_time").alias(MODIFIED), F.current_timestamp().alias(INGESTED)]


def rescue(line: Column, names: Sequence[str]) -> Column:
    """The fields of a JSON record that are not among ``names``, as JSON; NULL if there are none.

    A line that is no JSON object is kept whole.
    """
    fields = F.from_json(line, MapType(StringType(), StringType()))  # NULL for an array, a number, a string, null and what is no JSON
    known = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    unknown = F.map_filter(fields, lambda k, _: ~F.array_contains(known, k))
    return F.when(fields.isNull(), line).when(F.size(unknown) > 0, F.to_json(unknown))


def _json_records(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    parsed = lines.select(F.from_json("value", string_schema(names)).alias("r"), rescue(F.col("value"), names).alias(RESCUED), *file_columns())
    return parsed.select(*(F.col(f"r.{n}").alias(n) for n in names), RESCUED, FILE, MODIFIED, INGESTED)


def read_json(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return _json_records(spark.read.option("pathGlobFilter", "*.json").text(path), names)


def stream_json(spark: SparkSession, path: str, names: Sequence[str], files_per_trigger: int | None = None) -> DataFrame:
    """New JSON-lines files; others, such as ``*.tmp`` being written, are passed over."""
    reader = spark.readStream.option("pathGlobFilter", "*.json")
    return _json_records((reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).text(path), names)


def _csv_records(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names, F.lit(None).cast("string").alias(RESCUED), *file_columns())


def read_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return _csv_records(spark.read.schema(string_schema(names)).option("pathGlobFilter", "*.csv").option("header", True).option("enforceSchema", False).csv(path), names)


def stream_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return _csv_records(spark.readStream.schema(string_schema(names)).option("pathGlobFilter", "*.csv").option("header", True).csv(path), names)


def stream_files(spark: SparkSession, path: str, kind: str, names: Sequence[str]) -> DataFrame:
    return {"json": stream_json, "csv": stream_csv}[kind](spark, path, names)


def new_files_only(records: DataFrame, target: DataFrame | None, force: bool = False) -> DataFrame:
    """Records of files that ``target`` has no row of; all of them with ``force`` or without a target."""
    if force or target is None:
        return records
    return records.join(target.select(FILE).distinct(), FILE, "left_anti")


def read_json_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Names inferred, values all strings; nested fields become JSON text."""
    df = spark.read.option("primitivesAsString", True).json(path)
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (StructType, ArrayType, MapType))}
    return df.select(*((F.to_json(c) if c in nested else F.col(c)).alias(c) for c in df.columns), *file_columns())


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An append-only Parquet table as a stream."""
    return spark.readStream.schema(schema).parquet(path)
