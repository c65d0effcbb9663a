"""Kafka records to the raw layer's shape. The decoding works on any DataFrame with a Kafka source's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import FILE, INGESTED, MODIFIED, RESCUED, rescue, stream_files, string_schema


def decode(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fields of the JSON value; a value that is no JSON object is kept whole in ``_rescued_data``."""
    value = F.col("value").cast("string")
    parsed = records.select(F.from_json(value, string_schema(names)).alias("r"), rescue(value, names).alias(RESCUED), F.format_string("kafka://%s/%d/%d", "topic", "partition", "offset").alias(FILE), F.col("timestamp").alias(MODIFIED), F.current_timestamp().alias(INGESTED))
    return parsed.select(*(F.col(f"r.{n}").alias(n) for n in names), RESCUED, FILE, MODIFIED, INGESTED)


def stream_kafka(spark: SparkSession, servers: str, topic: str, names: Sequence[str], starting: str = "earliest") -> DataFrame:
    """Needs the Kafka connector on the class path."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return decode(source.option("startingOffsets", starting).option("failOnDataLoss", "false").load(), names)


def stream_records(spark: SparkSession, source: str, names: Sequence[str], **options: str) -> DataFrame:
    """One shape from either source: ``files`` (path, kind) or ``kafka`` (servers, topic)."""
    if source == "files":
        return stream_files(spark, options["path"], options.get("kind", "json"), names)
    if source == "kafka":
        return stream_kafka(spark, options["servers"], options["topic"], names, options.get("starting", "earliest"))
    raise ValueError(f"unknown source {source!r}")
