"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters every row with seeded hashes: its shard is the one with the highest hash of (seed, id, shard), so id
and shard count alone decide (law ``key``) and one more shard takes rows only into itself. Within the shard a further
seeded hash picks one of several buckets, as many as keep those of this shard, by its own bytes, near ``bucket_bytes``;
that hash also covers the row's place in the scan, so copies of one row spread over the buckets of their shard.

Pass two gathers each bucket, bounded by its size, puts it into a fixed order and shuffles it (Spark's ``shuffle`` draws a
Fisher-Yates permutation from a seed). Slots number the shard's rows without gaps: a running sum over the buckets' counts
gives where a bucket begins. Both passes are uniform, so the whole order is.

Null text: no bytes, CRC 0. Null id: hashed as a value of its own, so all such rows share a shard. Repeated rows: each
gets its own slot; equal ids share a shard. Empty table: empty result. Only named columns are read. An added column whose
name the rows have already is written with underscores before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import shared_dir

SHARDS, SEED, ROW_BYTES = 40, 20_240_229, 16
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 8


def shard_of(id_col: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the number with the highest seeded hash; ties go to the larger number."""
    best = F.array_max(F.array(*(F.struct(F.xxhash64(F.lit(seed), id_col, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards))))
    return best["s"]


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text and a fixed cost of the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def added_names(taken: list[str]) -> list[str]:
    """Names for size, shard, bucket and slot that no column has, whatever its case."""
    lower, out = {t.lower() for t in taken}, []
    for name in ("size", "shard", "bucket", "slot"):
        while name in lower:
            name = f"_{name}"
        out.append(name)
    return out


def shuffle_into_shards(
    rows: DataFrame, id_col: str, text_col: str, payload: list[str], shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS
) -> DataFrame:
    """(payload..., size, shard, bucket, slot): every row of ``rows``, its shard and its place in it; see ``added_names``.

    ``payload`` names the columns that travel with the rows; with the text among them the result is what ``write_shards``
    writes. ``rows`` should be read from a table, so that a lost task sees the same rows in the same order again.
    """
    weight = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in payload), F.lit(ROW_BYTES).cast("long"))
    place = shard_of(F.col(id_col), shards, seed)
    held = dict(rows.select(place.alias("s"), weight.alias("w")).groupBy("s").agg(F.sum("w")).collect())  # a row a shard
    counts = F.array(*(F.lit(max(least_buckets, -(-held.get(s, 0) // bucket_bytes))) for s in range(shards)))
    size, shard, bucket, slot = added_names(payload)
    record = F.struct(*(F.col(c) for c in payload), record_size(F.col(text_col)).alias(size))
    scattered = rows.select(record.alias("r"), place.alias("shard"), F.monotonically_increasing_id().alias("place"))
    mix = F.xxhash64(F.lit(seed + 1), "r", "place")
    scattered = scattered.withColumn("bucket", F.pmod(mix, F.element_at(counts, F.col("shard") + 1)).cast("int")).withColumn("mix", mix)
    gathered = (
        scattered.groupBy("shard", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("mix", "place", "r"))).alias("rows"))
        .sortWithinPartitions("shard", "bucket")
        .select("shard", "bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    )
    counts = gathered.select("shard", "bucket", F.size("rows").cast("long").alias("n"))
    begin = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("begin"))
    placed = gathered.join(begin, ["shard", "bucket"]).select("shard", "bucket", "begin", F.posexplode("rows").alias("at", "row"))
    return placed.select("row.r.*", F.col("shard").alias(shard), F.col("bucket").alias(bucket), (F.col("begin") + F.col("at")).alias(slot))


def write_shards(rows: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Write all columns of ``rows`` as Parquet under ``path``, a folder per shard, each sorted by slot in bucket files.

    The result reads the files back.
    """
    shuffled = shuffle_into_shards(rows, id_col, text_col, rows.columns, **options)
    _, shard, _, slot = added_names(rows.columns)
    shuffled.sortWithinPartitions(shard, slot).write.partitionBy(shard).option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(shuffled.schema).parquet(path)


def op2(docs: DataFrame) -> DataFrame:
    """Size, checksum and place of every record, from the shards as they are read back."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = write_shards(whole, shared_dir(docs.sparkSession, "shards"))
    return out.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
