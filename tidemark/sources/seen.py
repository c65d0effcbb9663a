"""Which keys have been seen: an index in parts by hash, so that a batch reads only what its keys can be in.

Each part has the keys whose hash falls into it, and bitmaps of their hashes, two bits a key. A key whose bits are not all
set is new, and no key is read for it. The others are looked up in their parts, and the other parts are not read. Batch n
writes version ``2 n`` of both tables from what was before it, so a batch that is run again writes the same again; ``fold`` puts
small files together under the odd number after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.tables import VersionedTable

#: Bits of one of Spark's bitmaps.
BITS = 32_768


def _bit(bitmap: Column, place: Column) -> Column:
    """Whether a bit of a bitmap is set; NULL for no bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


class SeenKeys:
    """``schema``: of the keys. ``parts`` is how finely keys are read, ``maps`` how many bitmaps a part has: about a tenth of ``BITS``
    keys a bitmap keeps wrong guesses near 3 in 100. Both are fixed for the life of an index."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, parts: int = 32, maps: int = 16):
        self.names, self.parts, self.maps = schema.names, parts, maps
        self.keys = VersionedTable(spark, root, f"{name}_keys", StructType([*schema.fields]), buckets=(self.names, parts))
        self.filters = VersionedTable(spark, root, f"{name}_filters", StructType().add("part", "string").add("map", "long").add("bits", "binary"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their part, bitmap and two places in it, all from one hash."""
        h = F.xxhash64(*self.names)
        at = lambda shift: F.pmod(F.shiftright(F.col("_h"), shift), F.lit(BITS))
        placed = rows.withColumns({"_part": self.keys.part, "_h": F.xxhash64(h, F.lit(1))})
        return placed.withColumns({"_map": F.pmod(F.shiftright(F.col("_h"), 40), F.lit(self.maps)), "_a": at(0), "_b": at(17)}).drop("_h")

    def unseen(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """Rows, one a key, whose key no batch before ``batch`` had."""
        before = None if batch is None else 2 * batch
        once = self._placed(rows.dropDuplicates(self.names))
        filters = self.filters.parts(before=before)
        if not filters:
            return once.select(*rows.columns)
        held = self.filters.read_parts(filters).select(F.col("part").alias("_part"), F.col("map").alias("_map"), "bits")
        tested = once.join(held, ["_part", "_map"], "left")
        tested = tested.withColumn("_maybe", F.coalesce(_bit(F.col("bits"), F.col("_a")) & _bit(F.col("bits"), F.col("_b")), F.lit(False))).drop("bits")
        doubtful = {r[0] for r in tested.where("_maybe").select("_part").distinct().collect()}  # a row a part at most
        known = self.known(doubtful, before).select(*self.names, F.lit(True).alias("_known"))
        same = [tested[k].eqNullSafe(known[k]) for k in self.names]
        return tested.join(known, same, "left_anti").select(*rows.columns)

    def known(self, parts: set[str], before: int | None = None) -> DataFrame:
        return self.keys.read_parts(x for x in self.keys.parts(before=before) if x[1] in parts)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Remember the keys of a batch, which were unseen before it."""
        version = 2 * batch
        self.keys.append(rows.select(*self.names), version)
        placed = self._placed(rows.select(*self.names)).select("_part", "_map", F.explode(F.array("_a", "_b")).alias("at"))
        new = placed.groupBy(F.col("_part").alias("part"), F.col("_map").alias("map")).agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
        old = self.filters.read(before=version)
        self.filters.overwrite(old.unionByName(new).groupBy("part", "map").agg(F.expr("bitmap_or_agg(bits)").alias("bits")), version)

    def fold(self, batch: int, target_bytes: int = 128 << 20) -> list[str]:
        """After a batch: put together the small files of each part, and drop what only older batches read."""
        parts = self.keys.compact(target_bytes, self.names[:1], version=2 * batch + 1)
        for table in (self.keys, self.filters):
            table.vacuum(keep=3)
        return parts
