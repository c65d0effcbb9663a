"""Parquet tables in version folders, so that a rewrite never touches what is being read and a replay is harmless.

``<root>/<table>/data/_v=<n>/_part=<p>`` holds what version n wrote of part p, and ``<root>/<table>/parts/v=<n>``, written
last, lists the folders that make up the table as of version n. A version so writes only the parts that change: the values
of a column, buckets of a key, or the whole table as one part. Insert-only tables keep ``<root>/<table>/batch=<n>``. This
is a naming habit: there is no log and no concurrency control.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


Part = tuple[int, str]  # the version that wrote a folder, and the part it holds


def part_name(value: Column) -> Column:
    """A folder name for each value: as it is where file systems and Spark leave it alone, else in hexadecimal."""
    text = value.cast("string")
    plain = text.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$") & ~text.startswith("hex.")
    return F.when(text.isNull(), "null").when(plain, text).otherwise(F.concat(F.lit("hex."), F.hex(text)))


def interleaved(columns: Sequence[str], ranges: int = 64) -> Column:
    """A Z-order value of number, date or time columns, for sorting: near rows are near in every column.

    Columns are put on a scale of ``ranges`` equal parts of their own range by ``scaled``, and their bits are woven together.
    """
    bits = [((F.shiftright(F.col(f"_z_{c}"), b) % 2).cast("long"), b * len(columns) + i) for i, c in enumerate(columns) for b in range(ranges.bit_length() - 1)]
    return reduce(Column.__add__, (F.shiftleft(v, at) for v, at in bits), F.lit(0).cast("long"))


def scaled(df: DataFrame, columns: Sequence[str], ranges: int = 64) -> DataFrame:
    """``df`` with ``_z_<column>`` for each column: the rank of its quantile among ``ranges``, 0 for NULL."""
    as_number = lambda c: F.col(c).cast("timestamp").cast("double") if dict(df.dtypes)[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c).cast("double")
    edges = df.agg(*(F.percentile_approx(as_number(c), [i / ranges for i in range(1, ranges)], 1000).alias(c) for c in columns)).first()  # one row of fixed size
    rank = lambda c: F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges[c] or [])).cast("array<double>"), lambda e: e < as_number(c))), F.lit(0))
    return df.withColumns({f"_z_{c}": rank(c) for c in columns})


class VersionedTable:
    """``partition``: a column or expression each of whose values is a part; ``buckets``: (keys, number), so that a merge by these keys
    rewrites only the buckets with changed keys. There are as many parts as values or buckets, which the driver lists."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, partition: str | Column | None = None, buckets: tuple[Sequence[str], int] | None = None):
        self.spark, self.path, self.schema = spark, f"{root.rstrip('/')}/{name}", schema
        self.divided = bool(buckets) or partition is not None
        if buckets:
            self.part = F.pmod(F.xxhash64(*buckets[0]), F.lit(buckets[1])).cast("string")
        else:
            value = F.col(partition) if isinstance(partition, str) else partition
            self.part = F.lit("all") if value is None else part_name(value)

    def _filesystem(self):
        """The Hadoop file system of the path, as Spark sees it."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str, prefix: str) -> list[str]:
        filesystem, path = self._filesystem()
        if not filesystem.exists(path(folder)):
            return []
        return [n.removeprefix(prefix) for n in (s.getPath().getName() for s in filesystem.listStatus(path(folder))) if n.startswith(prefix)]

    def versions(self) -> list[int]:
        filesystem, path = self._filesystem()
        numbers = sorted(int(n) for n in self._names(f"{self.path}/parts", "v=") if n.isdigit())
        return [n for n in numbers if filesystem.exists(path(f"{self.path}/parts/v={n}/_SUCCESS"))]

    def parts(self, version: int | None = None, before: int | None = None) -> set[Part]:
        """The folders of a version, by default the newest (older than ``before``)."""
        if version is None:
            known = [v for v in self.versions() if before is None or v < before]
            if not known:
                return set()
            version = known[-1]
        return {(r["v"], r["part"]) for r in self.spark.read.schema("v long, part string").parquet(f"{self.path}/parts/v={version}").collect()}

    def folder(self, part: Part) -> str:
        return f"{self.path}/data/_v={part[0]}/_part={part[1]}"

    def read_parts(self, parts: Iterable[Part]) -> DataFrame:
        """The rows of these folders; no other is listed or read."""
        folders = [self.folder(p) for p in sorted(parts)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None, before: int | None = None) -> DataFrame:
        """A version, by default the newest (older than ``before``); an empty frame if there is none."""
        return self.read_parts(self.parts(version, before))

    def sizes(self, parts: Iterable[Part]) -> dict[Part, list[int]]:
        """Bytes of the files of each folder."""
        filesystem, path = self._filesystem()
        return {p: [s.getLen() for s in filesystem.listStatus(path(self.folder(p))) if s.getPath().getName().endswith(".parquet")] for p in parts}

    def _write(self, df: DataFrame, kept: set[Part], version: int | None, sort_by: Sequence[str] = ()) -> int:
        """Write the rows as the next version, or again as the given one, which also has the folders in ``kept``.

        The rows of a part are gathered first, and large parts are split again by Spark, so that tasks do not each write a file to every part.
        """
        out = df.select(*self.schema.names).withColumn("_part", self.part)
        if self.divided:
            out = out.hint("rebalance", "_part")
        if sort_by:
            out = out.sortWithinPartitions("_part", *sort_by)
        return self._finish(out, kept, version)

    def _finish(self, out: DataFrame, kept: set[Part], version: int | None) -> int:
        version = version if version is not None else (self.versions() or [-1])[-1] + 1
        data = f"{self.path}/data/_v={version}"
        out.write.mode("overwrite").partitionBy("_part").parquet(data)
        parts = kept | {(version, p) for p in self._names(data, "_part=")}
        self.spark.createDataFrame(sorted(parts), "v long, part string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts/v={version}")
        return version

    def overwrite(self, df: DataFrame, version: int | None = None, sort_by: Sequence[str] = ()) -> int:
        """Write the next version, or replace the given one; returns its number."""
        return self._write(df, set(), version, sort_by)

    def touched(self, rows: DataFrame) -> set[str]:
        """The parts that rows belong to."""
        return {r[0] for r in rows.select(self.part).distinct().collect()}  # a row a part at most

    def merge(self, changes: DataFrame, function: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> int:
        """``function(state, changes)`` over the parts that hold changes; the others stay where they are.

        Both sides are of the same parts, so the function must not move rows from one to another.
        """
        known, touched = self.parts(before=version), self.touched(changes)
        state = self.read_parts(x for x in known if x[1] in touched)
        return self._write(function(state, changes), {x for x in known if x[1] not in touched}, version)

    def replace_where(self, df: DataFrame, predicate: Column) -> int:
        """Rows that match ``predicate`` are replaced by ``df``, whose rows must all match; parts without such rows stay."""
        inside = F.coalesce(predicate, F.lit(False))
        new = kept(df.select(*self.schema.names), "replacing")  # looked at before it is written
        if not new.where(~inside).isEmpty():
            raise ValueError("new rows do not match the predicate")
        known = self.parts()
        touched = self.touched(self.read_parts(known).where(inside))
        rest = self.read_parts(x for x in known if x[1] in touched).where(~inside)
        return self._write(rest.unionByName(new), {x for x in known if x[1] not in touched}, None)

    def append(self, df: DataFrame, version: int | None = None) -> int:
        """The same folders and one more for each part that gets rows."""
        return self._write(df, self.parts(before=version), version)

    def delete_all(self) -> int:
        return self.overwrite(self.spark.createDataFrame([], self.schema))

    def diff(self, before: int | None, after: int, keys: Sequence[str], images: bool = True) -> DataFrame:
        """The changes between two versions (``None``: from nothing), as ``snapshot_diff`` tells them.

        Folders that both versions have hold the same rows, so only the others are read: the work grows with what was written
        between the two. A key whose part changed is in a written folder on both sides.
        """
        from tidemark.operators.merge import snapshot_diff

        old, new = self.parts(before) if before is not None else set(), self.parts(after)
        return snapshot_diff(self.read_parts(old - new), self.read_parts(new - old), keys, images)

    def compact(self, target_bytes: int = 128 << 20, cluster: Sequence[str] = (), version: int | None = None) -> list[str]:
        """Rewrite the parts with small files, into files of about ``target_bytes``; other parts stay where they are.

        A part is rewritten if two or more of its files are under half the target. Its rows are dealt out in ranges of ``cluster``,
        one column or a Z-order of several, and each part gets as many ranges as its bytes ask for. Returns the parts.
        """
        known = self.parts(before=version)
        by_part: dict[str, list[int]] = {}
        for (_, part), sizes in self.sizes(known).items():
            by_part.setdefault(part, []).extend(sizes)
        small = {p: sizes for p, sizes in by_part.items() if sum(s < target_bytes / 2 for s in sizes) > 1}
        if not small:
            return []
        rows = self.read_parts(x for x in known if x[1] in small).withColumn("_part", self.part)
        order = [F.col(c) for c in cluster]
        if len(cluster) > 1:
            rows, order = scaled(rows, cluster), [interleaved(cluster)]
        files = {p: max(1, -(-sum(sizes) // target_bytes)) for p, sizes in small.items()}
        ranges = [F.col("_part"), *(order or [F.xxhash64(*self.schema.names)])]
        out = rows.repartitionByRange(sum(files.values()), *ranges).sortWithinPartitions(*ranges)
        self._finish(out.select(*self.schema.names, "_part"), {x for x in known if x[1] not in small}, version)
        return sorted(small)

    def vacuum(self, keep: int = 2) -> list[Part]:
        """Forget all versions but the newest ``keep`` and delete the folders that none of those needs; returns what was deleted."""
        filesystem, path = self._filesystem()
        known = self.versions()
        needed = set().union(*(self.parts(n) for n in known[-keep:]))
        for n in known[:-keep]:
            filesystem.delete(path(f"{self.path}/parts/v={n}"), True)
        gone = []
        for n in sorted(int(n) for n in self._names(f"{self.path}/data", "_v=")):
            if not known or n >= known[-1]:  # what is being written
                continue
            own = {(n, p) for p in self._names(f"{self.path}/data/_v={n}", "_part=")}
            for part in sorted(own - needed):
                filesystem.delete(path(self.folder(part)), True)
                gone.append(part)
            if not own & needed:
                filesystem.delete(path(f"{self.path}/data/_v={n}"), True)
        return gone

    def is_empty(self) -> bool:
        return self.read().isEmpty()


class AppendedTable:
    """An insert-only table: a batch is a folder, and writing it again replaces it."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType):
        self.spark, self.path, self.schema = spark, f"{root.rstrip('/')}/{name}", schema

    def read(self, before: int | None = None) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            df = self.spark.read.schema(StructType([*self.schema.fields]).add("batch", "long")).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)
        return (df if before is None else df.where(F.col("batch") < before)).select(*self.schema.names)

    def read_batch(self, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch}")

    def write(self, df: DataFrame, batch: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def next_batch(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        filesystem = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in filesystem.listStatus(path)] if filesystem.exists(path) else []
        return max([int(n[6:]) + 1 for n in names if n.startswith("batch=")], default=0)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def analyze(spark: SparkSession, table: str) -> None:
    """Statistics of all columns of a catalogue table, for the cost-based optimiser."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def export_changes(diff: DataFrame, where: Column, path: str, files: int | None = None) -> int:
    """Inserted rows and new images that match ``where``, as JSON lines; returns how many. Write the bookmark after it.

    The rows are counted while they are written, by the tasks that find them; only with ``files`` they are gathered for that many.
    """
    seen = Observation()
    rows = diff.where(F.col("_change_type").isin("insert", "update_postimage") & where).observe(seen, F.count(F.lit(1)).alias("n"))
    (rows.repartition(files) if files else rows).write.json(path)
    if not (count := seen.get["n"]):
        place = diff.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(diff.sparkSession._jsc.hadoopConfiguration()).delete(place, True)  # no export, no folder
    return count


def working_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; where unset, on one machine only, a temporary one is set."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a folder of its own and read again: what several jobs read is worked out once."""
    path = working_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bookmarked_export(table: VersionedTable, bookmarks: VersionedTable, name: str, keys: Sequence[str], where: Column, root: str) -> int:
    """Export what changed since the bookmark's version, one folder a run, then move the bookmark: at least once.

    ``bookmarks`` has (export_name, table_name, last_version, updated_at). Nothing new: nothing is written, 0 is returned.
    """
    from tidemark.operators.merge import upsert_all

    versions = table.versions()
    last = bookmarks.read().where(F.col("export_name") == name).select("last_version").first()
    since = last["last_version"] if last else None
    if not versions or since == versions[-1]:
        return 0
    count = export_changes(table.diff(since, versions[-1], keys, images=False), where, f"{root}/{name}-{versions[-1]}")
    row = table.spark.range(1).select(F.lit(name).alias("export_name"), F.lit(table.path).alias("table_name"), F.lit(versions[-1]).cast("long").alias("last_version"), F.current_timestamp().alias("updated_at"))
    bookmarks.overwrite(upsert_all(bookmarks.read(), row, ["export_name"]))
    return count
