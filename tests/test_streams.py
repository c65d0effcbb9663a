import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.quality import Rule
from tidemark.sources.tables import VersionedTable
from tidemark.streaming import runs


def events(spark, rows):
    return spark.createDataFrame([(k, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m), "view") for k, m in rows], "id string, ts timestamp, kind string")


def source(spark, path, batches):
    """Files in the order of the batches: a stream that takes one file a batch sees them so."""
    import os
    import time

    os.makedirs(path)
    for i, rows in enumerate(batches):
        part = f"{path}-{i}"
        events(spark, rows).coalesce(1).write.parquet(part)
        name = next(n for n in os.listdir(part) if n.endswith(".parquet"))
        os.rename(f"{part}/{name}", f"{path}/{i}.parquet")
        os.utime(f"{path}/{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return spark.readStream.schema(events(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_drop_late_rows(spark, tmp_path):
    stream = source(spark, str(tmp_path / "in"), [[("a", 0), ("b", 1)], [("c", 60)], [("f", 61)], [("late", 2), ("d", 62)], [("e", 200)]])  # late rows are those before the last batch's watermark
    runs.run_stream(runs.windowed_counts(stream, "ts", "kind", "id"), "windows", str(tmp_path / "c"), path=str(tmp_path / "out"))
    got = sorted((r.window_start.hour * 60 + r.window_start.minute, r.events, r.sessions) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 2, 2), (60, 3, 3)]


def test_dedup_within_watermark(spark, tmp_path):
    stream = source(spark, str(tmp_path / "in"), [[("a", 0), ("a", 1)], [("a", 30), ("b", 60)]])
    report = runs.run_stream(runs.deduplicate_stream(stream, ["id"], "ts"), "dedup", str(tmp_path / "c"), path=str(tmp_path / "out"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    assert report.input_rows == 4 and report.batches == 2


def test_split_and_retry(spark, tmp_path):
    stream = source(spark, str(tmp_path / "in"), [[("a", 0), ("", 1)], [("b", 2)]])
    good, bad = runs.split_stream(stream, [Rule("has_id", "id <> ''")])
    for name, part in (("good", good), ("bad", bad)):
        runs.run_stream(part, name, str(tmp_path / f"c-{name}"), path=str(tmp_path / name))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    table = VersionedTable(spark, str(tmp_path), "state", events(spark, []).schema)
    handle = runs.merge_handler(table, lambda b, _: b, lambda state, b: state.unionByName(b))
    handle(events(spark, [("a", 0)]), 0)
    handle(events(spark, [("b", 0)]), 1)
    handle(events(spark, [("b", 0)]), 1)  # a retry
    assert table.read().count() == 2 and table.versions() == [0, 1]


def test_reset_replays(spark, tmp_path):
    stream = source(spark, str(tmp_path / "in"), [[("a", 0)], [("b", 1)]])
    table = VersionedTable(spark, str(tmp_path), "t", events(spark, []).schema)
    handler = lambda batch, n: table.overwrite(table.read().unionByName(batch))
    runs.run_stream(stream, "r1", str(tmp_path / "c"), handler=handler)
    assert runs.run_stream(stream, "r2", str(tmp_path / "c"), handler=handler).input_rows == 0 and table.read().count() == 2
    runs.reset_stream(spark, str(tmp_path / "c"), table)
    assert table.is_empty()
    runs.run_stream(stream, "r3", str(tmp_path / "c"), handler=handler)
    assert sorted(r.id for r in table.read().select(F.col("id")).collect()) == ["a", "b"]
