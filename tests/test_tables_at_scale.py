"""Tables in parts: what is written and read grows with what changes."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import snapshot_diff, upsert_all
from tidemark.sources.seen import SeenKeys
from tidemark.sources.tables import AppendedTable, VersionedTable, part_name
from tidemark.streaming.runs import insert_handler


def files_of(df):
    return sorted(df.inputFiles())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def bucketed(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    t = VersionedTable(spark, str(tmp_path), "t", df.schema, buckets=(["k"], 16))
    t.overwrite(df.repartition(12))
    return t


def test_files_do_not_multiply_with_tasks(bucketed):
    assert 16 <= sum(map(len, bucketed.sizes(bucketed.parts()).values())) <= 32


def test_a_version_reads_its_own_folders(bucketed):
    everything = files_of(bucketed.read())
    one = bucketed.read().where(bucketed.part == "3").limit(1)
    bucketed.merge(one.withColumn("v", F.lit(99).cast("long")), lambda state, new: upsert_all(state, new, ["k"]))
    now = files_of(bucketed.read())
    assert len(set(now) - set(everything)) >= 1 and len(set(everything) & set(now)) == len([f for f in everything if "_part=3/" not in f])
    assert bucketed.read().count() == 20_000 and bucketed.read(0).where("v = 99").count() == 0


def test_diff_reads_the_buckets_that_were_written(bucketed, spark):
    changed = bucketed.read().where(bucketed.part == "5").orderBy("k").limit(3).collect()
    new = spark.createDataFrame([(r.k, 100) for r in changed[:2]], bucketed.schema)
    bucketed.merge(new, lambda state, rows_: upsert_all(state, rows_, ["k"]))
    found = bucketed.diff(0, 1, ["k"])
    assert all("_part=5/" in f for f in files_of(found)) and files_of(found)
    assert rows(found) == rows(snapshot_diff(bucketed.read(0), bucketed.read(1), ["k"])) and found.count() == 4
    assert bucketed.diff(1, 1, ["k"]).count() == 0
    assert bucketed.diff(None, 0, ["k"]).where("_change_type = 'insert'").count() == 20_000


def test_diff_over_appends_replacements_and_moved_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b/1", 3), (4, None, 4)], "k int, p string, v int")
    t = VersionedTable(spark, str(tmp_path), "t", df.schema, partition="p")
    t.overwrite(df)
    t.append(spark.createDataFrame([(5, "b/1", 5), (6, "c d", 6)], df.schema))
    t.replace_where(spark.createDataFrame([(2, "a", 20)], df.schema), F.col("p") == "a")
    moved = t.read().where("k <> 3").unionByName(spark.createDataFrame([(3, "a", 3)], df.schema))
    t.overwrite(moved)
    for one in range(4):
        for two in range(one, 4):
            assert rows(t.diff(one, two, ["k"])) == rows(snapshot_diff(t.read(one), t.read(two), ["k"])), (one, two)
    assert rows(t.read()) == rows(moved)


def test_part_names_are_folder_names(spark):
    values = ["plain", "2024-01", "", "a/b", "a b", "ü", "hex.41", ".x", None, "x=1", "100%"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(part_name(F.col("v"))).collect()]
    assert len(set(got)) == len(values) and got[:2] == values[:2] and all(n.replace(".", "").replace("-", "").isalnum() for n in got)


def test_compaction_rewrites_parts_with_small_files(spark, tmp_path):
    df = spark.range(60_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("a"), F.rand(1).alias("b"), (F.col("id") % 3).alias("p"))
    t = VersionedTable(spark, str(tmp_path), "t", df.schema, partition="p")
    t.overwrite(df)
    for part in (0, 0, 0, 2, 2):
        t.append(df.where(f"p = {part}").limit(4000))
    before = rows(t.read().select("k", "p"))
    one = {x for x in t.parts() if x[1] == "1"}
    target = 250_000
    assert t.compact(target, ["a", "b"]) == ["0", "2"]  # part 1 has files enough for its bytes
    sizes = t.sizes(t.parts())
    assert one <= t.parts() and rows(t.read().select("k", "p")) == before
    assert all(s <= 2 * target for p, own in sizes.items() for s in own if p not in one)
    assert t.compact(target, ["a", "b"]) == [] or all(sum(s < target / 2 for s in own) <= 2 for own in t.sizes(t.parts()).values())
    assert t.compact(1) == []


def test_compacted_files_hold_ranges_of_the_cluster_columns(spark, tmp_path):
    df = spark.range(40_000).select(F.xxhash64("id").alias("a"), F.rand(2).alias("b"), F.lit("x" * 40).alias("c"))
    t = VersionedTable(spark, str(tmp_path), "t", df.schema)
    t.overwrite(df.repartition(20))
    total = sum(map(sum, t.sizes(t.parts()).values()))
    t.compact(total // 8, ["a", "b"])
    files = files_of(t.read())
    assert 8 <= len(files) <= 10
    quarter = lambda c, low: (F.col(c) >= F.lit(low))
    mid = t.read().approxQuantile(["a", "b"], [0.5], 0.001)
    # a box of a quarter of the rows touches about a half of the files, though they are sorted by neither column alone
    box = t.read().where(quarter("a", mid[0][0]) & quarter("b", mid[1][0])).select(F.input_file_name()).distinct().count()
    assert box <= len(files) // 2 + 1


def test_vacuum_deletes_what_no_kept_version_needs(bucketed, spark):
    for n in range(1, 6):
        bucketed.merge(spark.createDataFrame([(0, n)], bucketed.schema), lambda state, new: upsert_all(state, new, ["k"]))
    (part,) = bucketed.touched(spark.createDataFrame([(0, 0)], bucketed.schema))
    assert bucketed.vacuum(keep=2) == [(n, part) for n in range(4)]
    assert bucketed.versions() == [4, 5] and bucketed.read(4).count() == bucketed.read().count() == 20_000
    assert not os.path.exists(bucketed.folder((1, part)).removeprefix("file:"))


def test_seen_keys_read_the_parts_of_a_batch(spark, tmp_path):
    schema = "k long, w string"
    make = lambda keys: spark.createDataFrame([(k, f"w{k}") for k in keys], schema)
    seen = SeenKeys(spark, str(tmp_path), "seen", make([]).select("k").schema, parts=16, maps=4)
    first = list(range(5000))
    assert seen.unseen(make(first), 0).count() == 5000
    seen.add(make(first), 0)
    assert rows(seen.unseen(make([1, 2, 9_000_000]), 1)) == [(9_000_000, "w9000000")]
    read = {f.split("_part=")[1].split("/")[0] for f in files_of(seen.known(seen.keys.touched(make([1, 2]))))}
    assert len(read) <= 2  # keys of two parts at most are read for two keys
    new = seen.unseen(make(range(10**6, 10**6 + 100)), 1)
    assert new.count() == 100 and len([f for f in files_of(new) if "seen_keys" in f]) <= 10  # a bitmap says that most are new
    seen.add(make([7, 10**7]), 1)
    assert seen.unseen(make([10**7]), 1).count() == 1 and seen.unseen(make([10**7]), 2).count() == 0  # a retry of batch 1 does not see itself


def test_seen_keys_with_nulls_copies_and_folding(spark, tmp_path):
    schema = "a string, b int"
    seen = SeenKeys(spark, str(tmp_path), "seen", spark.createDataFrame([], schema).schema, parts=4, maps=1)
    known = set()
    for batch, keys in enumerate([[("x", 1), ("x", 1), (None, 1), ("x", None)], [("x", 1), (None, 1), (None, None)], [("y", 1), ("x", None)], []]):
        new = seen.unseen(spark.createDataFrame(keys, schema), batch).collect()
        assert sorted(map(tuple, new), key=str) == sorted({*keys} - known, key=str)
        seen.add(spark.createDataFrame(new, schema), batch)
        known |= {*keys}
        if batch == 1:
            seen.fold(batch)
    assert rows(seen.keys.read()) == sorted(known, key=str)
    assert seen.unseen(spark.createDataFrame([*known], schema), 9).count() == 0


def test_insert_handler_with_an_index_equals_one_without(spark, tmp_path):
    schema = "k long, v string"
    batches = [[(k % 50, str(k % 50)) for k in range(n, n + 40)] for n in (0, 20, 45, 45)]
    tables = []
    for index in (False, True):
        table = AppendedTable(spark, str(tmp_path), f"t{index}", spark.createDataFrame([], schema).schema)
        seen = SeenKeys(spark, str(tmp_path), "s", spark.createDataFrame([], "k long").schema, parts=4, maps=2) if index else None
        handle = insert_handler(table, lambda b, _: b, ["k"], seen=seen, fold_every=2)
        for n, batch in enumerate(batches):
            handle(spark.createDataFrame(batch, schema), n)
            handle(spark.createDataFrame(batch, schema), n)  # run again
        tables.append(rows(table.read()))
    assert tables[0] == tables[1] and len(tables[0]) == 50
