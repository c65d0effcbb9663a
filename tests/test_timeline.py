"""Sweeps along time: equal to a search through all rows, and split where one key holds most of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import in_effect
from tidemark.operators.merge import empty_history, merge_history
from tidemark.operators.timeline import as_of, bounds_of, neighbours

AT = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


def worlds(spark, seed):
    rnd = random.Random(seed)
    versions = []
    for key in ["hot", "b", "c", "none"][:3]:
        edges = sorted(rnd.sample(range(0, 400), 30))
        for n, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            if rnd.random() < 0.8:  # else a gap
                versions.append((key, AT(low), None if n == 28 and key != "b" else AT(high), f"{key}{n}", None if n % 5 == 0 else n))
    facts = [(i, rnd.choice(["hot"] * 6 + ["b", "c", "none", None]), None if rnd.random() < 0.05 else AT(rnd.randint(-10, 420))) for i in range(400)]
    facts += [(1000 + i, k, t) for i, (k, t, *_) in enumerate(versions)] + [(2000 + i, k, t) for i, (k, _, t, *_) in enumerate(versions)]  # on the edges
    return spark.createDataFrame(facts, "id int, k string, at timestamp"), spark.createDataFrame(versions, "k string, valid_from timestamp, valid_to timestamp, name string, n int")


@pytest.mark.parametrize("ranges", [1, 2, 8, 50])
def test_as_of_equals_a_range_join(spark, ranges):
    facts, versions = worlds(spark, ranges)
    v = versions.withColumnRenamed("k", "vk")
    want = facts.join(v, (facts.k == v.vk) & in_effect(F.col("valid_from"), F.col("valid_to"), F.col("at")), "left").select("id", "k", "at", "name", "n")
    got = as_of(facts, versions, "k", "at", ["name", "n"], ranges=ranges)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_as_of_by_days_and_over_empty_tables(spark):
    facts = spark.createDataFrame([("a", dt.date(2025, 1, 2)), ("a", dt.date(2025, 1, 5))], "k string, at date")
    versions = spark.createDataFrame([("a", dt.date(2025, 1, 1), dt.date(2025, 1, 5), "x"), ("a", dt.date(2025, 1, 5), None, None)], "k string, valid_from date, valid_to date, name string")
    assert [r.name for r in as_of(facts, versions, "k", "at", ["name"]).orderBy("at").collect()] == ["x", None]
    assert as_of(facts.limit(0), versions, "k", "at", ["name"]).count() == 0
    assert [r.name for r in as_of(facts, versions.limit(0), "k", "at", ["name"]).collect()] == [None, None]


def test_a_frequent_key_is_swept_by_several_tasks(spark):
    facts = spark.range(4000).select(F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("at"))
    versions = spark.range(0, 4000, 10).select(F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("valid_from"), F.timestamp_seconds(F.col("id") + 10).alias("valid_to"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        swept = as_of(facts, versions, "k", "at", ["n"])
        sizes = [r["count"] for r in swept.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) >= 3 and max(sizes) < 2000  # eight ranges, of which some share a task
    assert swept.where("n <> floor(unix_seconds(at) / 10) * 10 or n is null").count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_neighbours_over_ranges(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(k, n, rnd.choice(["x", "y", None])) for k in ("a", "b", None) for n in rnd.sample(range(300), 90 if k == "a" else 4)]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    got = neighbours(df, ["k"], "n", {"before": F.col("v")}, {"after": F.struct("n", "v")}, bounds_of(df, "n", ranges))
    want = []
    for k in ("a", "b", None):
        own = sorted((n, v) for kk, n, v in rows if kk == k)
        for i, (n, v) in enumerate(own):
            want.append((k, n, v, own[i - 1][1] if i else None, own[i + 1] if i + 1 < len(own) else None))
    assert sorted(((r.k, r.n, r.v, r.before, tuple(r.after) if r.after else None) for r in got.collect()), key=str) == sorted(want, key=str)


def test_history_over_ranges_equals_one_sweep(spark):
    rnd = random.Random(8)
    shape = "k string, v string, seq long, at timestamp, gone boolean"
    batches = [[(rnd.choice(["hot"] * 8 + ["b", "c", "d"]), rnd.choice("xyz"), n, AT(n), rnd.random() < 0.1) for n in rnd.sample(range(low, low + 200), 120)] for low in (0, 100, 250)]
    found = []
    for ranges in (1, 6):
        state = empty_history(spark, {"k": "string"}, {"v": "string"})
        for batch in batches:
            state = merge_history(state, spark.createDataFrame(batch, shape), ["k"], ["v"], "seq", "at", F.col("gone"), ranges=ranges)
            state = spark.createDataFrame(state.collect(), state.schema)
        found.append(sorted(map(str, state.collect())))
    assert found[0] == found[1] and len(found[0]) > 150
