"""Chains, late rows, and batches that are parsed, split and measured in one write."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.contracts import Contract, guarded
from tidemark.operators.quality import QualityError, Rule, annotate, measure
from tidemark.sources.tables import AppendedTable
from tidemark.streaming import runs
from tidemark.streaming.chains import Chain, ChainError, Step
from tidemark.streaming.late import LateRows, corrected
from tidemark.streaming.split import SplitTable

SCHEMA = "id string, ts timestamp, kind string"


def at(minute):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minute)


def events(spark, rows):
    return spark.createDataFrame([(k, None if m is None else at(m), "view") for k, m in rows], SCHEMA)


def drop(spark, path, number, rows):
    """One file of a stream's source; later numbers are newer."""
    events(spark, rows).coalesce(1).write.parquet(f"{path}-{number}")
    name = next(n for n in os.listdir(f"{path}-{number}") if n.endswith(".parquet"))
    os.makedirs(path, exist_ok=True)
    os.rename(f"{path}-{number}/{name}", f"{path}/{number}.parquet")
    os.utime(f"{path}/{number}.parquet", (time.time() - 100 + number, time.time() - 100 + number))


def source(spark, path):
    os.makedirs(path, exist_ok=True)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def chain_of(spark, root, path, clean=lambda s: s.where("id <> 'bad'")):
    steps = [Step("raw", lambda s: s, "processingTime=200 milliseconds"), Step("clean", clean, "processingTime=300 milliseconds"), Step("windows", lambda s: runs.windowed_counts(s, "ts", "kind", None), "processingTime=100 milliseconds")]
    return Chain(spark, root, source(spark, path), steps)


def test_chain_runs_goes_on_and_counts(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "steps")
    drop(spark, path, 0, [("a", 0), ("bad", 1)])
    with chain_of(spark, root, path) as chain:
        chain.drain()
        assert spark.read.parquet(chain.out("clean")).count() == 1 and spark.read.parquet(chain.out("windows")).count() == 0
        drop(spark, path, 1, [("b", 2), ("c", 60)])
        drop(spark, path, 2, [("d", 61)])
        chain.drain()
        assert [(r.window_start, r.events) for r in spark.read.parquet(chain.out("windows")).collect()] == [(at(0), 2)]
    reports = {r.name: r for r in chain.reports()}
    assert (reports["raw"].input_rows, reports["clean"].input_rows, reports["windows"].input_rows) == (5, 5, 4)
    assert reports["raw"].batches == 3 and not any(q.isActive for q in chain.queries) and set(chain.watch.ended) == {"raw", "clean", "windows"}
    drop(spark, path, 3, [("e", 200)])
    with chain_of(spark, root, path) as again:  # from the checkpoints: nothing twice
        again.drain()
    assert sorted((r.window_start, r.events) for r in spark.read.parquet(again.out("windows")).collect()) == [(at(0), 2), (at(60), 2)]
    assert [r.input_rows for r in again.reports()] == [1, 1, 1]


def test_a_step_that_fails_stops_the_chain(spark, tmp_path):
    path = str(tmp_path / "in")
    drop(spark, path, 0, [("a", 0)])
    chain = chain_of(spark, str(tmp_path / "steps"), path, lambda s: s.where(F.when(F.col("id") == "a", F.raise_error(F.lit("broken")).cast("boolean")).otherwise(True)))
    with pytest.raises(ChainError, match="step clean"):
        with chain:
            chain.drain()
    assert not any(q.isActive for q in chain.queries) and chain.watch.ended["clean"]
    with pytest.raises(ValueError):
        Chain(spark, "x", source(spark, path), [])


def test_late_rows_are_kept_and_a_retry_sorts_alike(spark, tmp_path):
    batches = [[("a", 0), ("b", 40)], [("late", 5), ("edge", 10), ("c", 41), ("none", None)], [("d", 200)], [("late2", 100)]]
    sides = LateRows(spark, str(tmp_path), "clicks", events(spark, []).schema, "ts")
    for n, rows in enumerate(batches):
        sides.handle(events(spark, rows), n)
    names = lambda df: sorted(r.id for r in df.collect())
    for _ in range(2):
        assert names(sides.late.read()) == ["late", "late2", "none"] and names(sides.on_time.read()) == ["a", "b", "c", "d", "edge"]
        sides.handle(events(spark, batches[1]), 1)  # a retry after newer batches
    windows = sides.on_time.read().groupBy(F.window("ts", "5 minutes")["start"].alias("window_start"), "kind").agg(F.count("*").alias("events"))
    got = {r.window_start: r.events for r in corrected(windows, sides.late.read(), "ts", ["kind"], "5 minutes").collect()}
    assert got == {at(0): 1, at(5): 1, at(10): 1, at(40): 2, at(100): 1, at(200): 1}


RULES = [Rule("has_id", "id <> ''"), Rule("early", "ts < '2025-01-01 01:00:00'", "warn"), Rule("known", "kind = 'view'", "fail")]


def test_a_batch_is_parsed_once_for_both_sides_and_its_measures(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def parsed(value):
        seen.add(1)
        return value

    rows = events(spark, [("a", 0), ("", 1), (None, 2), ("b", 90)])
    parsed_rows = rows.withColumn("id", parsed.asNondeterministic()("id"))
    table = SplitTable(spark, str(tmp_path), "s", rows.schema, RULES)
    metrics = AppendedTable(spark, str(tmp_path), "m", spark.createDataFrame([], "run_id string, source_table string, rule string, action string, failed_rows long, total_rows long, measured_at timestamp").schema)
    handle = runs.split_handler(table, metrics, "clicks")
    handle(parsed_rows, 0)
    assert seen.value == 4
    key = lambda r: (r.rule, r.action, r.failed_rows, r.total_rows)
    assert sorted(map(key, metrics.read().collect())) == sorted(map(key, measure(annotate(rows, RULES), RULES).collect()))
    handle(parsed_rows, 0)  # again: the same slices
    assert sorted(r.id for r in table.good().collect()) == ["a", "b"] and metrics.read().count() == 4
    assert sorted((r.id or "", r._failed_rules[0]) for r in table.rejected().collect()) == [("", "has_id")] * 2
    plan = table.good(0)._jdf.queryExecution().executedPlan().toString()
    assert "_side" in plan.split("PartitionFilters: [")[1].split("]")[0]  # the other side's files are not read
    handle(rows.limit(0), 1)
    assert metrics.read().count() == 4 and table.good().count() == 2


def test_checked_stops_on_fail_rules_and_drops_earlier_batches(spark, tmp_path):
    make = lambda n, ddl: AppendedTable(spark, str(tmp_path), n, spark.createDataFrame([], ddl).schema)
    metrics = make("m", "run_id string, source_table string, rule string, action string, failed_rows long, total_rows long, measured_at timestamp")
    rejected = make("q", "source_table string, record_key string, failed_rules array<string>, payload string, source_file string, run_id string, quarantined_at timestamp")
    rows = events(spark, [("a", 0), ("", 1)]).withColumns({"p": F.lit("{}"), "f": F.lit("x")})
    run = lambda df, n: runs.checked(df, RULES, "clicks", "id", "p", "f", n, metrics, rejected, str(tmp_path / "staged"))
    assert [r.id for r in run(rows, 0).collect()] == ["a"] and [r.id for r in run(rows.where("id = 'a'"), 1).collect()] == ["a"]
    assert os.listdir(tmp_path / "staged/clicks") == ["batch=1"] and rejected.read().count() == 1
    with pytest.raises(QualityError, match="known"):
        run(rows.withColumn("kind", F.lit("other")), 2)
    assert metrics.read().where("run_id = 'clicks-2' and rule = 'known'").first().failed_rows == 2  # written before it stops


def test_guarded_plans_fail_where_a_row_breaks_the_contract(spark, tmp_path):
    c = Contract("t", {"k": "int", "v": "int"}, ("k",), (), {"positive": "v > 0"})
    good = spark.createDataFrame([(1, 1), (2, None)], "k int, v int")
    assert guarded(good, c).count() == 2 and sorted(r.k for r in guarded(good, c).collect()) == [1, 2]
    for row, what in (((3, 0), "positive"), ((None, 1), "k is null")):
        with pytest.raises(Exception, match=what):
            guarded(good.unionByName(spark.createDataFrame([row], "k int, v int")), c).write.parquet(str(tmp_path / what.replace(" ", "_")))
    assert guarded(good, Contract("t", {"v": "int"})).count() == 2
