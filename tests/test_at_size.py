"""Faults that only larger tables or other machines show, on small tables."""

from pyspark.sql import functions as F

from tidemark.plans import ml
from tidemark.streaming.runs import windowed_counts


def test_trees_get_a_row_for_all_rows_that_look_alike(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    given = []
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: given.append((rows.count(), rows.agg(F.sum("_weight")).first()[0])) or fit(self, rows))
    rows = spark.range(4000).select((F.col("id") % 200).cast("double").alias("x"), F.when(F.col("id") % 200 != 7, F.lit(1.0)).alias("often"), F.lit("a").alias("kind"), (F.col("id") % 200 > 120).cast("int").alias("y"))
    model = ml.train(ml.prepare(rows, ["x", "often"], ["kind"]), ["x", "often"], ["kind"], "y", iterations=3)
    ((n, weight),) = given
    assert n <= 200 and weight == 4000  # no row is left out
    wrong = model.transform(ml.prepare(rows, ["x", "often"], ["kind"])).where(F.col("prediction") != F.col("y")).select("x").distinct().count()
    assert wrong <= 6  # a range of a 32nd


def test_a_rare_value_beside_a_frequent_one_is_told_apart(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 100 == 0, 3.0).otherwise(0.0).alias("x"), (F.col("id") % 100 == 0).cast("int").alias("y"))
    model = ml.train(ml.prepare(rows, ["x"], []), ["x"], [], "y", iterations=2)
    assert model.transform(ml.prepare(rows, ["x"], [])).where(F.col("prediction") != F.col("y")).isEmpty()


def test_a_value_equal_to_its_average_is_not_above_it_in_any_order(spark):
    from tidemark.plans.queries import above_average

    for values in ([0.1, 0.2, 0.3], [0.3, 0.2, 0.1]):
        events = spark.createDataFrame([(1, f"t{v}", v) for v in values], "user_id long, event_type string, value double").coalesce(1)
        assert [tuple(r) for r in above_average(events).collect()] == [("t0.3", 1)]


def test_a_windows_sessions_are_near_the_exact_count(spark):
    rows = spark.range(600).selectExpr("id as w", "int(2 + id % 50 * 8) as n").selectExpr("w", "n", "explode(sequence(1, n)) as k")
    rows = rows.selectExpr("timestampadd(minute, int(w * 5), timestamp'2024-01-01') as ts", "'a' as kind", "concat(w, '/', k) as session", "n")
    told = windowed_counts(rows, "ts", "kind", "session").join(rows.groupBy(F.col("ts").alias("window_start")).agg(F.first("n").alias("n")), "window_start")
    assert told.count() == 600 and told.where("abs(sessions - n) > greatest(1, 0.1 * n)").isEmpty()


def test_trainings_agree_but_for_the_order_of_their_sums():
    one = {"test_rows": 100, "roc_auc": 0.8, "pr_auc": None, "brier": 0.1}
    assert ml.agree(one, one | {"roc_auc": 0.8 + 1e-12})
    assert not ml.agree(one, one | {"roc_auc": 0.83}) and not ml.agree(one, one | {"test_rows": 99}) and not ml.agree(one, one | {"pr_auc": 0.5})


def test_a_clean_table_is_made_alone_and_orders_are_parsed_once(spark, sf, monkeypatch):
    from tidemark.plans import silver, ticketing

    parsed = []
    parse = silver.parse_orders
    monkeypatch.setattr(silver, "parse_orders", lambda raw: parsed.append(1) or parse(raw))
    w = ticketing.World(spark, sf)
    assert w["clicks"].count() > 0 and list(w) == ["clicks"]  # nothing else was made for it
    assert w["orders"].count() > 0 and w["lines"].count() > 0 and parsed == [1]
    plan = w["orders"]._jdf.queryExecution().executedPlan().toString() + w["versions"]._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan


def test_clicks_of_one_row_group_are_parsed_by_many_tasks(spark, sf):
    from tidemark.plans import ticketing

    assert spark.read.parquet(f"{sf}/events.parquet").select(F.spark_partition_id()).distinct().count() == 1
    rows = [r[0] for r in ticketing.World(spark, sf)["clicks"].groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(rows) > 1 and max(rows) < 2 * sum(rows) / len(rows)


def test_replaced_rows_are_worked_out_once(spark):
    from tidemark.sources.tables import VersionedTable, working_dir

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    t = VersionedTable(spark, working_dir(spark, "once"), "t", spark.createDataFrame([], "id long").schema)
    t.replace_where(spark.range(50).mapInPandas(counted, "id long"), F.col("id") >= 0)
    assert t.read().count() == 50 and made.value == 50


def test_a_landing_folder_is_written_by_many_tasks_and_is_one_batch(spark, tmp_path):
    from tidemark.plans.streams import arriving, stream_of
    from tidemark.streaming.runs import run_stream

    rows = spark.range(0, 300, 1, 4).withColumn("number", (F.col("id") % 3).cast("int"))
    batches, path = {}, f"file://{tmp_path}/landing"
    for _ in arriving(rows, F.col("number"), 3, path):
        stream = stream_of(spark, rows.drop("number"), path)
        run_stream(stream, "arriving", f"file://{tmp_path}/checkpoint", handler=lambda b, n: batches.update({n: sorted(r[0] for r in b.collect())}))
    assert batches == {k: list(range(k, 300, 3)) for k in range(3)}
    assert all(len(list((tmp_path / "landing" / str(k)).glob("*.parquet"))) > 1 for k in range(3))


def test_an_export_is_written_by_the_tasks_that_find_its_rows(spark, tmp_path):
    from tidemark.sources.tables import export_changes

    diff = spark.range(0, 100, 1, 4).withColumn("_change_type", F.lit("insert"))
    assert export_changes(diff, F.col("id") >= 0, f"file://{tmp_path}/out") == 100
    assert len(list((tmp_path / "out").glob("*.json"))) > 1
    assert export_changes(diff, F.col("id") < 0, f"file://{tmp_path}/none") == 0 and not (tmp_path / "none").exists()
