"""All trailing totals of a key by one sweep: the same rows as a sweep and a join for each, without shuffling rows of the result."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.plans import features as fe
from tidemark.plans import gold
from tidemark.plans.tables import CONTRACTS

DAY = dt.date(2020, 1, 1)
at = lambda n, hour=0: dt.datetime(2020, 1, 1, hour) + dt.timedelta(days=n)


def frame(spark, contract, rows):
    schema = CONTRACTS[contract].schema
    for f in schema.fields:
        f.nullable = True
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def given(spark):
    order = lambda i, c, paid, back=None: {"order_id": f"o{i}", "customer_id": c, "event_id": f"e{i % 3}", "order_amount": Decimal(f"{i}.25"), "paid_at": paid, "refunded_at": back}
    orders = [order(i, f"c{i % 3}", at(37 * i % 700, i % 24), at(37 * i % 700 + i, 5) if i % 4 == 0 else None) for i in range(40)]
    orders += [order(40, "c1", None), order(41, None, at(3)), order(42, "c4", at(9)), order(43, "c0", at(5), at(2))]
    lines = [{"order_id": o["order_id"], "line_no": n, "ticket_type": "s", "quantity": n + 1, "unit_price": Decimal(3), "line_amount": Decimal(3 * n + 3)} for o in orders if o["customer_id"] != "c2" for n in range(2)]
    version = lambda c, tier, a, b: {"customer_sk": f"{c}{tier}", "customer_id": c, "loyalty_tier": tier, "country": "DE", "signup_date": DAY, "valid_from": a, "valid_to": b, "is_current": b is None}
    versions = [version("c0", "a", at(1), at(100)), version("c0", "b", at(100), at(100, 7)), version("c0", "c", at(100, 7), at(300, 1)), version("c0", "d", at(301), None), version("c1", "a", at(60, 12), at(400)), version("c2", "a", at(0), None)]
    clicks = [{"event_id": f"k{i}", "session_id": "s", "customer_id": f"c{i % 2}" if i % 5 else None, "event_type": "add_to_cart" if i % 3 else None, "event_ts": at(11 * i % 500), "event_date": at(11 * i % 500).date()} for i in range(60)]
    events = [{"event_id": f"e{i}", "venue_id": "v", "genre": g, "capacity": 1} for i, g in enumerate(("rock", None, "jazz"))]
    return [frame(spark, c, r) for c, r in (("silver.orders", orders), ("silver.order_items", lines), ("silver.customers", versions), ("silver.clickstream", clicks), ("gold.dim_event", events))]


def dated(spark):
    days = [*range(0, 90, 14), 98, 99, 100, 101, *range(300, 303), 399, 400, 900]
    return spark.createDataFrame([(DAY + dt.timedelta(days=n),) for n in days], "as_of_date date")


def exchanges(df):
    return [line for line in df._jdf.queryExecution().toString().splitlines() if "Exchange" in line and "Reused" not in line]


def test_one_sweep_equals_a_sweep_and_a_join_for_each_kind(spark):
    orders, lines, customers, clicks, events = given(spark)
    dates, sales = dated(spark), gold.sold_lines(orders, lines)
    who = fe.population(dates, orders, customers)
    own = orders.where("paid_at is not null").withColumns({"paid_date": F.to_date("paid_at"), "refunded_date": F.to_date("refunded_at")})
    on = ["customer_id", "as_of_date"]
    parts = (fe.order_features(who, own), fe.line_features(who, sales.join(events, "event_id", "left")), fe.engagement_features(who, clicks))
    want = who.join(parts[0], on).join(parts[1], on).join(parts[2], on).withColumn("tenure_days", F.date_diff("as_of_date", "signup_date"))
    got = fe.features(dates, orders, sales, events, clicks, customers)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(map(tuple, want.select(*got.columns).collect()), key=str) and len(rows) > 20
    assert not [x for x in exchanges(got) if "as_of_date" in x]  # rows of the result stay where they are made
    assert not fe.features(dates.limit(0), orders, sales, events, clicks, customers).collect()


def test_facts_without_a_version_are_the_same_facts(spark):
    orders, lines, customers, *_ = given(spark)
    fact = gold.fct_sales(orders, lines, customers)
    bare = gold.sold_lines(orders, lines)
    assert sorted(map(tuple, bare.collect()), key=str) == sorted(map(tuple, fact.select(*bare.columns).collect()), key=str)
    assert "Window" not in bare._jdf.queryExecution().toString()


def test_training_rows_are_features_joined_with_labels(spark):
    orders = given(spark)[0].where("paid_at is not null").withColumns({"paid_date": F.to_date("paid_at"), "refunded_date": F.to_date("refunded_at")})
    dates, last = dated(spark), F.lit(DAY + dt.timedelta(days=460))
    who = fe.on_dates(orders, "customer_id", "paid_date", dates, fe.YEAR)
    want = fe.order_features(who, orders).join(fe.labels(who, orders, last), ["customer_id", "as_of_date"])
    got = fe.training_rows(dates, orders, last)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(map(tuple, want.select(*got.columns).collect()), key=str) and len(rows) > 20
    assert not [x for x in exchanges(got) if "as_of_date" in x]


def test_daily_sales_has_tasks_by_its_lines(spark, monkeypatch):
    from tidemark.plans import queries

    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, queries.daily_sales(spark, folder).collect()))
    monkeypatch.setattr(queries, "LINES_A_TASK", 100)
    tasks = -(-spark.read.parquet(f"{folder}/lineitem.parquet").count() // 100)
    got = queries.daily_sales(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert tasks > spark.sparkContext.defaultParallelism and f", {tasks}), REPARTITION_BY_NUM" in plan  # left alone, their number does not grow
    assert sorted(map(tuple, got.collect())) == want
