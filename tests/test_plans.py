"""The ticketing plans over small hand-made tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.plans import features as fe
from tidemark.plans import gold, ml
from tidemark.plans.tables import CONTRACTS
from tidemark.sources.tables import VersionedTable


def ts(day, hour=0, month=1):
    return dt.datetime(2025, month, day, hour)


def frame(spark, contract, rows):
    schema = CONTRACTS[contract].schema
    full = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    for f in schema.fields:
        f.nullable = True
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="module")
def world(spark):
    order = lambda i, c, e, paid, refunded=None, amount=20: {"order_id": i, "customer_id": c, "event_id": e, "order_ts": paid or ts(1), "order_date": (paid or ts(1)).date(), "status": "PAID", "channel": "web", "order_amount": Decimal(amount), "paid_at": paid, "refunded_at": refunded, "updated_at": refunded or paid or ts(1)}
    line = lambda i, n, q, p: {"order_id": i, "line_no": n, "ticket_type": "std", "quantity": q, "unit_price": Decimal(p), "line_amount": Decimal(q * p)}
    version = lambda c, sk, tier, a, b: {"customer_sk": sk, "customer_id": c, "loyalty_tier": tier, "signup_date": dt.date(2024, 12, 1), "valid_from": a, "valid_to": b, "is_current": b is None, "country": "DE"}
    click = lambda n, s, c, kind, when: {"event_id": f"k{n}", "session_id": s, "customer_id": c, "event_type": kind, "device": "web", "event_ts": when, "event_date": when.date()}
    return {
        "orders": frame(spark, "silver.orders", [order("o1", "c1", "e1", ts(5, 12)), order("o2", "c1", "e2", ts(10), ts(12)), order("o3", "c2", "e1", ts(10), None, 30), order("o4", "c2", "e1", None)]),
        "lines": frame(spark, "silver.order_items", [line("o1", 1, 2, 10), line("o2", 1, 1, 20), line("o3", 1, 3, 10), line("o4", 1, 9, 9)]),
        "customers": frame(spark, "silver.customers", [version("c1", "s1", "silver", ts(1), ts(8)), version("c1", "s2", "gold", ts(8), None), version("c2", "s3", "silver", ts(10), None)]),
        "events": frame(spark, "gold.dim_event", [{"event_id": "e1", "venue_id": "v1", "genre": "rock", "capacity": 10}, {"event_id": "e2", "venue_id": None, "genre": None, "capacity": 0}]),
        "clicks": frame(spark, "silver.clickstream", [click(1, "a", "c1", "view_event", ts(9, 23)), click(2, "a", "c1", "purchase", ts(10, 1)), click(3, "b", None, "page_view", ts(10, 2)), click(4, "c", "c1", "add_to_cart", ts(2))]),
    }


@pytest.fixture(scope="module")
def sales(world):
    return gold.fct_sales(world["orders"], world["lines"], world["customers"])


def test_fact_has_the_version_at_payment(sales):
    assert sorted((r.order_id, r.customer_sk, float(r.gross_amount), float(r.refunded_amount)) for r in sales.collect()) == [("o1", "s1", 20, 0), ("o2", "s2", 20, 20), ("o3", "s3", 30, 0)]


def test_daily_sales_and_null_keys(sales, world):
    got = sorted((str(r.sales_date), r.venue_id or "", r.paid_orders, r.refunded_orders, float(r.net_revenue)) for r in gold.daily_sales(sales, world["events"]).collect())
    assert got == [("2025-01-05", "v1", 1, 0, 20), ("2025-01-10", "", 1, 0, 20), ("2025-01-10", "v1", 1, 0, 30), ("2025-01-12", "", 0, 1, -20)]


def test_rebuild_equals_one_go(spark, sales, world, tmp_path):
    t = VersionedTable(spark, str(tmp_path), "d", CONTRACTS["gold.agg_daily_sales"].schema)
    early = sales.where("paid_date < '2025-01-08'")
    gold.rebuild(t, "sales_date", lambda since: gold.daily_sales(early, world["events"], since))
    gold.rebuild(t, "sales_date", lambda since: gold.daily_sales(sales, world["events"], since))
    gold.rebuild(t, "sales_date", lambda since: gold.daily_sales(sales, world["events"], since))
    assert sorted(map(str, t.read().collect())) == sorted(map(str, gold.daily_sales(sales, world["events"]).collect()))


def test_performance_and_customers(sales, world):
    rows = {r.event_id: r for r in gold.event_performance(sales, world["events"]).collect()}
    assert rows["e1"].tickets_sold == 5 and rows["e1"].sell_through == 0.5 and rows["e2"].sell_through is None and float(rows["e2"].net_revenue) == 0
    c = {r.customer_id: r for r in gold.customer_360(world["customers"], sales, world["events"], world["clicks"], F.lit("2025-02-05").cast("date")).collect()}
    assert (c["c1"].loyalty_tier, c["c1"].lifetime_orders, c["c1"].refunded_orders, float(c["c1"].lifetime_net_revenue), c["c1"].favorite_genre, c["c1"].events_30d, c["c1"].days_since_last_purchase) == ("gold", 2, 1, 20.0, "rock", 2, 26)
    assert c["c2"].events_30d == 0 and c["c2"].last_seen_at is None


def test_funnel_over_midnight(world):
    rows = {(str(r.session_date), r.sessions, r.viewed_sessions, r.purchase_sessions, r.view_to_purchase_rate) for r in gold.funnel_daily(world["clicks"]).collect()}
    assert rows == {("2025-01-09", 1, 1, 1, 1.0), ("2025-01-10", 1, 0, 0, None), ("2025-01-02", 1, 0, 0, None)}
    late = gold.funnel_daily(world["clicks"], F.lit("2025-01-10").cast("date")).collect()
    assert [(str(r.session_date), r.sessions) for r in late] == [("2025-01-10", 1)]


def test_features_look_back_only(spark, sales, world):
    dates = spark.createDataFrame([(dt.date(2025, 1, 9),), (dt.date(2025, 1, 10),)], "as_of_date date")
    rows = {(r.customer_id, str(r.as_of_date)): r for r in fe.features(dates, world["orders"], sales, world["events"], world["clicks"], world["customers"]).collect()}
    assert set(rows) == {("c1", "2025-01-09"), ("c1", "2025-01-10"), ("c2", "2025-01-10")}
    a, b = rows["c1", "2025-01-09"], rows["c1", "2025-01-10"]
    assert (a.recency_days, a.orders_30d, float(a.revenue_90d), a.refunds_365d, a.events_7d, a.events_30d, a.cart_adds_30d, a.loyalty_tier) == (4, 1, 20.0, 0, 1, 2, 1, "gold")
    assert (b.recency_days, b.orders_30d, b.genres_365d, b.avg_ticket_price_365d) == (0, 2, 1, pytest.approx(40 / 3)) and rows["c2", "2025-01-10"].engagement_ratio is None


def test_labels_and_dates(spark):
    who = spark.createDataFrame([("a", dt.date(2025, 1, 1)), ("b", dt.date(2025, 1, 1)), ("a", dt.date(2025, 3, 1))], "customer_id string, as_of_date date")
    bought = spark.createDataFrame([("a", dt.date(2025, 1, 1)), ("a", dt.date(2025, 3, 2)), ("b", dt.date(2025, 3, 3))], "customer_id string, paid_date date")
    got = {(r.customer_id, str(r.as_of_date), r.churned) for r in fe.labels(who, bought, F.lit("2025-03-10").cast("date")).collect()}
    assert got == {("a", "2025-01-01", 0), ("b", "2025-01-01", 1)}
    bounds = spark.createDataFrame([(dt.date(2025, 1, 1), dt.date(2025, 7, 1))], "a date, b date")
    assert [str(r[0]) for r in fe.training_dates(bounds, "a", "b").collect()] == ["2025-04-01", "2025-04-15", "2025-04-29"]
    with pytest.raises(ValueError):
        fe.training_set(who.where("as_of_date = '2025-01-01'"), who.withColumn("churned", F.lit(1)), ["customer_id", "as_of_date"])


def test_metrics_policy_and_bands(spark):
    scored = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1), (0, 0.2)], "label int, score double")
    m = ml.metrics(scored).first()
    assert m.roc_auc == pytest.approx(5.5 / 6) and m.base_rate == pytest.approx(0.4) and m.top_decile_lift == pytest.approx(2.5)
    case = lambda new: ml.compare(spark.createDataFrame([("champion", 0.80, 0.85, 0.18), ("challenger", *new)], "role string, roc_auc double, pr_auc double, brier double")).first()
    assert case((0.80, 0.86, 0.18)).promote and not case((0.80, 0.84, 0.18)).promote and not case((0.78, 0.86, 0.18)).promote and not case((0.80, 0.86, 0.19)).promote
    only = ml.compare(spark.createDataFrame([("challenger", 0.75, 0.5, 0.2)], "role string, roc_auc double, pr_auc double, brier double")).first()
    assert only.promote and only.reasons == []
    bands = spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.59, 0.6, 0.95)], "s double").select(ml.risk_band(F.col("s"))).collect()
    assert [b[0] for b in bands] == ["low", "medium", "medium", "high", "high"]


def test_drift(spark):
    base = spark.range(4000).select(F.randn(1).alias("x"), F.lit(1.0).alias("flat"))
    same = {r.feature: r for r in ml.psi(base, spark.range(4000).select(F.randn(2).alias("x"), F.lit(1.0).alias("flat")), ["x", "flat"]).collect()}
    assert same["x"].psi < 0.02 and same["flat"].psi == 0
    assert ml.psi(base, base.withColumn("x", F.col("x") + 1), ["x"]).first().status == "significant"
    missing = base.withColumn("x", F.when(F.rand(3) > 0.4, F.col("x")))
    assert ml.psi(base, missing, ["x"]).first().status == "significant"


def test_training_keeps_signal(spark):
    rows = spark.range(1500).select((F.rand(1) * 10).alias("a"), F.when(F.rand(2) > 0.2, F.rand(3)).alias("b"), F.when(F.rand(4) > 0.5, "x").alias("c"))
    rows = rows.withColumn("y", (F.col("a") + F.when(F.col("c") == "x", 3).otherwise(0) > 6).cast("int"))
    ready = ml.prepare(rows, ["a", "b"], ["c"]).cache()
    model = ml.train(ready, ["a", "b"], ["c"], "y", iterations=3)
    from pyspark.ml.functions import vector_to_array

    assert ml.metrics(model.transform(ready).select(F.col("y").alias("label"), vector_to_array("probability")[1].alias("score"))).first().roc_auc > 0.7


def test_trailing_totals_equal_a_join_of_dates_and_days(spark):
    """Random entries, with refunds before their payment and days on the edges of every window."""
    import random

    rnd = random.Random(5)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    orders = [(rnd.choice("abc"), i, day(d := rnd.randint(0, 800)), day(d + rnd.randint(-20, 60)) if rnd.random() < 0.4 else None, rnd.randint(1, 99)) for i in range(300)]
    orders += [("d", 1000, day(0), None, 5), ("d", 1001, day(365), day(365), 7), ("e", 1002, None, None, 3)]
    lines = [(c, p, a, rnd.randint(1, 4), rnd.choice(["x", "y", "z", None])) for c, _, p, _, a in orders if p]
    clicks = [(rnd.choice(["a", "b", None]), day(rnd.randint(0, 800)), rnd.choice(["add_to_cart", "view", None])) for _ in range(300)]
    dates = [day(n) for n in (0, 29, 30, 90, 364, 365, 366, 500, 730, 900)]
    within = lambda d, at, n: d is not None and 0 <= (at - d).days < n
    who = [(c, at) for c in "abcd" for at in dates if any(k == c and within(p, at, 365) for k, _, p, _, _ in orders)]

    made = spark.createDataFrame(orders, "customer_id string, order_id long, paid_date date, refunded_date date, order_amount int")
    every = spark.createDataFrame([(d,) for d in dates], "as_of_date date")
    assert sorted(map(tuple, fe.on_dates(made.where("paid_date is not null"), "customer_id", "paid_date", every, 365).collect())) == sorted(who)

    table = spark.createDataFrame(who, "customer_id string, as_of_date date")
    own = lambda c, at: [(p, b, a) for k, _, p, b, a in orders if k == c and p is not None and p <= at]
    want = {}
    for c, at in who:
        mine = own(c, at)
        counts = [sum(within(p, at, n) for p, _, _ in mine) for n in (30, 90, 365)]
        sums = [sum(a for p, _, a in mine if within(p, at, n)) for n in (90, 365)]
        want[c, at] = ((at - max(p for p, _, _ in mine)).days, *counts, *sums, sum(within(b, at, 365) for _, b, _ in mine))
    assert {(r[0], r[1]): tuple(r)[2:] for r in fe.order_features(table, made).collect()} == want

    bought = fe.line_features(table, spark.createDataFrame(lines, "customer_id string, paid_date date, gross_amount int, quantity int, genre string"))
    want = {}
    for c, at in who:
        mine = [(a, q, g) for k, p, a, q, g in lines if k == c and within(p, at, 365)]
        want[c, at] = (sum(a for a, _, _ in mine) / sum(q for _, q, _ in mine), len({g for _, _, g in mine} - {None}))
    assert {(r[0], r[1]): (pytest.approx(r[2]), r[3]) for r in bought.collect()} == want

    seen = fe.engagement_features(table, spark.createDataFrame(clicks, "customer_id string, event_date date, event_type string"))
    want = {}
    for c, at in who:
        week, month = (sum(k == c and within(d, at, n) for k, d, _ in clicks) for n in (7, 30))
        want[c, at] = (week, month, sum(k == c and t == "add_to_cart" and within(d, at, 30) for k, d, t in clicks), week / month if month else None)
    assert {(r[0], r[1]): tuple(r)[2:] for r in seen.collect()} == want


def test_shuffled_rows_do_not_grow_with_the_dates_of_a_join(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    who = spark.createDataFrame([("a", dt.date(2025, 1, 1))], "customer_id string, as_of_date date")
    orders = spark.createDataFrame([("a", 1, dt.date(2025, 1, 1), None, 1)], "customer_id string, order_id int, paid_date date, refunded_date date, order_amount int")
    assert "Join" not in plan(fe.order_features(who, orders))


def test_feature_job_modes(spark, tmp_path):
    import datetime

    from tidemark.sources.tables import VersionedTable

    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    bought = spark.createDataFrame([("a", day(n)) for n in (0, 80, 95, 200)] + [("b", day(100))], "customer_id string, paid_date date")
    build = lambda dates: fe.on_dates(bought, "customer_id", "paid_date", dates, 365).withColumn("n", F.lit(1))
    make = lambda name, ddl: VersionedTable(spark, str(tmp_path), name, spark.createDataFrame([], ddl).schema, partition="as_of_date")
    job = fe.FeatureJob(make("f", "customer_id string, as_of_date date, n int"), make("l", "customer_id string, as_of_date date, churned int"), build)
    assert job.train(bought.where("paid_date < '2024-03-01'")) is None and job.features.is_empty()  # no history
    assert job.score((bought.limit(0), "paid_date")) is None
    assert job.train(bought) == 0
    dates = {r[0] for r in job.features.read().select("as_of_date").collect()}
    assert dates == {day(90), day(104), day(118), day(132)} and {r[0] for r in job.labels.read().select("as_of_date").collect()} == dates
    assert {(r[0], r[1]): r[2] for r in job.labels.read().collect() if r[1] == day(90)} == {("a", day(90)): 0}
    assert job.score((bought, "paid_date")) == 1 and {r[0] for r in job.features.read().select("as_of_date").collect()} == dates | {day(200)}
    assert job.train(bought) == 1 and job.features.read().count() == job.features.read(1).count()
