"""The ticketing model over the driver's tables: sources as raw records, then the clean, business and feature jobs themselves.

Orders are orders for one event each (the smallest part number among their lines), paid on the order date unless their
status is P, and refunded on the last ship date of their returned lines, if that is later. Parts are events, brands are venues, customers have
a change event more on a day of their own; lines with one number are one line, and clicks are the events moved to April 2001, so that they meet the orders.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.operators.contracts import conform, guarded, key_violations
from tidemark.operators.quality import annotate, valid
from tidemark.plans import features as fe
from tidemark.plans import gold, silver
from tidemark.plans.tables import CONTRACTS, RULES, SOURCES
from tidemark.sources import files
from tidemark.sources.tables import VersionedTable, kept, working_dir
from tidemark.streaming.runs import run_stream, windowed_counts

QUERIES: dict = {}
_TEXT = "yyyy-MM-dd HH:mm:ss"


def query(function):
    QUERIES[function.__name__] = function
    return function


def once_a_session(make):
    """What ``make(spark, sf_dir)`` gives, made once for each session and folder."""
    made = {}

    @wraps(make)
    def get(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in made:
            made[key] = make(spark, sf_dir)
        return made[key]

    return get


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(df: DataFrame, source: str) -> DataFrame:
    """As ingested: every field a string, with its origin."""
    made = df.select(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SOURCES[source]))
    return made.withColumns({files.FILE: F.lit(f"/in/{source}.json"), files.INGESTED: F.lit("2002-01-01").cast("timestamp")})


def _good(parsed: DataFrame, source: str) -> DataFrame:
    return valid(annotate(parsed, RULES[source]))


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw versions of each order: placed, paid, and refunded where lines came back."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_returnflag").alias("l_returnflag"), F.sum(F.col("l_quantity").cast("int")).alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"), F.min("l_partkey").alias("l_partkey"), F.max("l_shipdate").alias("l_shipdate"),
    )
    item = F.to_json(F.struct(F.col("l_linenumber").alias("line_no"), F.col("l_returnflag").alias("ticket_type"), F.col("l_quantity").alias("quantity"), F.round("l_extendedprice", 2).cast("decimal(10,2)").cast("string").alias("unit_price")))
    items = F.concat(F.lit("["), F.concat_ws(",", F.array_sort(F.collect_list(item))), F.lit("]"))  # an order has a few lines
    per_order = lines.groupBy("l_orderkey").agg(items.alias("items"), F.min("l_partkey").alias("event_id"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("back"))
    o = _table(spark, sf_dir, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    step = lambda status, at: F.struct(F.lit(status).alias("status"), F.date_format(at, _TEXT).alias("updated_at"))
    paid = F.when(F.col("o_orderstatus") != "P", step("paid", F.col("o_orderdate") + F.expr("interval 1 hour")))
    back = F.when((F.col("o_orderstatus") != "P") & (F.col("back") > F.col("o_orderdate") + F.expr("interval 1 hour")), step("Refunded", F.col("back")))
    versions = F.filter(F.array(step("placed", F.col("o_orderdate")), paid, back), lambda v: v.isNotNull())
    rows = o.withColumn("v", F.explode(versions)).select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), "event_id", F.date_format("o_orderdate", _TEXT).alias("order_ts"), "v.*", F.lit(" Web ").alias("channel"), F.lit("eur").alias("currency"), "items")
    return _raw(rows, "orders")


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    day = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("c_custkey") % 100).cast("int"))
    change = lambda lsn, op, at, tier: F.struct(F.lit(lsn).alias("lsn"), F.lit(op).alias("op"), at.cast("string").alias("changed_at"), tier.alias("loyalty_tier"))
    insert = change(1, "insert", F.lit("1990-01-01"), F.lit("standard"))
    update = change(2, "update", day, F.when(F.col("c_custkey") % 7 == 0, F.lit("Standard")).otherwise(F.col("c_mktsegment")))  # some change nothing
    delete = F.when(F.col("c_custkey") % 50 == 3, change(3, "delete", F.lit("2001-06-15"), F.lit(None).cast("string")))
    rows = c.withColumn("e", F.explode(F.filter(F.array(insert, update, delete), lambda e: e.isNotNull())))
    rows = rows.select(F.col("c_custkey").alias("customer_id"), "e.*", F.concat("c_name", F.lit("@example.com")).alias("email"), F.col("c_name").alias("full_name"), F.col("c_nationkey").alias("country"), (F.col("c_acctbal") > 0).alias("marketing_opt_in"), F.lit("1992-02-01").alias("signup_date"))
    return _raw(rows, "customers_cdc")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out evenly and written: a file of one row group is one task's work, and so would be all that is done row by row.

    They are written because a filter is pushed below a shuffle, and with it the parsing that it looks at.
    """
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return kept(rows.repartition(parts, *keys), "spread")


def raw_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = _spread(events, "event_id", "user_id", "ts").withColumn("ts", F.expr("ts - interval 273 months"))
    kinds = {"view": "View_Event", "click": "add_to_cart", "signup": "checkout", "purchase": "purchase"}
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.col("event_type")), F.lit("page_view"))
    device = F.element_at(F.array(*map(F.lit, ("web", "ios", "android"))), (F.col("user_id") % 3 + 1).cast("int"))
    rows = e.select("event_id", F.concat_ws("/", "user_id", F.to_date("ts")).alias("session_id"), F.when(F.col("user_id") % 10 != 9, F.col("user_id")).alias("customer_id"), kind.alias("event_type"), device.alias("device"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_ts"))
    return _raw(rows, "clickstream")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    events = part.select(F.col("p_partkey").cast("string").alias("event_id"), F.col("p_name").alias("artist"), F.col("p_type").alias("genre"), F.lit("2001-12-31").cast("date").alias("event_date"), F.col("p_brand").alias("venue_id"), F.col("p_retailprice").alias("base_price"), F.lit("2001-01-01").cast("date").alias("_snapshot_date"))
    venues = part.groupBy(F.col("p_brand").alias("venue_id")).agg(F.lower(F.first("p_brand")).alias("venue_name"), F.lit("Rome").alias("city"), F.lit("IT").alias("country"), F.max("p_size").alias("capacity"))
    return gold.dim_event(conform(events, CONTRACTS["silver.events"]), venues)


class World(dict):
    """The clean tables by the clean jobs' own functions; each is made and written when a job first asks for it.

    Versions of orders are parsed and marked in one pass, which is written, as a stream does with a batch: orders and lines read
    what has been parsed, and the parsing is not drawn into the rules that look at its result.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir, self.work = spark, sf_dir, working_dir(spark, "world")

    def _versions(self) -> DataFrame:
        marked = annotate(silver.parse_orders(order_versions(self.spark, self.sf_dir)), RULES["orders"])
        marked.write.parquet(f"{self.work}/versions")
        return valid(self.spark.read.parquet(f"{self.work}/versions"))

    def _made(self, name: str) -> DataFrame:
        spark, sf_dir = self.spark, self.sf_dir
        empty = lambda contract: spark.createDataFrame([], CONTRACTS[contract].schema)
        if name == "orders":
            return silver.order_changes(self["versions"])
        if name == "lines":
            return conform(merge.insert_new(empty("silver.order_items"), silver.order_lines(self["versions"]), ["order_id", "line_no"]), CONTRACTS["silver.order_items"])
        if name == "customers":
            return silver.merge_customers(empty("silver.customers"), _good(silver.parse_customers(customer_changes(spark, sf_dir)), "customers_cdc"))
        if name == "events":
            return _events(spark, sf_dir)
        if name == "clicks":
            return conform(_good(silver.parse_clicks(raw_clicks(spark, sf_dir)), "clickstream").withColumn("event_date", F.to_date("event_ts")), CONTRACTS["silver.clickstream"])
        raise KeyError(name)

    def __missing__(self, name: str) -> DataFrame:
        if name == "versions":
            self[name] = self._versions()
        else:
            self._made(name).write.parquet(f"{self.work}/{name}")
            self[name] = self.spark.read.parquet(f"{self.work}/{name}")
        return self[name]


@once_a_session
def world(spark: SparkSession, sf_dir: str) -> World:
    return World(spark, sf_dir)


def sales_of(w: dict[str, DataFrame]) -> DataFrame:
    return gold.fct_sales(w["orders"], w["lines"], w["customers"])


def sold_of(w: dict[str, DataFrame]) -> DataFrame:
    return gold.sold_lines(w["orders"], w["lines"])


def _plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, decimals as doubles, other doubles rounded: what both engines print alike."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "date":
            out[name] = F.col(name).cast("string")
        elif kind == "timestamp":
            out[name] = F.date_format(name, _TEXT)
        elif kind.startswith("decimal"):
            out[name] = F.col(name).cast("double")
        elif kind == "double":
            out[name] = F.round(name, 9)
    return df.withColumns(out)


@query
def clean_orders(spark, sf_dir):
    return _plain(world(spark, sf_dir)["orders"].select("order_id", "customer_id", "event_id", "order_date", "status", "channel", "currency", "order_amount", "ticket_count", "paid_at", "refunded_at", "updated_at"))


@query
def clean_order_lines(spark, sf_dir):
    return _plain(world(spark, sf_dir)["lines"])


@query
def clean_customers(spark, sf_dir):
    return _plain(gold.dim_customer(world(spark, sf_dir)["customers"]).select("customer_id", "email", "full_name", "country", "loyalty_tier", "marketing_opt_in", "signup_date", "valid_from", "valid_to", "is_current"))


@query
def clean_clicks(spark, sf_dir):
    return _plain(world(spark, sf_dir)["clicks"].select("event_id", "session_id", "customer_id", "event_type", "device", "event_ts", "event_date"))


@query
def dim_events(spark, sf_dir):
    return _plain(world(spark, sf_dir)["events"])


@query
def fct_sales(spark, sf_dir):
    """The fact table; its versions by the number of their first event instead of the surrogate key."""
    w = world(spark, sf_dir)
    version = w["customers"].select("customer_sk", F.col("_start_seq").alias("version"))
    return _plain(guarded(sales_of(w), CONTRACTS["gold.fct_sales"]).join(version, "customer_sk", "left").drop("customer_sk", "channel", "ticket_type"))


@query
def fact_keys(spark, sf_dir):
    """Keys of the fact table that are not unique: none."""
    fact = CONTRACTS["gold.fct_sales"]
    return key_violations(sales_of(world(spark, sf_dir)), fact).agg(F.count("*").alias("n"))


@query
def sales_by_tier(spark, sf_dir):
    """Fact and dimension by the surrogate key: net revenue by the tier that held at payment, and by country."""
    w = world(spark, sf_dir)
    joined = sales_of(w).join(gold.dim_customer(w["customers"]).select("customer_sk", "loyalty_tier", "country"), "customer_sk")
    return _plain(joined.groupBy("loyalty_tier", "country").agg(F.sum(F.col("gross_amount") - F.col("refunded_amount")).cast(gold.MONEY).alias("net"), F.count("*").alias("n")))


@query
def agg_daily_sales(spark, sf_dir):
    w = world(spark, sf_dir)
    return _plain(gold.daily_sales(sales_of(w), w["events"]))


@query
def agg_daily_sales_incremental(spark, sf_dir):
    """Built from what was known on a day, without rows that came late, then from three days before the newest day on."""
    w = world(spark, sf_dir)
    sales = kept(sales_of(w), "sales")  # built from twice
    known = sales.where("paid_date <= date'2000-06-30' and (paid_date <= date'2000-06-27' or cast(order_id as bigint) % 5 <> 0)")
    for c in ("refunded_date", "refunded_at", "refunded_amount"):
        known = known.withColumn(c, F.when(F.col("refunded_date") <= F.lit("2000-06-30").cast("date"), F.col(c)) if c != "refunded_amount" else F.when(F.col("refunded_date").isNull(), F.lit(0).cast("decimal(12,2)")).otherwise(F.col(c)))
    out = VersionedTable(spark, working_dir(spark, "daily"), "agg_daily_sales", CONTRACTS["gold.agg_daily_sales"].schema, partition=F.date_format("sales_date", "yyyy-MM"))
    gold.rebuild(out, "sales_date", lambda since: gold.daily_sales(known, w["events"], since))
    gold.rebuild(out, "sales_date", lambda since: gold.daily_sales(sales, w["events"], since))
    return _plain(out.read())


@query
def performance_of_events(spark, sf_dir):
    w = world(spark, sf_dir)
    return _plain(gold.event_performance(sales_of(w), w["events"]))


@query
def customers_360(spark, sf_dir):
    """As of the last day with clicks; only what had been sold and clicked by then is in the tables that are passed."""
    w = world(spark, sf_dir)
    last = w["clicks"].agg(F.max("event_date")).first()[0]  # one date
    as_of = F.lit(last).cast("date")
    return _plain(gold.customer_360(w["customers"], sold_of(w).where(F.col("paid_date") <= as_of), w["events"], w["clicks"], as_of))


@query
def funnel_of_days(spark, sf_dir):
    return _plain(gold.funnel_daily(world(spark, sf_dir)["clicks"]))


@query
def funnel_incremental(spark, sf_dir):
    """Days up to the 20th, then a rebuild from the newest day less the lookback on."""
    clicks = world(spark, sf_dir)["clicks"]
    out = VersionedTable(spark, working_dir(spark, "funnel"), "funnel_daily", CONTRACTS["gold.funnel_daily"].schema, partition=F.date_format("session_date", "yyyy-MM"))
    early = clicks.where("event_date <= date'2001-04-20'")
    gold.rebuild(out, "session_date", lambda since: gold.funnel_daily(early, since))
    gold.rebuild(out, "session_date", lambda since: gold.funnel_daily(clicks, since))
    return _plain(out.read())


@query
def engagement_of_days(spark, sf_dir):
    return _plain(gold.engagement(world(spark, sf_dir)["clicks"]))


@query
def live_sessions(spark, sf_dir):
    """Windows of a stream with about how many sessions each has; exact counts stand beside them, and whether both are within one or a tenth."""
    work = working_dir(spark, "sessions")
    clicks = world(spark, sf_dir)["clicks"]
    clicks.write.parquet(f"{work}/in")
    stream = spark.readStream.schema(clicks.schema).parquet(f"{work}/in")
    run_stream(windowed_counts(stream, "event_ts", "event_type", "session_id"), "live_sessions", f"{work}/checkpoint", path=f"{work}/out")
    exact = clicks.groupBy(F.window("event_ts", "5 minutes")["start"].alias("window_start"), "event_type").agg(F.count_distinct("session_id").alias("exact"))
    both = spark.read.parquet(f"{work}/out").join(exact, ["window_start", "event_type"])
    return _plain(both.select("window_start", "event_type", "events", "exact", (F.abs(F.col("sessions") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.1 * F.col("exact"))).alias("close")))


def _dates(orders: DataFrame) -> DataFrame:
    bounds = orders.where("paid_at is not null").agg(F.min(F.to_date("paid_at")).alias("first"), F.max(F.to_date("paid_at")).alias("last"))
    return fe.training_dates(bounds, "first", "last")


@query
def feature_population(spark, sf_dir):
    w = world(spark, sf_dir)
    return _plain(fe.population(_dates(w["orders"]), w["orders"], w["customers"]).select("customer_id", "as_of_date", "loyalty_tier", "country"))


@query
def customer_features(spark, sf_dir):
    """The whole feature table: 17 features of every customer on every training date on which it is in the population."""
    w = world(spark, sf_dir)
    return _plain(fe.features(_dates(w["orders"]), w["orders"], sold_of(w), w["events"], w["clicks"], w["customers"]))


@query
def reference_snapshots(spark, sf_dir):
    """Dated CSV snapshots, each file loaded once, with a full refresh after; the newest snapshot counts as a whole."""
    work = working_dir(spark, "snapshots")
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_name").alias("artist"), F.col("p_type").alias("genre"), F.lit("2001-12-31").alias("event_date"), F.col("p_brand").alias("venue_id"), F.round(F.col("p_retailprice"), 2).alias("base_price"))
    filesystem = spark._jvm.org.apache.hadoop.fs.Path(work).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path

    def drop_file(rows: DataFrame, day: str) -> None:
        """One CSV file of the day in the landing folder."""
        rows.coalesce(1).write.option("header", True).csv(f"{work}/{day}")
        (made,) = [s.getPath() for s in filesystem.listStatus(path(f"{work}/{day}")) if s.getPath().getName().endswith(".csv")]
        filesystem.mkdirs(path(f"{work}/in"))
        filesystem.rename(made, path(f"{work}/in/events_{day}.csv"))

    drop_file(part, "20010101")
    silver.ingest_reference(spark, "events", f"{work}/in", f"{work}/raw")
    drop_file(part.where("event_id % 4 <> 0").withColumn("base_price", F.col("base_price") + 1), "20010108")
    silver.ingest_reference(spark, "events", f"{work}/in", f"{work}/raw")
    first = spark.read.parquet(f"{work}/raw/events_raw").count()
    silver.ingest_reference(spark, "events", f"{work}/in", f"{work}/raw", full_refresh=True)
    raw = spark.read.parquet(f"{work}/raw/events_raw")
    newest = silver.latest_snapshot(raw, "events", "event_id").withColumn("raw_rows", F.lit(first).cast("long"))
    return _plain(newest)
