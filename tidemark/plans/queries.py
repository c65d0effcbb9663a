"""Every operator as a query over the driver's tables. The ticketing roles are played by: orders and lineitem as orders and
their lines (paid on the order date, refunded on the ship date of returned lines), part as shows (type as genre, size as
capacity), events as clicks and as change events of their users.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import mask_email, ratio, region_filter, snapshot_date
from tidemark.operators import merge
from tidemark.operators.contracts import Contract, check_violations, conform, key_violations
from tidemark.operators.quality import FAILED, WARNED, Rule, annotate, broken, gate, measure, metric_rows, quarantine, thresholds, valid
from tidemark.plans import features as fe
from tidemark.plans import gold, ml, ticketing
from tidemark.sources import kafka
from tidemark.sources.files import FILE, new_files_only, read_csv, rescue
from tidemark.sources.tables import AppendedTable, VersionedTable, bookmarked_export, export_changes, kept, working_dir
from tidemark.streaming.runs import deduplicate_stream, insert_handler, run_stream, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(ticketing.QUERIES)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(moment) -> F.Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def cents(column) -> F.Column:
    """A sum in exact decimals, as a double."""
    return F.coalesce(F.sum(column.cast("decimal(18,2)")), F.lit(0)).cast("double")


#: About how many lines a task joins with their orders where it then adds them up by order.
LINES_A_TASK = 500_000


def fact(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """One row a line with its order and part.

    ``by_order``: they are to be added up by order next, which the tasks of the join do, in memory. So there are as many tasks as
    lines ask for: left alone, Spark gives each as many lines as 64 MB hold when packed, or all by the session's number of tasks.
    """
    li, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    if by_order and (tasks := -(-li.count() // LINES_A_TASK)) > spark.sparkContext.defaultParallelism:  # the count is read from the files' ends
        li, o = li.repartition(tasks, "l_orderkey"), o.repartition(tasks, "o_orderkey")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return joined.withColumns({"paid_date": F.to_date("o_orderdate"), "refunded_date": F.when(F.col("l_returnflag") == "R", F.to_date("l_shipdate"))})


def daily(facts: DataFrame, known: str = "true", keys: tuple[str, ...] = ("p_type", "p_brand")) -> DataFrame:
    """By the lines' own dates: every line was sold, a returned one came back. ``known``: of which ledger entries; ``keys``: the grain."""
    amount = F.col("l_extendedprice")
    entries = gold.ledger(facts, amount, amount, F.col("l_quantity"), F.col("paid_date"), F.col("refunded_date"))
    out = gold.daily_totals(entries.where(known), list(keys), "o_orderkey")
    return out.withColumns({c: F.col(c).cast("double") for c in ("gross_revenue", "refunded_amount", "net_revenue")})


@query
def daily_sales(spark, sf_dir):
    return daily(fact(spark, sf_dir, by_order=True)).withColumn("sales_date", F.col("sales_date").cast("string"))


@query
def daily_sales_incremental(spark, sf_dir):
    """Built up to a day, of which one line in ten comes late, then from the newest day less the lookback on: the same as in one go."""
    facts = fact(spark, sf_dir, by_order=True)
    known = "entry_date <= date'1998-01-01' and (entry_date < date'1997-12-30' or l_orderkey % 10 <> 0)"
    out = VersionedTable(spark, working_dir(spark, "daily"), "agg_daily_sales", daily(facts).schema, partition=F.date_format("sales_date", "yyyy-MM"))
    gold.rebuild(out, "sales_date", lambda since: daily(facts, known))
    gold.rebuild(out, "sales_date", lambda since: daily(facts).where(F.col("sales_date") >= since))
    return out.read().withColumn("sales_date", F.col("sales_date").cast("string"))


def user_changes(events: DataFrame) -> DataFrame:
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts")))
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_id"), first("purchase").alias("first_purchase"), first("signup").alias("first_signup"), F.max("ts").alias("last_seen"))


@query
def scd1_orders_state(spark, sf_dir):
    """Three slices of the stream, the newest first: the state does not depend on their order."""
    events = table(spark, sf_dir, "events")
    batches = [user_changes(events.where(F.col("event_id") % 3 == k)) for k in (2, 0, 1)]
    state = batches[0]
    for batch in batches[1:]:
        state = merge.upsert_latest(state, batch, ["user_id"], "last_id", ["first_purchase", "first_signup"], ["last_seen"])
    return state.select("user_id", "last_type", "last_id", *(text(c).alias(c) for c in ("first_purchase", "first_signup", "last_seen")))


def history(spark: SparkSession, events: DataFrame, batches: int = 4) -> DataFrame:
    """Versions of each user's last event type; ``error`` deletes. The batches follow each other in sequence."""
    state = merge.empty_history(spark, {"user_id": "long"}, {"event_type": "string"})
    bounds = events.agg(F.max("event_id")).first()[0] or 0
    step = bounds // batches + 1
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    kept = VersionedTable(spark, working_dir(spark, "history"), "versions", state.schema, buckets=(["user_id"], 16))  # a version a batch, as a stream keeps it
    for k in range(batches):
        part = rows.where((F.col("event_id") >= k * step) & (F.col("event_id") < (k + 1) * step))
        kept.merge(part, lambda versions, batch: merge.merge_history(versions, batch, ["user_id"], ["event_type"], "event_id", "at", F.col("event_type") == "error"))
    return kept.read()


@query
def scd2_history(spark, sf_dir):
    return history(spark, table(spark, sf_dir, "events")).select("user_id", "event_type", F.col("_start_seq").alias("start_seq"), F.col("_end_seq").alias("end_seq"), "is_current", text("valid_from").alias("valid_from"))


@query
def auto_cdc_history(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    state = spark.createDataFrame([], "user_id long, event_type string, `__START_AT` long, `__END_AT` long")
    half = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    for part in (events.where(F.col("event_id") <= half), events.where(F.col("event_id") > half)):
        state = merge.auto_cdc(state, part, ["user_id"], "event_id", F.col("event_type") == "error")
    return state.select("user_id", "event_type", F.col("__START_AT").alias("start_at"), F.col("__END_AT").alias("end_at"))


@query
def most_versions(spark, sf_dir):
    """The user with the most versions, and its history."""
    versions = history(spark, table(spark, sf_dir, "events"))
    top = versions.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1).select("user_id")
    return versions.join(top, "user_id", "left_semi").select("user_id", F.col("_start_seq").alias("start_seq"), "event_type")


@query
def insert_new_only(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    target = events.where("event_id % 4 <> 1")
    source = events.where("event_id % 4 <> 2").unionByName(events.where("event_id % 4 = 1"))
    return target.unionByName(merge.insert_new(target, source, ["event_id"], "day")).select("event_id", "user_id", "event_type")


@query
def snapshot_replace(spark, sf_dir):
    """Two weekly snapshots by file name; the newer counts as a whole."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    old = part.withColumn(FILE, F.lit("/in/parts_20240101.csv"))
    new = part.where("p_partkey % 3 <> 0").withColumns({"p_retailprice": F.col("p_retailprice") + 1, FILE: F.lit("/in/parts_20240108.csv")})
    other = part.withColumn(FILE, F.lit("/in/parts_latest.csv"))
    dated = old.unionByName(new).unionByName(other).withColumn("day", snapshot_date(F.col(FILE)))
    newest = dated.agg(F.max("day").alias("newest"))
    return dated.join(F.broadcast(newest), F.col("day") == F.col("newest"), "left_semi").dropDuplicates(["p_partkey"]).select("p_partkey", "p_name", F.round("p_retailprice", 2).alias("price"))


LINE_RULES = [
    Rule("known_discount", "l_discount between 0 and 0.08"),
    Rule("ships_after_order", "l_shipdate >= o_orderdate"),
    Rule("small_quantity", "l_quantity <= 45", "warn"),
]
CUSTOMER_RULES = [Rule("has_balance", "c_acctbal >= 0"), Rule("known_segment", "c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')", "warn")]


def lines_with_orders(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey)


@query
def expectations(spark, sf_dir):
    marked = annotate(lines_with_orders(spark, sf_dir), LINE_RULES)
    return marked.groupBy(F.concat_ws(",", FAILED).alias("failed"), F.concat_ws(",", WARNED).alias("warned")).agg(F.count("*").alias("n"))


@query
def valid_lines(spark, sf_dir):
    good = valid(annotate(lines_with_orders(spark, sf_dir), LINE_RULES))
    return good.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), cents(F.col("l_extendedprice")).alias("amount"))


@query
def inverted_rules(spark, sf_dir):
    return broken(table(spark, sf_dir, "customer"), CUSTOMER_RULES).select("c_custkey", "c_mktsegment")


@query
def quality_measures(spark, sf_dir):
    return measure(annotate(lines_with_orders(spark, sf_dir), LINE_RULES), LINE_RULES)


def _run_metrics(spark, sf_dir):
    lines = metric_rows(annotate(lines_with_orders(spark, sf_dir), LINE_RULES), LINE_RULES, "lineitem", "run1")
    return lines.unionByName(metric_rows(annotate(table(spark, sf_dir, "customer"), CUSTOMER_RULES), CUSTOMER_RULES, "customer", "run1"))


@query
def quality_gate(spark, sf_dir):
    over = gate(_run_metrics(spark, sf_dir), "run1", thresholds(spark, {"customer": 0.9, "*": 0.02}))
    return over.select("source_table", "rejected_rows", "total_rows", F.round("rate", 9).alias("rate"), "limit")


@query
def failure_rates(spark, sf_dir):
    return _run_metrics(spark, sf_dir).groupBy("source_table", "rule").agg(F.round(F.sum("failed_rows") / F.sum("total_rows"), 9).alias("rate"))


@query
def quarantine_by_rule(spark, sf_dir):
    marked = annotate(lines_with_orders(spark, sf_dir).withColumns({"payload": F.to_json(F.struct("l_orderkey", "l_linenumber")), "file": F.lit("lineitem")}), LINE_RULES)
    return quarantine(marked, "lineitem", "l_orderkey", "payload", "file", "run1").select("source_table", F.explode("failed_rules").alias("rule")).groupBy("source_table", "rule").agg(F.count("*").alias("n"))


@query
def key_contract(spark, sf_dir):
    """Keys of the lines that are not unique."""
    keyed = Contract("lineitem", {"l_orderkey": "bigint", "l_linenumber": "int"}, ("l_orderkey", "l_linenumber"))
    return key_violations(conform(table(spark, sf_dir, "lineitem"), keyed), keyed).select("l_orderkey", "l_linenumber", F.col("rows").alias("n"), "problem")


@query
def check_constraints(spark, sf_dir):
    c = Contract("orders", {"o_orderstatus": "string", "o_totalprice": "double"}, (), (), {"known_status": "o_orderstatus in ('O', 'F')", "positive_price": "o_totalprice > 1000"})
    return check_violations(conform(table(spark, sf_dir, "orders"), c), c).select("check", F.col("rows").alias("n"))


@query
def latest_per_user(spark, sf_dir):
    return merge.latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [-F.col("event_id")]).select("user_id", "event_type", "event_id")


def _purchases_with_version(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("paid_at"))
    versions = history(spark, events.where("event_type <> 'purchase'")).withColumnsRenamed({"event_type": "tier", "_start_seq": "version"})
    return gold.point_in_time(purchases, versions, "user_id", "paid_at", ["tier", "version"])


@query
def pit_fact(spark, sf_dir):
    return _purchases_with_version(spark, sf_dir).select("event_id", "user_id", "tier", "version")


@query
def pit_tier_revenue(spark, sf_dir):
    rows = _purchases_with_version(spark, sf_dir)
    return rows.groupBy(F.date_format("paid_at", "yyyy-MM").alias("month"), "tier").agg(cents(F.col("value")).alias("revenue"), F.count("*").alias("n"))


def _performance(spark, sf_dir):
    facts = fact(spark, sf_dir)
    kept = F.when(F.col("refunded_date").isNull(), F.col("l_quantity").cast("long")).otherwise(F.lit(0).cast("long"))
    back = F.when(F.col("refunded_date").isNotNull(), F.col("l_extendedprice"))
    sums = facts.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(kept).alias("tickets_sold"), cents(F.col("l_extendedprice")).alias("gross"), cents(back).alias("refunded"), F.min("paid_date").alias("first_sale"), F.max("paid_date").alias("last_sale"))
    joined = table(spark, sf_dir, "part").join(sums, "p_partkey", "left").na.fill(0, ["tickets_sold", "gross", "refunded"])
    return joined.withColumn("sell_through", F.round(F.when(F.col("p_size") > 0, F.col("tickets_sold") / F.col("p_size")), 9))


@query
def event_performance(spark, sf_dir):
    return _performance(spark, sf_dir).select("p_partkey", "tickets_sold", "gross", "refunded", F.round(F.col("gross") - F.col("refunded"), 2).alias("net"), "sell_through", F.col("first_sale").cast("string").alias("first_sale"), F.col("last_sale").cast("string").alias("last_sale"))


@query
def top_sell_through(spark, sf_dir):
    """The 20 shows closest to selling out, of those with a first sale after the earliest."""
    rows = _performance(spark, sf_dir)
    first = rows.agg(F.min("first_sale").alias("earliest"))
    return rows.join(F.broadcast(first), F.col("first_sale") > F.col("earliest")).orderBy(F.desc("sell_through"), "p_partkey").limit(20).select("p_partkey", "sell_through")


def _customers(spark, sf_dir):
    facts = fact(spark, sf_dir)
    back = F.when(F.col("refunded_date").isNotNull(), F.col("o_orderkey"))
    bought = facts.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("paid_date").alias("first_purchase"), F.max("paid_date").alias("last_purchase"), F.count_distinct("o_orderkey").alias("orders"), F.count_distinct(back).alias("refunded_orders"), cents(F.when(F.col("refunded_date").isNull(), F.col("l_extendedprice"))).alias("net"))
    liked = gold.favourite(facts.withColumn("l_quantity", F.col("l_quantity").cast("long")), "o_custkey", "p_type", "l_quantity").select(F.col("o_custkey").alias("c_custkey"), F.col("p_type").alias("favourite"))
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("clicks"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.join(bought, "c_custkey", "left").join(liked, "c_custkey", "left").join(seen, "c_custkey", "left").na.fill(0, ["orders", "refunded_orders", "net", "clicks"])


@query
def customer_360(spark, sf_dir):
    last = F.lit("2001-12-31").cast("date")
    return _customers(spark, sf_dir).select("c_custkey", "c_mktsegment", "orders", "refunded_orders", "net", "favourite", "clicks", F.date_diff(last, F.col("last_purchase")).alias("days_since"))


@query
def favourite_type(spark, sf_dir):
    facts = fact(spark, sf_dir).withColumn("l_quantity", F.col("l_quantity").cast("long"))
    return gold.favourite(facts, "o_custkey", "p_type", "l_quantity")


@query
def quiet_customers(spark, sf_dir):
    """High value, long silent: the 25 with the most revenue."""
    rows = _customers(spark, sf_dir).where("last_purchase < date'2001-01-01'")
    return rows.orderBy(F.desc("net"), "c_custkey").limit(25).select("c_custkey", "net")


STEPS = {"viewed": "view", "clicked": "click", "signed_up": "signup", "purchased": "purchase"}


def _funnel(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumns({"session": F.concat_ws("/", "user_id", F.to_date("ts")), "device": (F.col("user_id") % 3).cast("string")})
    rolled = gold.sessions(events, "session", "ts", "event_type", "device", STEPS)
    return gold.funnel(rolled, list(STEPS))


@query
def funnel(spark, sf_dir):
    out = _funnel(spark, sf_dir).withColumn("view_to_purchase", F.round(ratio(F.col("purchased"), F.col("viewed")), 9))
    return out.withColumn("session_date", F.col("session_date").cast("string"))


@query
def conversion_by_device(spark, sf_dir):
    sums = _funnel(spark, sf_dir).groupBy("device").agg(*(F.sum(c).alias(c) for c in ("sessions", *STEPS)))
    return sums.withColumn("conversion", F.round(ratio(F.col("purchased"), F.col("sessions")), 9))


@query
def engagement(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("event_date"), "event_type", F.concat_ws("/", "user_id", F.to_date("ts")).alias("session_id"), F.col("user_id").alias("customer_id"))
    return gold.engagement(rows).withColumn("event_date", F.col("event_date").cast("string"))


@query
def live_engagement(spark, sf_dir):
    """A stream of windows in append mode: those that end by the newest event less the watermark."""
    work = working_dir(spark, "live")
    table(spark, sf_dir, "events").write.parquet(f"{work}/in")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{work}/in")
    counts = windowed_counts(stream, "ts", "event_type", None)
    run_stream(counts, "live_engagement", f"{work}/checkpoint", path=f"{work}/out")
    return spark.read.parquet(f"{work}/out").select(text("window_start").alias("window_start"), "event_type", "events")


@query
def stream_dedup(spark, sf_dir):
    work = working_dir(spark, "dedup")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    events.unionByName(events.where("event_id % 5 = 0")).write.parquet(f"{work}/in")
    stream = deduplicate_stream(spark.readStream.schema(events.schema).parquet(f"{work}/in"), ["event_id"], "ts")
    run_stream(stream, "stream_dedup", f"{work}/checkpoint", path=f"{work}/out")
    return spark.read.parquet(f"{work}/out").select("event_id", "event_type")


@query
def stream_insert_once(spark, sf_dir):
    """Copies in one batch and over batches: each id is kept once, however late."""
    work = working_dir(spark, "once")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    events.unionByName(events.where("event_id % 7 = 0")).repartition(3).write.parquet(f"{work}/in")
    target = AppendedTable(spark, work, "clicks", events.schema)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    run_stream(stream, "stream_insert_once", f"{work}/checkpoint", handler=insert_handler(target, lambda b, _: b, ["event_id"]))
    return target.read()


@query
def rescue_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", rescue(F.col("props"), ["z"]).alias("rescued"), rescue(F.col("props"), ["k"]).alias("nothing"))
    k = F.get_json_object("rescued", "$.k").cast("long")
    return rows.groupBy("event_type").agg(F.count("rescued").alias("rescued"), F.count("nothing").alias("nothing"), F.sum(k).alias("total"))


@query
def kafka_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 50 == 0, F.lit("not json")).otherwise(F.col("props"))
    records = e.select(value.cast("binary").alias("value"), F.lit("events").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))
    return kafka.decode(records, ["k"]).select(F.col(FILE).alias("source_file"), F.expr("try_cast(k as bigint)").alias("k"), F.col("_rescued_data").alias("rescued"))


@query
def file_load_once(spark, sf_dir):
    """Two loads of one folder; the second finds only the file that was added."""
    work = working_dir(spark, "load")
    names = ["event_id", "user_id", "event_type"]
    events = table(spark, sf_dir, "events").select(*(F.col(n).cast("string").alias(n) for n in names))
    first = events.where("event_id % 2 = 0")
    first.write.option("header", True).csv(f"{work}/in")
    loaded = read_csv(spark, f"{work}/in", names)
    loaded.write.parquet(f"{work}/t")
    events.where("event_id % 2 = 1").write.mode("append").option("header", True).csv(f"{work}/in")
    new_files_only(read_csv(spark, f"{work}/in", names), spark.read.parquet(f"{work}/t")).write.mode("append").parquet(f"{work}/t")
    return spark.read.parquet(f"{work}/t").select(*(F.col(n).cast("bigint" if n != "event_type" else "string").alias(n) for n in names))


def _dates(spark, sf_dir):
    bounds = table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    return fe.training_dates(bounds, "first", "last")


def _orders(spark, sf_dir):
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("refunded_date"))
    return table(spark, sf_dir, "orders").withColumn("paid_date", F.to_date("o_orderdate")).join(back, "o_orderkey", "left")


def _who(spark, sf_dir):
    paid = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("paid_date"))
    return fe.on_dates(paid, "o_custkey", "paid_date", _dates(spark, sf_dir), fe.YEAR)


def _order_features(spark, sf_dir, who=None):
    return fe.order_features(who or _who(spark, sf_dir), _orders(spark, sf_dir), "o_custkey", "o_orderkey", "o_totalprice")


def _labels(spark, sf_dir, who=None):
    last = table(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate"))).first()[0]  # one date
    paid = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("paid_date"))
    return fe.labels(who or _who(spark, sf_dir), paid, F.lit(last).cast("date"), "o_custkey")


@query
def features_orders(spark, sf_dir):
    doubles = ("revenue_90d", "revenue_365d")
    return _order_features(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in doubles} | {"as_of_date": F.col("as_of_date").cast("string")})


@query
def features_lines(spark, sf_dir):
    lines = fact(spark, sf_dir).select("o_custkey", "paid_date", F.col("l_extendedprice").cast("decimal(18,2)").alias("gross_amount"), F.col("l_quantity").cast("long").alias("quantity"), "p_type")
    out = fe.line_features(_who(spark, sf_dir), lines, "o_custkey", "p_type")
    return out.withColumns({"as_of_date": F.col("as_of_date").cast("string")})


@query
def churn_labels(spark, sf_dir):
    return _labels(spark, sf_dir).withColumn("as_of_date", F.col("as_of_date").cast("string"))


def _training_rows(spark, sf_dir):
    last = table(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate"))).first()[0]  # one date
    return fe.split_by_time(fe.training_rows(_dates(spark, sf_dir), _orders(spark, sf_dir), F.lit(last).cast("date"), "o_custkey", "o_totalprice"))


@query
def training_set(spark, sf_dir):
    rows = _training_rows(spark, sf_dir)
    return rows.groupBy(F.col("as_of_date").cast("string").alias("as_of_date"), "split").agg(F.count("*").alias("n"), F.sum("churned").alias("churned"))


@query
def churned_history(spark, sf_dir):
    """One customer that churned at least twice, over all dates, with the labels where they exist."""
    marks = _labels(spark, sf_dir)
    one = marks.groupBy("o_custkey").agg(F.sum("churned").alias("n")).where("n > 1").orderBy("o_custkey").limit(1).select("o_custkey")
    rows = _order_features(spark, sf_dir).join(one, "o_custkey", "left_semi").join(marks, ["o_custkey", "as_of_date"], "left")
    return rows.select("o_custkey", F.col("as_of_date").cast("string").alias("as_of_date"), "recency_days", "churned")


@query
def features_engagement(spark, sf_dir):
    """Weekly, of the users with an event in the 30 days before."""
    clicks = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("event_date"), "event_type")
    dates = clicks.agg(F.min("event_date").alias("a"), F.max("event_date").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("as_of_date"))
    who = fe.on_dates(clicks, "user_id", "event_date", dates, 30)
    out = fe.engagement_features(who, clicks, "user_id", "event_type", "click")
    return out.withColumns({"as_of_date": F.col("as_of_date").cast("string"), "engagement_ratio": F.round("engagement_ratio", 9)})


@query
def moving_average(spark, sf_dir):
    """Net revenue by day and its average over seven rows; the window runs over one row a day."""
    days = daily(fact(spark, sf_dir, by_order=True), keys=()).select("sales_date", F.col("net_revenue").alias("net"))
    average = F.avg(F.col("net").cast("decimal(18,2)")).over(Window.orderBy("sales_date").rowsBetween(-6, 0))
    return days.select(F.col("sales_date").cast("string").alias("sales_date"), "net", F.round(average.cast("double"), 2).alias("average"))


@query
def psi_drift(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return ml.psi(li.where("year = 1996"), li.where("year = 2000"), names).withColumn("psi", F.round("psi", 5))


def _scored(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").where("quality is not null")
    rows = lab.join(d, "doc_id")
    one = rows.select("doc_id", F.lit("champion").alias("role"), F.col("quality").alias("label"), (F.round(F.col("n_chars") / 100).cast("double") % 97 / 97).alias("score"))
    two = rows.select("doc_id", F.lit("challenger").alias("role"), F.col("quality").alias("label"), F.least(F.lit(1.0), F.round(F.col("n_chars") / 100) / 100).alias("score"))
    return one.unionByName(two)


@query
def eval_metrics(spark, sf_dir):
    out = ml.metrics(_scored(spark, sf_dir), ["role"], tie="doc_id")
    return out.select("role", "test_rows", *(F.round(c, 6).alias(c) for c in ("roc_auc", "pr_auc", "log_loss", "brier", "base_rate", "top_decile_lift")))


@query
def compare_models(spark, sf_dir):
    return ml.compare(ml.metrics(_scored(spark, sf_dir), ["role"])).select("promote", F.concat_ws("; ", "reasons").alias("reasons"))


def _load_scorer():
    import numpy as np

    return lambda pdf: 1 / (1 + np.exp(-(pdf["recency_days"] / 100.0 - pdf["orders_365d"])))


def _predictions(spark, sf_dir):
    rows = _order_features(spark, sf_dir).select("o_custkey", "as_of_date", "recency_days", "orders_365d")
    scored = ml.score_batches(rows, _load_scorer, ["o_custkey", "as_of_date"], "o_custkey long, as_of_date date, score double")
    return scored.withColumn("risk_band", ml.risk_band(F.col("score")))


@query
def batch_scoring(spark, sf_dir):
    return _predictions(spark, sf_dir).withColumns({"as_of_date": F.col("as_of_date").cast("string"), "score": F.round("score", 9)})


@query
def risk_bands(spark, sf_dir):
    return _predictions(spark, sf_dir).groupBy("risk_band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("average"))


@query
def train_churn(spark, sf_dir):
    """Boosted trees on the training dates, measured on the test dates."""
    rows = _training_rows(spark, sf_dir)
    rows = rows.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    numeric, categorical = ["recency_days", "orders_30d", "orders_90d", "orders_365d", "revenue_90d", "revenue_365d", "refunds_365d"], ["c_mktsegment"]
    ready = ml.prepare(rows, numeric, categorical).select(*numeric, *(f"{c}_missing" for c in numeric), *categorical, "churned", "split")
    model = ml.train(ready.where("split = 'train'"), numeric, categorical, "churned")
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(ready.where("split = 'test'")).select(F.col("churned").alias("label"), vector_to_array("probability")[1].alias("score"))
    return ml.metrics(scored)


def _two_snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    before = o.where("o_orderkey % 10 <> 1")
    after = o.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 3, "X").otherwise(F.col("o_orderstatus")))
    return before, after


@query
def snapshot_diff(spark, sf_dir):
    return merge.snapshot_diff(*_two_snapshots(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "price", F.col("_change_type").alias("change"))


@query
def snapshot_counts(spark, sf_dir):
    """Rows now and before, and changes by kind and status."""
    before, after = _two_snapshots(spark, sf_dir)
    counts = before.groupBy(F.lit("before").alias("what"), "o_orderstatus").agg(F.count("*").alias("n")).unionByName(after.groupBy(F.lit("after").alias("what"), "o_orderstatus").agg(F.count("*").alias("n")))
    diff = merge.snapshot_diff(before, after, ["o_orderkey"])
    return counts.unionByName(diff.groupBy(F.col("_change_type").alias("what"), "o_orderstatus").agg(F.count("*").alias("n")))


@query
def crm_export(spark, sf_dir):
    """Inserted rows and new images of expensive orders, as JSON files, read again."""
    work = working_dir(spark, "export")
    diff = merge.snapshot_diff(*_two_snapshots(spark, sf_dir), ["o_orderkey"], images=False)
    export_changes(diff, F.col("price") > 1000, f"{work}/out", files=4)
    return spark.read.schema("o_orderkey long, o_orderstatus string, price double").json(f"{work}/out")


@query
def bookmark_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"))
    return merge.upsert_all(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("balance", F.lit(0.0)), ["c_custkey"])


@query
def compaction(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = VersionedTable(spark, working_dir(spark, "compact"), "lineitem", li.schema)
    t.overwrite(li.repartition(16))
    t.compact(cluster=["l_shipdate", "l_orderkey"])
    return t.read().select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"), F.col("l_shipdate").cast("date").cast("string").alias("shipped"))


@query
def replace_where(spark, sf_dir):
    """Rows of one year replaced by fewer of them: the others of that year go."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    t = VersionedTable(spark, working_dir(spark, "replace"), "orders", o.schema)
    t.overwrite(o)
    t.replace_where(o.where("year = 1997 and o_orderkey % 2 = 0"), F.col("year") == 1997)
    return t.read()


@query
def masked_view(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    mail = F.concat("c_name", F.lit("@example.com"))
    return joined.where(region_filter(F.col("r_name"), ["EUROPE", "Asia"])).select("c_custkey", mask_email(mail, False).alias("mail"), "r_name")


@query
def active_keys(spark, sf_dir):
    """Customers with an order or an event."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).union(table(spark, sf_dir, "events").select("user_id")).distinct()


@query
def run_log_report(spark, sf_dir):
    """Runs, failures and mean value by task, over events as a run log."""
    table(spark, sf_dir, "events").createOrReplaceTempView("run_log")
    return spark.sql("select event_type as task, count(*) as runs, count_if(value > 90) as failures, round(avg(cast(value as decimal(18,4))), 4) as mean from run_log group by all").withColumn("mean", F.col("mean").cast("double"))


@query
def run_log_shares(spark, sf_dir):
    """Runs by task beside those of all tasks, an aggregate inside a window, and how long each task has been run."""
    table(spark, sf_dir, "events").createOrReplaceTempView("run_log")
    return spark.sql("select event_type as task, any_value(event_type) as example, count(*) as runs, sum(count(*)) over () as all_runs, timestampdiff(MINUTE, min(ts), max(ts)) as minutes from run_log group by event_type")


@query
def above_own_average(spark, sf_dir):
    """Events of more than their user's average value, by type: a correlated subquery.

    In exact decimals: sums of doubles depend on the order of the rows, and so would which value equals its average.
    """
    return above_average(table(spark, sf_dir, "events"))


def above_average(events: DataFrame) -> DataFrame:
    exact = events.withColumn("value", F.expr("try_cast(value as decimal(28, 8))"))
    exact.createOrReplaceTempView("run_log_exact")
    return events.sparkSession.sql("select event_type, count(*) as n from run_log_exact e where value > (select avg(value) from run_log_exact u where u.user_id = e.user_id) group by event_type")


@query
def ingest_days(spark, sf_dir):
    """Raw rows a day, how many of them have rescued fields, and one such."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), rescue(F.col("props"), ["z"]).alias("rescued"))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.count("rescued").alias("with_rescued"), F.min("rescued").alias("example"))


@query
def feature_dates_replaced(spark, sf_dir):
    """Features of some dates written twice: the second run replaces the rows of its dates only."""
    dates = _dates(spark, sf_dir)
    build = lambda d: fe.order_features(_who(spark, sf_dir).join(F.broadcast(d), "as_of_date", "left_semi"), _orders(spark, sf_dir), "o_custkey", "o_orderkey", "o_totalprice")
    t = VersionedTable(spark, working_dir(spark, "features"), "customer_features", build(dates).schema, partition=F.date_format("as_of_date", "yyyy"))
    fe.run_features(t, dates, build)
    fe.run_features(t, dates.where("as_of_date >= date'1997-01-01'"), build)
    return t.read().select("o_custkey", F.col("as_of_date").cast("string").alias("as_of_date"), "orders_365d")


def _feature_job(spark, sf_dir) -> tuple[fe.FeatureJob, DataFrame]:
    """The job over orders, after a training run, and the purchases."""
    paid = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("paid_date"))
    build = lambda d: fe.order_features(fe.on_dates(paid, "o_custkey", "paid_date", d, fe.YEAR), _orders(spark, sf_dir), "o_custkey", "o_orderkey", "o_totalprice")
    work, month = working_dir(spark, "job"), F.date_format("as_of_date", "yyyy-MM")
    shape = build(spark.createDataFrame([], "as_of_date date")).schema
    marks = spark.createDataFrame([], "o_custkey long, as_of_date date, churned int").schema
    job = fe.FeatureJob(VersionedTable(spark, work, "features", shape, partition=month), VersionedTable(spark, work, "labels", marks, partition=month), build, "o_custkey")
    job.train(paid)
    return job, paid


@query
def feature_job_training(spark, sf_dir):
    """Training mode: features of all training dates, and labels, by date."""
    job, _ = _feature_job(spark, sf_dir)
    both = job.features.read().join(job.labels.read(), ["o_custkey", "as_of_date"])
    return both.groupBy(F.col("as_of_date").cast("string").alias("as_of_date")).agg(F.count("*").alias("n"), F.sum("orders_365d").alias("orders"), F.sum("churned").alias("churned"))


@query
def feature_job_scoring(spark, sf_dir):
    """Scoring mode after it: features of the newest day, beside those of the training dates."""
    job, paid = _feature_job(spark, sf_dir)
    job.score((paid, "paid_date"))
    newest = job.features.read().agg(F.max("as_of_date").alias("as_of_date"))  # one row
    return job.features.read().join(F.broadcast(newest), "as_of_date").select("o_custkey", F.col("as_of_date").cast("string").alias("as_of_date"), "recency_days", "orders_365d", "refunds_365d")


@query
def crm_bookmarks(spark, sf_dir):
    """Three exports of a table with two versions: all rows, what changed, nothing."""
    work = working_dir(spark, "bookmarks")
    before, after = _two_snapshots(spark, sf_dir)
    t = VersionedTable(spark, work, "orders", before.schema)
    marks = VersionedTable(spark, work, "bookmarks", spark.createDataFrame([], "export_name string, table_name string, last_version long, updated_at timestamp").schema)
    counts = []
    for frame in (before, after, None):
        if frame is not None:
            t.overwrite(frame)
        counts.append(bookmarked_export(t, marks, "crm", ["o_orderkey"], F.col("price") > 1000, f"{work}/out"))
    return spark.createDataFrame(list(enumerate(counts)), "run int, exported long")


from tidemark.plans import operations, streams  # noqa: E402  their queries use the rules and tables above

QUERIES |= streams.QUERIES | operations.QUERIES
