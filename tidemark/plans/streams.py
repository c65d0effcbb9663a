"""Stream jobs over the driver's tables, in several batches each, with the SQL of what they have to come to.

Tables are dealt out into landing folders, in an order that each query states; the streams take a folder a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.operators.quality import QUARANTINED
from tidemark.plans import gold, silver, ticketing, ticketing_sql
from tidemark.plans.tables import CONTRACTS
from tidemark.sources import files
from tidemark.sources.seen import SeenKeys
from tidemark.sources.tables import AppendedTable, VersionedTable, working_dir
from tidemark.streaming.chains import Chain, Step
from tidemark.streaming.late import LateRows, corrected
from tidemark.streaming.runs import insert_handler, run_stream, split_handler, windowed_counts
from tidemark.streaming.split import SplitTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL of the queries, by their names.
ORACLES: dict[str, str] = {}


def query(sql: str):
    def registered(function):
        QUERIES[function.__name__], ORACLES[function.__name__] = function, sql
        return function

    return registered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arriving(rows: DataFrame, number: Column, count: int, path: str) -> Iterator[int]:
    """Rows as landing folders, one after the other by ``number`` from 0 on: each folder is there as a whole or not yet.

    A stream that takes what has arrived before the next folder does has a batch a folder, of as many files as tasks wrote.
    """
    spark = rows.sparkSession
    rows.withColumn("_number", number).drop("number").write.partitionBy("_number").parquet(f"{path}-staged")
    place = spark._jvm.org.apache.hadoop.fs.Path
    filesystem = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    filesystem.mkdirs(place(path))
    for k in range(count):
        staged, target = place(f"{path}-staged/_number={k}"), place(f"{path}/{k}")
        if filesystem.exists(staged) and not filesystem.rename(staged, target):
            raise OSError(f"{path}-staged/_number={k} cannot be moved")
        yield k


def stream_of(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """The landing folders as a stream: a batch takes all files that have arrived."""
    return spark.readStream.schema(rows.schema).parquet(f"{path}/*")


def text(moment) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")


BATCHES = 4
_PLACE = f"cast(floor((epoch(ts) - a) * {BATCHES} / (z - a + 1)) as int)"
_BOUNDS = "b as (select epoch(min(ts)) as a, epoch(max(ts)) as z from events)"


def by_time(events: DataFrame) -> tuple[DataFrame, Column]:
    """The events, and the number of the quarter of their time that each is in."""
    bounds = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_first"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_last"))  # one row
    place = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.col("_first")) * BATCHES / (F.col("_last") - F.col("_first") + 1_000_000)).cast("int")
    return events.join(F.broadcast(bounds)), place


_WINDOWS = """select strftime(w, '%Y-%m-%d %H:%M:%S.%f') as window_start, event_type, count(*) as events from (select time_bucket(interval 5 minutes, ts) as w, event_type from events {where}) {closed} group by w, event_type"""


@query(_WINDOWS.format(where="where value >= 10", closed="where w + interval 5 minutes <= (select max(ts) - interval 30 minutes from events where value >= 10)"))
def chain_of_streams(spark, sf_dir):
    """Three streams at once, each on its own trigger: raw text records, typed rows that keep a rule, closed windows."""
    work = working_dir(spark, "chain")
    events, place = by_time(table(spark, sf_dir, "events"))
    lines = events.select(place.alias("number"), F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_type", "value")).alias("value"))
    names = ["event_id", "ts", "event_type", "value"]

    def raw(stream: DataFrame) -> DataFrame:
        return stream.select(F.from_json("value", files.string_schema(names)).alias("r"), files.rescue(F.col("value"), names).alias(files.RESCUED)).select("r.*", files.RESCUED)

    def clean(stream: DataFrame) -> DataFrame:
        typed = stream.select(F.expr("try_cast(ts as timestamp)").alias("ts"), "event_type", F.expr("try_cast(value as double)").alias("value"))
        return typed.where("value >= 10").select("ts", "event_type")

    steps = [Step("chain_raw", raw), Step("chain_clean", clean), Step("chain_windows", lambda s: windowed_counts(s, "ts", "event_type", None))]
    with Chain(spark, f"{work}/steps", stream_of(spark, lines.select("value"), f"{work}/landing"), steps) as chain:
        for _ in arriving(lines, F.col("number"), BATCHES, f"{work}/landing"):
            chain.drain()
    return spark.read.parquet(chain.out("chain_windows")).select(text("window_start").alias("window_start"), "event_type", "events")


LATE_BY = 2
_ARRIVAL = f"""{_BOUNDS}, arrived as (
  select event_id, ts, event_type, least({BATCHES - 1}, {_PLACE} + case when event_id % 10 = 3 then {LATE_BY} else 0 end) as batch from events, b
), newest as (select batch, max(ts) as newest from arrived group by batch), marks as (
  select a.batch, max(n.newest) - interval 30 minutes as mark from (select distinct batch from arrived) a left join newest n on n.batch < a.batch group by a.batch
)"""


@ticketing.once_a_session
def _arrivals(spark, sf_dir) -> LateRows:
    """A tenth of the events arrive two folders later than their time says."""
    work = working_dir(spark, "late")
    events, place = by_time(table(spark, sf_dir, "events"))
    arrival = F.least(F.lit(BATCHES - 1), place + F.when(F.col("event_id") % 10 == 3, LATE_BY).otherwise(0))
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", arrival.alias("number"))
    sides = LateRows(spark, work, "clicks", rows.drop("number").schema, "ts")
    for _ in arriving(rows, F.col("number"), BATCHES, f"{work}/landing"):
        run_stream(stream_of(spark, rows.drop("number"), f"{work}/landing"), "late_rows", f"{work}/checkpoint", handler=sides.handle)
    return sides


@query(f"with {_ARRIVAL} select event_id, coalesce(ts < mark, false) as late from arrived join marks using (batch)")
def late_rows(spark, sf_dir):
    """Every row once, and whether it came behind the watermark of its batch."""
    sides = _arrivals(spark, sf_dir)
    return sides.on_time.read().select("event_id", F.lit(False).alias("late")).unionByName(sides.late.read().select("event_id", F.lit(True).alias("late")))


@query(_WINDOWS.format(where="", closed=""))
def windows_with_late_rows(spark, sf_dir):
    """Windows of the rows on time, with the late ones worked in: as if all had been there from the start."""
    sides = _arrivals(spark, sf_dir)
    windows = sides.on_time.read().groupBy(F.window("ts", "5 minutes")["start"].alias("window_start"), "event_type").agg(F.count("*").alias("events"))
    out = corrected(windows, sides.late.read(), "ts", ["event_type"], "5 minutes")
    return out.select(text("window_start").alias("window_start"), "event_type", "events")


@query(
    """with m as (select l.*, not coalesce(l_discount between 0 and 0.08, false) as r1, not coalesce(l_shipdate >= o_orderdate, false) as r2, not coalesce(l_quantity <= 45, false) as w1 from lineitem l join orders on l_orderkey = o_orderkey)
    select unnest(['known_discount', 'ships_after_order', 'small_quantity', '__quarantined__', 'good', 'rejected']) as rule, unnest([count(*) filter (r1), count(*) filter (r2), count(*) filter (w1), count(*) filter (r1 or r2), count(*) filter (not r1 and not r2), count(*) filter (r1 or r2)]) as n, count(*) as total from m"""
)
def observed_split(spark, sf_dir):
    """Both sinks and the metrics of a stream from one parse of each batch: what was counted, and what was written."""
    from tidemark.plans.queries import LINE_RULES, lines_with_orders

    work = working_dir(spark, "split")
    rows = lines_with_orders(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_shipdate", "o_orderdate")
    sides = SplitTable(spark, work, "lines", rows.schema, LINE_RULES)
    metrics = AppendedTable(spark, work, "metrics", CONTRACTS["ops.quality_metrics"].schema)
    for _ in arriving(rows, F.pmod(F.xxhash64("l_orderkey"), F.lit(3)).cast("int"), 3, f"{work}/landing"):
        run_stream(stream_of(spark, rows, f"{work}/landing"), "observed_split", f"{work}/checkpoint", handler=split_handler(sides, metrics, "lines"))
    counted = metrics.read().groupBy("rule").agg(F.sum("failed_rows").alias("n"), F.sum("total_rows").alias("total"))
    total = counted.where(F.col("rule") == QUARANTINED).select("total")
    written = sides.good().agg(F.count("*").alias("n")).withColumn("rule", F.lit("good")).unionByName(sides.rejected().agg(F.count("*").alias("n")).withColumn("rule", F.lit("rejected")))
    return counted.unionByName(written.join(F.broadcast(total)).select("rule", "n", "total"))


@query("select event_id, user_id, event_type from events")
def stream_seen_keys(spark, sf_dir):
    """Copies within and over batches, kept out by the index of seen keys."""
    work = working_dir(spark, "seen")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    copied = events.withColumn("number", F.explode(F.array((F.col("event_id") % 5).cast("int"), F.when(F.col("event_id") % 7 == 0, 4).otherwise((F.col("event_id") % 5).cast("int")))))
    target = AppendedTable(spark, work, "clicks", events.schema)
    index = SeenKeys(spark, work, "seen", events.select("event_id").schema, parts=16)
    handler = insert_handler(target, lambda b, _: b, ["event_id"], seen=index, fold_every=2)
    for _ in arriving(copied, F.col("number"), 5, f"{work}/landing"):
        run_stream(stream_of(spark, copied.drop("number"), f"{work}/landing"), "stream_seen_keys", f"{work}/checkpoint", handler=handler)
    return target.read()


@query(
    """with c as (select o_orderkey, 'X' as o_orderstatus, round(o_totalprice, 2) as price from orders where o_orderkey % 100 < 3), o as (select o_orderkey, o_orderstatus, round(o_totalprice, 2) as price from orders where o_orderkey % 100 <> 1)
    select c.*, 'insert' as change from c anti join o using (o_orderkey) union all select o.*, 'update_preimage' from o semi join c using (o_orderkey) union all select c.*, 'update_postimage' from c semi join o using (o_orderkey)"""
)
def version_changes(spark, sf_dir):
    """What a merge into a bucketed table changed, from the buckets that it wrote."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    t = VersionedTable(spark, working_dir(spark, "versions"), "orders", o.schema, buckets=(["o_orderkey"], 32))
    t.overwrite(o.where("o_orderkey % 100 <> 1"))
    changes = o.where("o_orderkey % 100 < 3").withColumn("o_orderstatus", F.lit("X"))
    t.merge(changes, lambda state, new: merge.upsert_all(state, new, ["o_orderkey"]))
    return t.diff(0, 1, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "price", F.col("_change_type").alias("change"))


def _job(spark: SparkSession, rows: DataFrame, run: Callable[[silver.Silver, DataFrame, str], object], label: str) -> silver.Silver:
    """A clean job over raw rows that arrive in three folders, by ``number``, a batch each."""
    work = working_dir(spark, label)
    job = silver.Silver(spark, f"{work}/clean")
    for _ in arriving(rows, F.col("number"), 3, f"{work}/landing"):
        run(job, stream_of(spark, rows.drop("number"), f"{work}/landing"), f"{work}/checkpoint")
    return job


@ticketing.once_a_session
def _order_job(spark, sf_dir) -> silver.Silver:
    """The versions of an order lie in different folders, the newest first, and those of every fifth order twice."""
    step = F.when(F.col("status") == "placed", 2).when(F.col("status") == "paid", 1).otherwise(0)
    numbers = F.when(F.col("order_id").cast("long") % 5 == 0, F.array(step, F.lit(2))).otherwise(F.array(step))
    return _job(spark, ticketing.order_versions(spark, sf_dir).withColumn("number", F.explode(numbers)), silver.Silver.run_orders, "orders")


@query(ticketing_sql.ORACLES["clean_orders"])
def orders_by_stream(spark, sf_dir):
    """The stream job of orders in three batches, out of order and with copies, comes to what one run gives."""
    names = ["order_id", "customer_id", "event_id", "order_date", "status", "channel", "currency", "order_amount", "ticket_count", "paid_at", "refunded_at", "updated_at"]
    return ticketing._plain(_order_job(spark, sf_dir).orders.read().select(*names))


@query(ticketing_sql.ORACLES["clean_order_lines"])
def order_lines_by_stream(spark, sf_dir):
    return ticketing._plain(_order_job(spark, sf_dir).lines.read())


@query(ticketing_sql.ORACLES["clean_customers"])
def customers_by_stream(spark, sf_dir):
    """Change events by their number, one of each customer in each batch."""
    rows = ticketing.customer_changes(spark, sf_dir).withColumn("number", (F.col("lsn").cast("long") - 1).cast("int"))
    job = _job(spark, rows, silver.Silver.run_customers, "customers")
    names = ["customer_id", "email", "full_name", "country", "loyalty_tier", "marketing_opt_in", "signup_date", "valid_from", "valid_to", "is_current"]
    return ticketing._plain(gold.dim_customer(job.customers.read()).select(*names))


@query(ticketing_sql.ORACLES["clean_clicks"])
def clicks_by_stream(spark, sf_dir):
    """Clicks in three batches; a seventh of them comes again in the last."""
    number = (F.col("event_id").cast("long") % 3).cast("int")
    again = F.when(F.col("event_id").cast("long") % 7 == 0, F.array(number, F.lit(2))).otherwise(F.array(number))
    job = _job(spark, ticketing.raw_clicks(spark, sf_dir).withColumn("number", F.explode(again)), silver.Silver.run_clicks, "clicks")
    return ticketing._plain(job.clicks.read().select("event_id", "session_id", "customer_id", "event_type", "device", "event_ts", "event_date"))
