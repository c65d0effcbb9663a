"""Point-in-time features and labels that never look ahead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import date_list, ratio
from tidemark.operators.contracts import conform
from tidemark.operators.timeline import as_of
from tidemark.plans.tables import CONTRACTS
from tidemark.sources.tables import VersionedTable, kept

YEAR, HORIZON, STEP, FIRST = 365, 60, 14, 90


def training_dates(bounds: DataFrame, first: str, last: str, warm_up: int = FIRST, horizon: int = HORIZON, step: int = STEP) -> DataFrame:
    """(as_of_date): first + warm_up, then every ``step`` days while the label window ends by the last day."""
    start, end = F.date_add(F.col(first), warm_up), F.date_sub(F.col(last), horizon)
    return bounds.where(start <= end).select(F.explode(F.sequence(start, end, F.expr(f"interval {step} days"))).alias("as_of_date"))


def spells(days: DataFrame, keys: list[str], day: str, length: int) -> DataFrame:
    """(keys..., begin, end): the longest spells in which every day has one of ``days`` in the ``length`` days up to it.

    A day keeps its key going until ``length`` days later; where the next one comes by then, the spell goes on.
    """
    once = days.select(*keys, day).distinct()
    along = Window.partitionBy(*keys).orderBy(day)
    told = once.withColumns({"_before": F.lag(day).over(along), "_after": F.lead(day).over(along)})
    starts, ends = F.coalesce(F.date_diff(day, "_before") > length, F.lit(True)), F.coalesce(F.date_diff("_after", day) > length, F.lit(True))
    edges = told.where(starts | ends).withColumn("_end", F.when(ends, F.date_add(day, length)))
    # a spell's first day is an edge, and the next edge with an end, that day perhaps, closes it
    closing = F.min("_end").over(Window.partitionBy(*keys).orderBy(day).rowsBetween(0, 1))
    return edges.withColumns({"begin": F.when(starts, F.col(day)), "end": closing}).where("begin is not null").select(*keys, "begin", "end")


def on_dates(days: DataFrame, key: str, day: str, dates: DataFrame, within: int) -> DataFrame:
    """(key, as_of_date): once for every as-of date to which any day of the key is trailing.

    Days become spells, which do not overlap, and each spell takes its dates from a list of all, one row.
    """
    every = dates.agg(F.array_sort(F.collect_set("as_of_date")).alias("_dates"))  # one row
    own = F.filter("_dates", lambda d: (d >= F.col("begin")) & (d < F.col("end")))
    return spells(days, [key], day, within).join(F.broadcast(every)).select(key, F.explode(own).alias("as_of_date"))


def population(dates: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers with a paid order in the year before, and the version in effect at midnight after the date."""
    paid = orders.where("paid_at IS NOT NULL").select("customer_id", F.to_date("paid_at").alias("paid_date"))
    active = on_dates(paid, "customer_id", "paid_date", dates, YEAR)
    moment = F.date_add("as_of_date", 1).cast("timestamp")
    at_midnight = active.withColumn("_moment", moment)
    known = customers.withColumn("_is_known", F.lit(True))
    told = as_of(at_midnight, known, "customer_id", "_moment", ["loyalty_tier", "marketing_opt_in", "country", "signup_date", "_is_known"], moments=dates.select(moment.alias("_moment")))
    return told.where("_is_known").drop("_moment", "_is_known")


def changes_of(rows: DataFrame, key: str, day: Column, totals: dict[str, tuple[Column, int]], since: Column | None = None, latest: dict[str, Column] | None = None) -> DataFrame:
    """Changes of trailing totals: (_k, at, totals..., latest...), some rows for each row.

    ``totals`` has a value and a number of days for each name: the value comes in on its day, or when it is known (``since``), and
    goes out that many days after its day. So a total on a date is the sum of all changes up to it, whatever the date.
    """
    known, latest = day if since is None else since, latest or {}
    in_time = lambda n: known < F.date_add(day, n)
    row = lambda at, values, last: F.struct(at.alias("at"), *(v.alias(n) for n, v in values.items()), *((c if last else F.lit(None).cast("date")).alias(n) for n, c in latest.items()))
    changes = [row(known, {c: F.when(in_time(n), v).otherwise(0 * v) for c, (v, n) in totals.items()}, True)]
    for length in sorted({n for _, n in totals.values()}):
        changes.append(row(F.date_add(day, length), {c: F.when(in_time(n) & F.lit(n == length), -v).otherwise(0 * v) for c, (v, n) in totals.items()}, False))
    return rows.select(F.col(key).alias("_k"), F.explode(F.array(*changes)).alias("e")).select("_k", "e.*")


def entries(rows: DataFrame, key: str, day: Column, totals: dict[str, tuple[Column, int]], since: Column | None = None, latest: dict[str, Column] | None = None) -> DataFrame:
    """What ``changes_of`` gives, added up: a row a key and day on which any total changes."""
    flat = changes_of(rows, key, day, totals, since, latest)
    return flat.groupBy("_k", "at").agg(*(F.sum(c).alias(c) for c in totals), *(F.max(c).alias(c) for c in latest or {}))


def at_dates(who: DataFrame, changes: DataFrame, key: str, totals: list[str], latest: list[str] | None = None) -> DataFrame:
    """(key, as_of_date, totals..., latest...) of every row of ``who``: one sweep along each key's days, which dates are put among.

    The rows that are shuffled are the days and the result's own rows: a date more adds no join.
    """
    latest = latest or []
    none = [F.lit(None).cast(kind).alias(c) for c, kind in changes.dtypes if c not in ("_k", "at")]
    marks = who.select(F.col(key).alias("_k"), F.col("as_of_date").alias("at")).distinct().select("_k", "at", *none, F.lit(True).alias("_asks"))
    along = Window.partitionBy("_k").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    told = changes.withColumn("_asks", F.lit(False)).unionByName(marks)
    told = told.select("_k", "at", "_asks", *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in totals), *(F.max(c).over(along).alias(c) for c in latest))
    return told.where("_asks").select(F.col("_k").alias(key), F.col("at").alias("as_of_date"), *totals, *latest)


def _slots(days: list[date]) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Places of days and dates of places, for sorted as-of dates: a day's place is that of the first date that is not before it.

    A place is NULL after the last date. Both are looked up in lists, as long as the dates' span and as the dates are many.
    """
    places = [i for i, d in enumerate(days) for _ in range((d - days[i - 1]).days if i else 1)]
    found = F.expr(f"cast(array({','.join(map(str, places))}) as array<int>)")
    dates = F.expr(f"cast(array({','.join(f"date'{d}'" for d in days)}) as array<date>)")
    first = F.lit(days[0] if days else date(1970, 1, 1))
    return lambda day: F.when(day.isNotNull(), F.get(found, F.date_diff(F.greatest(day, first), first))), lambda place: F.get(dates, place)


def swept(changes: list[DataFrame], days: list[date], totals: list[str], latest: list[str], where: Column, versions: DataFrame | None = None) -> DataFrame:
    """(_k, as_of_date, totals..., latest..., _v) of every key and as-of date on which ``where`` holds: one sweep for all totals.

    Changes are put at the first as-of date that sees them and added up there, so that a key has a row for each date on which
    something has changed. What holds from one such row to the next is worked out once and then written out for the dates between:
    the rows of the result are neither shuffled nor sorted, and a total more makes no pass of its own. ``versions`` has (_k, begin,
    end, _v), days from and until which a value holds, that do not overlap; with it a key has rows only where one holds.
    """
    place, day_of = _slots(days)
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes).where("_k is not null").withColumn("_at", place(F.col("at"))).where("_at is not null")
    rows = every.groupBy("_k", "_at").agg(*(F.sum(c).alias(c) for c in totals), *(F.max(c).alias(c) for c in latest))
    last = F.lit(len(days))
    if versions is not None:
        held = versions.where("_k is not null").select("_k", place(F.col("begin")).alias("_at"), F.coalesce(place(F.col("end")), last).alias("_until"), "_v").where("_at < _until")
        rows = rows.unionByName(held.select("_k", "_at", F.struct("_until", "_v").alias("_held")), allowMissingColumns=True)
    along = Window.partitionBy("_k").orderBy("_at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)  # of rows at one place the last one has seen all
    told = rows.select(
        "_k", "_at", F.coalesce(F.lead("_at").over(along), last).alias("_next"), *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in totals), *(F.max(c).over(so_far).alias(c) for c in latest),
        *([F.last("_held", ignorenulls=True).over(so_far).alias("_held")] if versions is not None else []),
    )
    if versions is not None:
        told = told.withColumns({"_next": F.least("_next", "_held._until"), "_v": F.col("_held._v")}).where("_held is not null")
    out = told.where(where & (F.col("_at") < F.col("_next"))).withColumn("_place", F.explode(F.sequence("_at", F.col("_next") - 1)))
    return out.select("_k", day_of(F.col("_place")).alias("as_of_date"), *totals, *latest, *(["_v"] if versions is not None else []))


def days_of(dates: DataFrame) -> list[date]:
    return sorted(r[0] for r in dates.select("as_of_date").where("as_of_date is not null").distinct().collect())  # a row an as-of date


def _cents(amount: str) -> Column:
    """Money with two decimals as a whole number, which adds up faster than decimals do."""
    return (F.col(amount).cast("decimal(18,2)") * 100).cast("long")


def _money(cents: str) -> Column:
    return (F.col(cents).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)")


def _order_changes(orders: DataFrame, key: str, money: Column, made: Callable = changes_of) -> tuple[DataFrame, list[str]]:
    own, one = orders.where("paid_date is not null"), F.lit(1).cast("long")
    sold = {f"orders_{n}d": (one, n) for n in (30, 90, YEAR)} | {f"revenue_{n}d": (money, n) for n in (90, YEAR)}
    paid = made(own, key, F.col("paid_date"), sold, latest={"_last": F.col("paid_date")})
    back = made(own.where("refunded_date is not null"), key, F.col("refunded_date"), {"refunds_365d": (one, YEAR)}, since=F.greatest("refunded_date", "paid_date"))
    return paid.unionByName(back, allowMissingColumns=True), [*sold, "refunds_365d"]


def _order_columns(names: list[str], money: Callable[[str], Column] = F.col) -> list[Column]:
    return [F.date_diff("as_of_date", "_last").alias("recency_days"), *((money(c).cast("decimal(12,2)") if c.startswith("revenue") else F.col(c).cast("int")).alias(c) for c in names)]


def order_features(who: DataFrame, orders: DataFrame, key: str = "customer_id", order: str = "order_id", amount: str = "order_amount") -> DataFrame:
    """Recency, counts, revenue and refunds. ``orders`` has (key, order, paid_date, refunded_date, amount), a row an order.

    A refund counts from its day on, once the order has been paid. Recency looks back without a limit.
    """
    changes, names = _order_changes(orders, key, F.col(amount).cast("decimal(18,2)"), entries)
    return at_dates(who, changes, key, names, ["_last"]).select(key, "as_of_date", *_order_columns(names))


def _line_changes(lines: DataFrame, key: str, genre: str, gross: Column, made: Callable = changes_of) -> tuple[DataFrame, list[str]]:
    own = lines.where(F.col("paid_date").isNotNull())
    sums = made(own, key, F.col("paid_date"), {"_gross": (gross, YEAR), "_tickets": (F.col("quantity").cast("long"), YEAR), "_lines": (F.lit(1).cast("long"), YEAR)})
    liked = spells(own.where(F.col(genre).isNotNull()), [key, genre], "paid_date", YEAR)
    ends = F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("genres_365d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("genres_365d")))
    genres = liked.select(F.col(key).alias("_k"), F.explode(ends).alias("e")).select("_k", "e.*")
    if made is entries:
        genres = genres.groupBy("_k", "at").agg(F.sum("genres_365d").alias("genres_365d"))
    return sums.unionByName(genres, allowMissingColumns=True), ["_gross", "_tickets", "_lines", "genres_365d"]


def _line_columns(gross: Column) -> list[Column]:
    return [ratio(gross.cast("double"), F.col("_tickets").cast("double")).alias("avg_ticket_price_365d"), F.col("genres_365d").cast("int").alias("genres_365d")]


def line_features(who: DataFrame, lines: DataFrame, key: str = "customer_id", genre: str = "genre") -> DataFrame:
    """Average ticket price and number of genres over a year; who bought no line has no row.

    A genre counts for as long as its last line is not a year old: its spells come in and go out as ones.
    """
    changes, names = _line_changes(lines, key, genre, F.col("gross_amount"), entries)
    return at_dates(who, changes, key, names).where("_lines > 0").select(key, "as_of_date", *_line_columns(F.col("_gross")))


def _click_changes(clicks: DataFrame, key: str, kind: str, cart: str, made: Callable = changes_of) -> tuple[DataFrame, list[str]]:
    one = F.lit(1).cast("long")
    totals = {"events_7d": (one, 7), "events_30d": (one, 30), "cart_adds_30d": ((F.col(kind).eqNullSafe(F.lit(cart))).cast("long"), 30)}
    return made(clicks.where(F.col(key).isNotNull()), key, F.col("event_date"), totals), [*totals]


def _click_columns(names: list[str]) -> list[Column]:
    return [*(F.col(c).cast("int").alias(c) for c in names), ratio(F.col("events_7d").cast("double"), F.col("events_30d").cast("double")).alias("engagement_ratio")]


def engagement_features(who: DataFrame, clicks: DataFrame, key: str = "customer_id", kind: str = "event_type", cart: str = "add_to_cart") -> DataFrame:
    """Clicks of 7 and 30 days, and the share of the week in the month."""
    changes, names = _click_changes(clicks, key, kind, cart, entries)
    return at_dates(who, changes, key, names).select(key, "as_of_date", *_click_columns(names))


def features(dates: DataFrame, orders: DataFrame, sales: DataFrame, events: DataFrame, clicks: DataFrame, customers: DataFrame) -> DataFrame:
    """Every feature of the ``population`` that bought a line in the year before, by one sweep along each customer's changes.

    Who is in the population has an order in its year (``orders_365d``), and the version in effect at midnight after the date: one
    that begins within a day holds from that day on, one that begins at midnight from the day before.
    """
    own = orders.where("paid_at IS NOT NULL").withColumns({"paid_date": F.to_date("paid_at"), "refunded_date": F.to_date("refunded_at")})
    lines = sales.join(events.select("event_id", "genre"), "event_id", "left")
    of_orders, order_names = _order_changes(own, "customer_id", _cents("order_amount"))
    of_lines, line_names = _line_changes(lines, "customer_id", "genre", _cents("gross_amount"))
    of_clicks, click_names = _click_changes(clicks, "customer_id", "event_type", "add_to_cart")
    holds = lambda c: F.when(F.col(c).cast("timestamp") > F.to_date(c).cast("timestamp"), F.to_date(c)).otherwise(F.date_sub(F.to_date(c), 1))
    told = ["loyalty_tier", "marketing_opt_in", "country", "signup_date"]
    versions = customers.where("valid_from is not null").select(F.col("customer_id").alias("_k"), holds("valid_from").alias("begin"), holds("valid_to").alias("end"), F.struct(*told).alias("_v"))
    bought = (F.col("orders_365d") > 0) & (F.col("_lines") > 0)
    rows = swept([of_orders, of_lines, of_clicks], days_of(dates), [*order_names, *line_names, *click_names], ["_last"], bought, versions)
    out = rows.select(F.col("_k").alias("customer_id"), "as_of_date", *_order_columns(order_names, _money), *_line_columns(_money("_gross")), *_click_columns(click_names), "_v.*")
    return conform(out.withColumn("tenure_days", F.date_diff("as_of_date", "signup_date")), CONTRACTS["ml.customer_features"])


def training_rows(dates: DataFrame, orders: DataFrame, last_day: Column, key: str = "customer_id", amount: str = "order_amount", horizon: int = HORIZON) -> DataFrame:
    """(key, as_of_date, order features, churned): ``order_features`` joined with ``labels`` over who has an order in the year before, by one sweep."""
    changes, names = _order_changes(orders, key, _cents(amount))
    days = orders.where("paid_date is not null").select(key, F.date_sub("paid_date", horizon).alias("_saves"))
    saved = changes_of(days, key, F.col("_saves"), {"_n": (F.lit(1).cast("long"), horizon)})
    rows = swept([changes, saved], days_of(dates.where(F.date_add("as_of_date", horizon) <= last_day)), [*names, "_n"], ["_last"], F.col("orders_365d") > 0)
    return rows.select(F.col("_k").alias(key), "as_of_date", *_order_columns(names, _money), (F.col("_n") == 0).cast("int").alias("churned"))


def labels(who: DataFrame, purchases: DataFrame, last_day: Column, key: str = "customer_id", horizon: int = HORIZON) -> DataFrame:
    """(key, as_of_date, churned): 1 without a purchase in the window after the date; only windows that are complete.

    A purchase saves the ``horizon`` dates before its day, so it comes in that many days early and goes out on the day.
    """
    complete = who.select(key, "as_of_date").where(F.date_add("as_of_date", horizon) <= last_day)
    days = purchases.where("paid_date is not null").select(key, F.date_sub("paid_date", horizon).alias("_saves"))
    told = at_dates(complete, entries(days, key, F.col("_saves"), {"_n": (F.lit(1).cast("long"), horizon)}), key, ["_n"])
    return told.select(key, "as_of_date", (F.col("_n") == 0).cast("int").alias("churned"))


def training_set(rows: DataFrame, labelled: DataFrame, on: list[str], test_share: float = 0.2) -> DataFrame:
    """Features with labels; the last dates, ``ceil(n * share)`` and at least one, are the test split."""
    return split_by_time(rows.join(labelled, on), test_share)


def split_by_time(labelled: DataFrame, test_share: float = 0.2) -> DataFrame:
    joined = kept(labelled, "training")
    days = sorted(r[0] for r in joined.select("as_of_date").distinct().collect())  # a row an as-of date
    if len(days) < 2:
        raise ValueError("a split by time needs two as-of dates")
    tests = days[-max(1, ceil(len(days) * test_share)) :]
    return joined.withColumn("split", F.when(F.col("as_of_date").isin(tests), "test").otherwise("train"))


def run_features(table, dates: DataFrame, build) -> int | None:
    """Recompute the features of some as-of dates: their rows are replaced, others stay. Without dates nothing is done."""
    days = [r["as_of_date"] for r in dates.select("as_of_date").distinct().collect()]  # a row an as-of date
    if not days:
        return None
    return table.replace_where(build(dates), date_list("as_of_date", days))


def scoring_dates(*facts: tuple[DataFrame, str]) -> DataFrame:
    """(as_of_date): the newest day of any of the tables, by their day columns; no row if they are all empty."""
    newest = [df.agg(F.max(day).alias("as_of_date")) for df, day in facts]
    return reduce(DataFrame.unionByName, newest).agg(F.max("as_of_date").alias("as_of_date")).where("as_of_date is not null")


@dataclass(frozen=True)
class FeatureJob:
    """The feature job: ``features`` and ``labels`` are tables by as-of date; ``build(dates)`` makes the features of some dates.

    ``score`` writes the features of the newest day. ``train`` writes those of all training dates, and their labels. Either
    replaces the dates that it writes and leaves the others; without history for a training date, ``train`` does nothing.
    """

    features: VersionedTable
    labels: VersionedTable
    build: Callable[[DataFrame], DataFrame]
    key: str = "customer_id"

    def score(self, *facts: tuple[DataFrame, str]) -> int | None:
        return run_features(self.features, scoring_dates(*facts), self.build)

    def train(self, purchases: DataFrame) -> int | None:
        """``purchases`` has the key and ``paid_date``."""
        bounds = purchases.agg(F.min("paid_date").alias("first"), F.max("paid_date").alias("last"))  # one row
        dates = training_dates(bounds, "first", "last")
        version = run_features(self.features, dates, self.build)
        if version is None:
            return None
        last = bounds.first()["last"]
        who = self.features.read().join(F.broadcast(dates), "as_of_date", "left_semi").select(self.key, "as_of_date")
        return run_features(self.labels, dates, lambda _: labels(who, purchases, F.lit(last).cast("date"), self.key))
