"""Rows along time within a key, where one key may hold much of the table: keys are split into ranges of time, and what a range
needs from those before it is carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Into how many ranges of time a key is split at most.
RANGES = 8


def as_number(at: Column, kind: str) -> Column:
    return F.unix_micros(at.cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(at) if kind == "date" else at


def bounds_of(df: DataFrame, at: str, ranges: int) -> list:
    """Values of ``at`` that part the rows into about equal ranges, ascending: fewer than ``ranges`` of them."""
    if ranges <= 1:
        return []
    found = df.agg(F.percentile_approx(as_number(F.col(at), dict(df.dtypes)[at]), [i / ranges for i in range(1, ranges)], 1000).alias("b")).first()["b"]  # one row of fixed size
    return sorted(set(found or []))


def range_of(at: Column, kind: str, bounds: Sequence) -> Column:
    """The number of the range that a value lies in; 0 for NULL."""
    number = as_number(at, kind)
    return sum((F.coalesce((number >= F.lit(b)).cast("int"), F.lit(0)) for b in bounds), F.lit(0))


def as_of(facts: DataFrame, versions: DataFrame, key: str, moment: str, columns: Sequence[str], valid_from: str = "valid_from", valid_to: str = "valid_to", ranges: int = RANGES, moments: DataFrame | None = None) -> DataFrame:
    """``facts`` with ``columns`` of the version of their key that holds ``moment``, NULL where none does; a key's versions do not overlap.

    Facts and versions are put on one line and swept once: a fact takes the last version that began by its moment, if that has
    not ended. The line is split by key and range of time, and a version stands in every range that it reaches into, so a key
    with many facts is worked on by as many tasks as there are ranges, and no fact meets more than one version. The ranges are cut
    by ``moments``, a table with that column which is cheaper to read than ``facts``, where given; they never change the result.
    """
    kinds = dict(facts.dtypes)
    bounds = bounds_of(facts if moments is None else moments, moment, ranges)
    place = lambda c: range_of(c, kinds[moment], bounds)
    when = kinds[moment]
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*facts.columns), F.lit(max(ranges, 1))).cast("int")).otherwise(place(F.col(moment)))  # no version has no key
    begun, over = F.col(valid_from).cast(when), F.col(valid_to).cast(when)
    version = F.struct(over.alias("_over"), *(F.col(c) for c in columns))
    last_range = F.when(over.isNull(), F.lit(len(bounds))).otherwise(place(over))
    reached = versions.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).select(F.col(key).alias("_k"), begun.alias("_at"), version.alias("_v"), F.explode(F.sequence(place(begun), F.greatest(last_range, place(begun)))).alias("_r"))
    given = facts.select(F.col(key).alias("_k"), F.col(moment).alias("_at"), F.struct(*facts.columns).alias("_f"), spread.alias("_r"))
    line = reached.unionByName(given, allowMissingColumns=True)
    along = Window.partitionBy("_k", "_r").orderBy("_at", F.col("_f").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = line.withColumn("_held", F.last("_v", ignorenulls=True).over(along)).where("_f is not null")
    holds = F.col("_at").isNotNull() & F.col("_k").isNotNull() & (F.col("_held._over").isNull() | (F.col("_held._over") > F.col("_at")))
    return swept.select("_f.*", *(F.when(holds, F.col(f"_held.{c}")).alias(c) for c in columns))


def neighbours(rows: DataFrame, keys: Sequence[str], at: str, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, bounds: Sequence = ()) -> DataFrame:
    """``rows`` with values of the row before and the row after each in its key by ``at``, which is unique in a key.

    With ``bounds`` a key is split into ranges: within one the rows next to each other are looked at, and the last row before a
    range and the first one after it come from a table of the ranges' ends, a row a key and range.
    """
    keys, before, after = list(keys), before or {}, after or {}
    if not bounds:
        along = Window.partitionBy(*keys).orderBy(at)
        return rows.withColumns({n: F.lag(c).over(along) for n, c in before.items()} | {n: F.lead(c).over(along) for n, c in after.items()})
    dealt = rows.withColumn("_r", range_of(F.col(at), dict(rows.dtypes)[at], bounds))
    within, over = Window.partitionBy(*keys, "_r").orderBy(at), Window.partitionBy(*keys).orderBy("_r")
    ends = dealt.groupBy(*keys, "_r").agg(
        *(F.max_by(F.struct(c.alias("v")), at).alias(f"_last_{n}") for n, c in before.items()), *(F.min_by(F.struct(c.alias("v")), at).alias(f"_first_{n}") for n, c in after.items())
    )
    carried = ends.select(*keys, "_r", *(F.lag(f"_last_{n}").over(over).alias(f"_last_{n}") for n in before), *(F.lead(f"_first_{n}").over(over).alias(f"_first_{n}") for n in after))
    # a struct tells a row whose value is NULL from no row
    near = dealt.withColumns({f"_b_{n}": F.lag(F.struct(c.alias("v"))).over(within) for n, c in before.items()} | {f"_a_{n}": F.lead(F.struct(c.alias("v"))).over(within) for n, c in after.items()})
    same = [near[k].eqNullSafe(carried[k]) for k in [*keys, "_r"]]
    told = near.join(carried.select(*(F.col(c) for c in carried.columns)), same, "left").select(*(near[c] for c in near.columns), *(carried[c] for c in carried.columns if c not in [*keys, "_r"]))
    values = {n: F.coalesce(f"_b_{n}", f"_last_{n}")["v"] for n in before} | {n: F.coalesce(f"_a_{n}", f"_first_{n}")["v"] for n in after}
    return told.select(*rows.columns, *(v.alias(n) for n, v in values.items()))
