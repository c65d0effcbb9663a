"""Merges as pure functions of (state, changes): order-independent upserts, versioned history, insert once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import row_hash
from tidemark.operators.timeline import bounds_of, neighbours

VERSION = ("valid_from", "valid_to", "is_current", "_start_seq", "_end_seq", "_row_hash")


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """Of each key the row with the smallest ``order_by`` expressions (NULL is smallest), which should be total.

    An aggregate, not a window: each task first reduces its own rows of a key to one, so a frequent key costs no more.
    """
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order_by)).alias("_best"))
    return best.select("_best.*")


def deduplicate(df: DataFrame, keys: Sequence[str], prefer: Sequence[Column] | None = None) -> DataFrame:
    """One row a key: any of them, or the first by ``prefer`` where copies can differ."""
    return latest_per_key(df, keys, prefer) if prefer else df.dropDuplicates(list(keys))


def upsert_latest(state: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: str, first_seen: Sequence[str] = (), last_seen: Sequence[str] = ()) -> DataFrame:
    """The new state. ``changes`` has one row a key.

    Plain columns come from the row with the higher sequence, at a tie from the state; the sequence is the greater one;
    ``first_seen`` columns are the least, ``last_seen`` the greatest, both without NULLs. Batches may come in any order,
    and again.
    """
    old, new = state.alias("o"), changes.select(*state.columns).alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    is_new = F.col(f"o.{keys[0]}").isNull()
    newer = is_new | (F.col(f"n.{sequence}") > F.col(f"o.{sequence}")) | (F.col(f"o.{sequence}").isNull() & F.col(f"n.{sequence}").isNotNull())
    take_new = F.coalesce(newer & F.col(f"n.{keys[0]}").isNotNull(), F.lit(False))

    def merged(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            return F.coalesce(o, n).alias(c)
        if c in first_seen:
            return F.least(o, n).alias(c)
        if c == sequence or c in last_seen:
            return F.greatest(o, n).alias(c)
        return F.when(take_new, n).otherwise(o).alias(c)

    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return old.join(new, condition, "full_outer").select(*(merged(c) for c in state.columns))


def _timeline(state: DataFrame, events: DataFrame, keys: list[str], tracked: list[str], sequence: str, changed_at: str, is_delete: Column, surrogate: str) -> DataFrame:
    """(keys..., seq, at, hash, known, sk, row): what is known and what is new about each key, one entry a sequence number.

    An entry sets the key's row, or clears it (``hash`` and ``row`` NULL): a version begins with a setting entry and ends
    with the next entry. What is known comes first where both have the same number.
    """
    row, none = F.struct(*tracked).alias("row"), F.lit(None)
    begun = state.select(*keys, F.col("_start_seq").alias("seq"), F.col("valid_from").alias("at"), F.col("_row_hash").alias("hash"), F.lit(True).alias("known"), F.col(surrogate).alias("sk"), row)
    ended = state.where("_end_seq is not null").select(*keys, F.col("_end_seq").alias("seq"), F.col("valid_to").alias("at"), none.cast("string").alias("hash"), F.lit(True).alias("known"), none.cast("string").alias("sk"), F.when(F.lit(False), row).alias("row"))
    clears = F.coalesce(is_delete, F.lit(False))
    number = F.sha2(F.to_json(F.struct(*keys, F.col(sequence))), 256)
    new = events.select(*keys, F.col(sequence).alias("seq"), F.col(changed_at).alias("at"), F.when(~clears, row_hash(tracked)).alias("hash"), F.lit(False).alias("known"), F.when(~clears, number).alias("sk"), F.when(~clears, F.struct(*tracked)).alias("row"))
    entry = F.struct("at", "hash", "known", "sk", "row")
    # of copies that differ the smaller hash is taken, so the result does not depend on their order
    order = F.struct((~F.col("known")).alias("a"), F.col("hash").isNull().alias("b"), F.col("hash").alias("c"), F.col("at").alias("d"))
    return begun.unionByName(ended).unionByName(new).groupBy(*keys, "seq").agg(F.min_by(entry, order).alias("e")).select(*keys, "seq", "e.*")


def _with(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``more``, a row a key, where keys may have NULL parts."""
    held = more.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(held, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def merge_history(
    state: DataFrame, events: DataFrame, keys: Sequence[str], tracked: Sequence[str], sequence: str, changed_at: str, is_delete: Column, surrogate: str = "_sk", suppress_unchanged: bool = True, ranges: int = 1
) -> DataFrame:
    """The new versions table after a batch of change events in any order.

    A version begins with an event that changes a tracked column (any event, without ``suppress_unchanged``) and ends with
    the next one that does, or with a delete. Events that are not later than what the state has seen of their key are
    ignored, so a replay changes nothing; a delete of an unknown key does nothing. ``state`` has the surrogate key, the
    keys, the tracked columns and those in ``VERSION``.

    ``ranges``: into how many ranges of the sequence a key's timeline is split, so that no task holds a frequent key alone.

    The versions of the keys in the batch are put on one timeline with its events and read off it again; those of other
    keys stay as they are. ``VersionedTable`` with buckets writes only the buckets that hold touched keys.
    """
    keys, tracked = list(keys), list(tracked)
    touched = events.select(*keys).distinct()
    line = _timeline(state.join(touched, keys, "left_semi"), events, keys, tracked, sequence, changed_at, is_delete, surrogate)
    bounds = bounds_of(line, "seq", ranges)
    newest = line.where("known").groupBy(*keys).agg(F.max("seq").alias("seen"))
    line = _with(line, newest, keys).where("known or seen is null or seq > seen")
    line = neighbours(line, keys, "seq", before={"before": F.col("hash")}, bounds=bounds)
    sets = F.lit(True) if not suppress_unchanged else ~F.col("hash").eqNullSafe(F.col("before"))
    line = line.where(F.col("known") | F.when(F.col("hash").isNull(), F.col("before").isNotNull()).otherwise(sets))
    line = neighbours(line, keys, "seq", after={"end": F.struct("at", "seq")}, bounds=bounds)
    names = {surrogate: F.col("sk"), "valid_from": F.col("at"), "valid_to": F.col("end.at"), "is_current": F.col("end").isNull(), "_start_seq": F.col("seq"), "_end_seq": F.col("end.seq"), "_row_hash": F.col("hash")}
    names |= {c: F.col(c) for c in keys} | {c: F.col(f"row.{c}") for c in tracked}
    versions = line.where("hash is not null").select(*(c.alias(n) for n, c in names.items()))
    return state.join(touched, keys, "left_anti").unionByName(versions.select(*(F.col(f.name).cast(f.dataType) for f in state.schema if f.name in names)), allowMissingColumns=True).select(*state.columns)


def empty_history(spark, keys: dict[str, str], tracked: dict[str, str], sequence_type: str = "long", surrogate: str = "_sk") -> DataFrame:
    ddl = [f"`{surrogate}` string", *(f"`{c}` {t}" for c, t in (keys | tracked).items()), "valid_from timestamp", "valid_to timestamp", "is_current boolean", f"_start_seq {sequence_type}", f"_end_seq {sequence_type}", "_row_hash string"]
    return spark.createDataFrame([], ", ".join(ddl))


def auto_cdc(state: DataFrame, events: DataFrame, keys: Sequence[str], sequence: str, is_delete: Column, excluded: Sequence[str] = ()) -> DataFrame:
    """History with ``__START_AT`` and ``__END_AT`` in sequence numbers; every event that is no delete makes a version."""
    tracked = [c for c in state.columns if c not in (*keys, *excluded, "__START_AT", "__END_AT")]
    inner = state.select(F.lit(None).cast("string").alias("_sk"), *keys, *tracked, F.col("__START_AT").alias("valid_from"), F.col("__END_AT").alias("valid_to"), F.col("__END_AT").isNull().alias("is_current"), F.col("__START_AT").alias("_start_seq"), F.col("__END_AT").alias("_end_seq"), row_hash(tracked).alias("_row_hash"))
    merged = merge_history(inner, events.withColumn("_at", F.col(sequence)), keys, tracked, sequence, "_at", is_delete, suppress_unchanged=False)
    return merged.select(*keys, *tracked, F.col("_start_seq").alias("__START_AT"), F.col("_end_seq").alias("__END_AT"))


def insert_new(target: DataFrame, source: DataFrame, keys: Sequence[str], date: str | None = None) -> DataFrame:
    """Rows of ``source`` whose key ``target`` has not: what to append, each key once.

    With ``date`` only the target's rows within the source's range of dates are read; right where copies are exact.
    """
    once = source.dropDuplicates(list(keys))
    if date:
        low, high = source.agg(F.min(date), F.max(date)).first()
        if low is None:
            return once.join(target.select(*keys), list(keys), "left_anti")
        target = target.where(F.col(date).between(low, high))
    return once.join(target.select(*keys), list(keys), "left_anti")


def upsert_all(state: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace those of the same key; others stay or are added."""
    return state.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], images: bool = True) -> DataFrame:
    """Rows that differ between two keyed snapshots, with ``_change_type`` insert, delete, update_preimage or update_postimage."""
    columns = [c for c in after.columns if c not in keys]
    one = before.select(*keys, F.struct(*(F.col(c) for c in columns)).alias("_o"), F.lit(True).alias("_in_o"))
    two = after.select(*keys, F.struct(*(F.col(c) for c in columns)).alias("_n"), F.lit(True).alias("_in_n"))
    joined = one.join(two, list(keys), "full_outer")
    kind = F.when(F.col("_in_o").isNull(), F.array(F.struct(F.lit("insert").alias("t"), F.col("_n").alias("r"))))
    kind = kind.when(F.col("_in_n").isNull(), F.array(F.struct(F.lit("delete").alias("t"), F.col("_o").alias("r"))))
    post = F.struct(F.lit("update_postimage").alias("t"), F.col("_n").alias("r"))
    pre = F.struct(F.lit("update_preimage").alias("t"), F.col("_o").alias("r"))
    kind = kind.when(~F.col("_o").eqNullSafe(F.col("_n")), F.array(pre, post) if images else F.array(post))
    return joined.select(*keys, F.explode(kind).alias("c")).select(*keys, "c.r.*", F.col("c.t").alias("_change_type"))
