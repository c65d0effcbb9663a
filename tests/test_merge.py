"""Merges against small models in plain Python, on random batches."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.operators.contracts import Contract
from tidemark.sources.tables import VersionedTable

EVENT = "key long, seq long, kind string, plan string, seats long"


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("at", F.timestamp_seconds(F.col("seq") * 60))


def model(batches, suppress):
    """What the history should be: for each key a list of [plan, seats, start, end]."""
    versions, seen = {}, {}
    for batch in batches:
        for key in {e[0] for e in batch}:
            own, last = versions.setdefault(key, []), seen.get(key, -1)
            for _, seq, kind, plan, seats in sorted({e[1]: e for e in batch if e[0] == key and e[1] > last}.values(), key=lambda e: e[1]):
                current = own[-1] if own and own[-1][3] is None else None
                if kind == "gone":
                    if current:
                        current[3] = seq
                elif not (suppress and current and current[:2] == [plan, seats]):
                    if current:
                        current[3] = seq
                    own.append([plan, seats, seq, None])
            seen[key] = max([last, *(x for v in own for x in v[2:] if x is not None)])
    return sorted(((k, *v) for k, own in versions.items() for v in own), key=str)


def rows_of(state):
    return sorted(((r.key, r.plan, r.seats, r._start_seq, r._end_seq) for r in state.collect()), key=str)


@pytest.mark.parametrize("suppress", [True, False])
def test_history_equals_the_model(spark, suppress):
    rnd = random.Random(suppress)
    for _ in range(3):
        batches = []
        for _ in range(3):
            taken = rnd.sample(range(40), 14)  # late events and ones that were there before
            batches.append([(rnd.randrange(4), s, rnd.choice(["set", "set", "set", "gone"]), rnd.choice("xy"), rnd.choice([1, None])) for s in taken])
        state = merge.empty_history(spark, {"key": "long"}, {"plan": "string", "seats": "long"})
        for batch in batches:
            state = merge.merge_history(state, frame(spark, batch), ["key"], ["plan", "seats"], "seq", "at", F.col("kind") == "gone", suppress_unchanged=suppress)
        assert rows_of(state) == model(batches, suppress)


def test_history_of_whole_and_parts_and_again(spark):
    rnd = random.Random(7)
    events = [(rnd.randrange(5), s, rnd.choice(["set", "gone", "set"]), rnd.choice("xyz"), 1) for s in range(30)]
    run = lambda batches, table=None: [merge_into(spark, b) for b in batches]  # noqa: E731, ARG005

    def merge_into(spark, batch):
        nonlocal state
        state = merge.merge_history(state, frame(spark, batch), ["key"], ["plan", "seats"], "seq", "at", F.col("kind") == "gone")

    results = []
    for batches in ([events], [events[:11], events[11:20], events[20:]], [events, events, events[5:9]]):
        state = merge.empty_history(spark, {"key": "long"}, {"plan": "string", "seats": "long"})
        run(batches)
        results.append((rows_of(state), sorted(r._sk for r in state.collect())))
    assert results[0] == results[1] == results[2] and len(set(results[0][1])) == len(results[0][1])
    open_versions = state.where("is_current")
    assert open_versions.groupBy("key").count().where("count > 1").count() == 0 and open_versions.where("valid_to is not null").count() == 0


def test_history_with_no_events_and_unknown_deletes(spark):
    state = merge.empty_history(spark, {"key": "long"}, {"plan": "string", "seats": "long"})
    for batch in ([], [(1, 5, "gone", None, None)]):
        assert merge.merge_history(state, frame(spark, batch), ["key"], ["plan", "seats"], "seq", "at", F.col("kind") == "gone").count() == 0


def test_history_in_buckets_writes_the_touched_ones(spark, tmp_path):
    empty = merge.empty_history(spark, {"key": "long"}, {"plan": "string", "seats": "long"})
    table = VersionedTable(spark, str(tmp_path), "h", empty.schema, buckets=(["key"], 8))
    function = lambda state, batch: merge.merge_history(state, batch, ["key"], ["plan", "seats"], "seq", "at", F.col("kind") == "gone")
    first, second = [(k, 1, "set", "x", k) for k in range(40)], [(3, 2, "set", "y", 3), (3, 3, "gone", None, None)]
    table.merge(frame(spark, first), function)
    table.merge(frame(spark, second), function)
    assert rows_of(table.read()) == model([first, second], True) and rows_of(table.read(0)) == model([first], True)
    assert len(list((tmp_path / "h/data/_v=0").glob("_part=*"))) > 1 and len(list((tmp_path / "h/data/_v=1").glob("_part=*"))) == 1


def test_upsert_does_not_depend_on_order(spark):
    """State rows as a model keeps them: the newest row's columns, first and last marks of all rows."""
    schema = "id long, name string, seq long, born long, seen long"
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), rnd.choice("abc"), s, rnd.choice([None, s]), rnd.choice([None, s])) for s in rnd.sample(range(100), 12)]
    want = []
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        newest = max(own, key=lambda r: r[2])
        want.append((key, newest[1], newest[2], min((r[3] for r in own if r[3] is not None), default=None), max((r[4] for r in own if r[4] is not None), default=None)))
    for seed in range(2):
        rnd.shuffle(rows)
        state, rest = spark.createDataFrame([], schema), list(rows)
        while rest:
            batch, left = [], []
            for r in rest:  # a batch has one row a key
                (left if any(b[0] == r[0] for b in batch) else batch).append(r)
            state = merge.upsert_latest(state, spark.createDataFrame(batch, schema), ["id"], "seq", ["born"], ["seen"])
            rest = left
        assert sorted(map(tuple, state.collect()), key=str) == sorted(want, key=str)


def test_upsert_tie_keeps_state(spark):
    schema = "id string, status string, seq long"
    held, late = (spark.createDataFrame([("q", s, 4)], schema) for s in ("first", "second"))
    assert [r.status for r in merge.upsert_latest(held, late, ["id"], "seq").collect()] == ["first"]


def test_insert_new(spark):
    schema = "id long, day int"
    target, source = [(k, k % 5) for k in range(20)], [(k, k % 5) for k in range(10, 30)] * 2
    for date in ("day", None):
        new = merge.insert_new(spark.createDataFrame(target, schema), spark.createDataFrame(source, schema), ["id"], date)
        assert sorted(r.id for r in new.collect()) == list(range(20, 30))
    assert merge.insert_new(spark.createDataFrame(target, schema), spark.createDataFrame([], schema), ["id"], "day").count() == 0


def test_snapshot_diff(spark):
    rnd = random.Random(5)
    before, after = ({k: rnd.choice([None, "p", "q"]) for k in rnd.sample(range(12), 8)} for _ in range(2))
    frames = [spark.createDataFrame(list(d.items()), "k long, v string") for d in (before, after)]
    want = [(k, before[k], "delete") for k in before.keys() - after.keys()] + [(k, after[k], "insert") for k in after.keys() - before.keys()]
    want += [(k, d[k], f"update_{side}image") for k in before.keys() & after.keys() if before[k] != after[k] for d, side in ((before, "pre"), (after, "post"))]
    assert sorted(map(tuple, merge.snapshot_diff(*frames, ["k"]).collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, merge.snapshot_diff(*frames, ["k"], images=False).collect()), key=str) == sorted((w for w in want if w[2] != "update_preimage"), key=str)


def test_latest_per_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(4), rnd.randrange(50), f"n{i}") for i in range(40)]
    got = merge.latest_per_key(spark.createDataFrame(rows, "k long, n long, t string"), ["k"], [-F.col("n"), F.col("t")])
    want = {k: min((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])) for k, _, _ in rows}
    assert {r.k: tuple(r) for r in got.collect()} == want and got.columns == ["k", "n", "t"]
    assert merge.deduplicate(got.unionByName(got), ["k"]).count() == len(want)


def test_change_feed_history(spark):
    """Every event that is no delete makes a version, equal ones too."""
    batch = [(1, s, "gone" if s in (4, 9) else "set", "x", None) for s in (2, 3, 4, 6, 9)] + [(2, 1, "set", "x", None)]
    state = spark.createDataFrame([], "key long, plan string, seats long, `__START_AT` long, `__END_AT` long")
    for part in (batch[:2], batch[2:]):
        state = merge.auto_cdc(state, spark.createDataFrame(part, EVENT), ["key"], "seq", F.col("kind") == "gone")
    assert sorted(((r.key, r["__START_AT"], r["__END_AT"]) for r in state.collect()), key=str) == [(1, 2, 3), (1, 3, 4), (1, 6, 9), (2, 1, None)]


def test_contract_errors():
    with pytest.raises(ValueError):
        Contract("t", {"a": "int"}, ("b",))
