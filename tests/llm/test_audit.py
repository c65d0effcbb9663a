"""The filter audit against every order applied to every document in turn."""

import random
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

from tidemark.llm import filter_audit

ASCII_SPACE = " \t\n\r\x0b\x0c"


def words_of(text):
    for c in ASCII_SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def failing(rows):
    """The letters of the filters that each (doc_id, text, ...) fails."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = words_of(text)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        smaller = any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)
        out.append(fails + "E" * smaller)
    return out


def brute_force(rows, labels):
    fails, parts = failing(rows), [r[2] or "" for r in rows]
    good, toxic = ({i for i, *values in labels if i is not None and values[k] == 1} for k in (0, 1))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in set(parts):
            left = [k for k, p in enumerate(parts) if p == part]
            own = [*left]
            for step, letter in enumerate(order, 1):
                gone = [k for k in left if letter in fails[k]]
                left = [k for k in left if letter not in fails[k]]
                shapley[part, letter] += len(gone)
                redundant = sum(letter in fails[k] for k in own) - len(gone)
                out[part, order, step] = (len(left), len(gone), redundant, sum(fails[k] == letter for k in own), *(sum(rows[k][0] in ids for k in gone) for ids in (good, toxic)))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = filter_audit.op13(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def make(spark, rows):
    """Documents of (doc_id, text, lang), with columns whose names clash with those that the operator adds."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("part", "mask", "n", "id", "words", "digest", "good", "toxic", "first", "rank")}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(extra)


def test_equals_every_order_in_turn(spark, labels):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["LOUD", "x#1", "é", "ÄÖ", "a b"]
    texts = [None, "", "  \n", "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, " ".join(f"v{i}" for i in range(99)), " ".join(f"v{i}" for i in range(100)), " ".join(f"v{i % 80}" for i in range(100)), " ".join(f"v{i % 79}" for i in range(100))]
    texts += [rnd.choice(ASCII_SPACE).join(rnd.choices(vocabulary, k=rnd.choice((5, 90, 130, 300)))) for _ in range(20)]
    rows = [(None if rnd.random() < 0.05 else rnd.randint(-20, 70), rnd.choice(texts), rnd.choice(["en", "de", "", None])) for _ in range(150)]
    rows += [(3, "twice", "en"), (3, "twice", "en"), (4, "twice", "xx"), (None, "twice", "yy"), (1, "é" * 1000, "zz")]
    told = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(-20, 70, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    assert audited(make(spark, rows), labels(told)) == brute_force(rows, told)


def test_large_group_of_copies_and_very_long_text(spark, labels):
    rows = [(i, "same text", "en") for i in range(2000)] + [(5000, "long " * 200_000, "en")]
    told = [(0, 1, 0), (1, 1, 1)]
    assert audited(make(spark, rows), labels(told)) == brute_force_of_groups(rows, told)


def brute_force_of_groups(rows, told):
    """As ``brute_force``, for one part, with the rows that fail alike taken together."""
    kinds = defaultdict(list)
    first = {}
    for i, t, _ in sorted(rows):
        base = failing([(i, t)])[0]
        kinds[base + ("E" if t in first else "")].append(i)
        first.setdefault(t, i)
    good, toxic = ({i for i, *v in told if v[k] == 1} for k in (0, 1))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        left = dict(kinds)
        for step, letter in enumerate(order, 1):
            gone = [i for f, ids in left.items() if letter in f for i in ids]
            left = {f: ids for f, ids in left.items() if letter not in f}
            shapley[letter] += len(gone)
            fails = sum(len(ids) for f, ids in kinds.items() if letter in f)
            out["en", order, step] = (sum(map(len, left.values())), len(gone), fails - len(gone), len(kinds.get(letter, [])), len(good & {*gone}), len(toxic & {*gone}))
    return {k: (*v, shapley[k[1][k[2] - 1]]) for k, v in out.items()}


def test_intervals_are_the_orders_of_each_removal():
    for size in (1, 2, 3, 4, 5):
        letters = "ABCDE"[:size]
        names = filter_audit.orders(letters)
        assert len(names) == factorial(size) and names == sorted(names)
        found = {(m, s, r) for m, s, low, high in filter_audit.removal_intervals(size) for r in range(low, high)}
        want = set()
        for rank, order in enumerate(names):
            for mask in range(1, 1 << size):
                want.add((mask, next(k for k, c in enumerate(order, 1) if mask >> letters.index(c) & 1), rank))
        assert found == want
    every = filter_audit.removal_intervals(5)
    assert all(a[3] < b[2] for a, b in zip(every, every[1:], strict=False) if a[:2] == b[:2])  # as few as can be


def test_other_numbers_of_filters(spark):
    import pytest

    counts = spark.createDataFrame([("p", 0b01, 3, 1, 0), ("p", 0b11, 5, 0, 2), ("p", 0, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(counts, "XY").collect()}
    assert rows == {("XY", 1): (1, 8, 0, 3, 1, 2, 11), ("XY", 2): (1, 0, 5, 0, 0, 0, 5), ("YX", 1): (4, 5, 0, 0, 0, 2, 5), ("YX", 2): (1, 3, 5, 3, 1, 0, 11)}
    with pytest.raises(ValueError, match="letters"):
        filter_audit.audit(counts, "AA")


def test_empty_tables(spark, labels):
    assert audited(make(spark, []), labels([])) == {}
    assert len(audited(make(spark, [(1, "a", None)]), labels([]))) == 600
