"""Near copies in crowded keys: exact links by prefixes, and work that grows with the texts."""

import random

import pytest

from tidemark.llm import near_copies
from tidemark.llm.common import written


def sets_of(text):
    words = text.lower().split()
    return {*zip(*(words[i:] for i in range(5)), strict=False)} or {tuple(words)}


def pages(count, own, rnd, templates=1):
    """Pages of a template of 200 words, each with so many words of its own in one run."""
    frames = [[f"t{t}x{k}" for k in range(200)] for t in range(templates)]
    return [" ".join(frame[:120] + [f"p{rnd.randrange(10**9)}" for _ in range(own)] + frame[120:]) for frame in (frames[i % templates] for i in range(count))]


def as_sets(spark, texts):
    """(fp, root, held) of texts that are all in components of their own."""
    found = [near_copies.shingles(t.encode()) for t in texts]
    rows = {near_copies.class_of(s): bytearray(s.tobytes()) for s in found}
    return written(spark, spark.createDataFrame([(fp, fp, held) for fp, held in rows.items()], "fp long, root long, held binary"), "test-sets")


def met(spark, sets):
    return near_copies.meetings(written(spark, near_copies.prefixes(sets), "test-prefixes"))


@pytest.mark.parametrize("own", [15, 24, 28, 70])
def test_prefixes_lose_no_link(spark, own):
    """Against all pairs, around the similarity at which pages of one template link (24 words of their own: 0.78, 15: 0.84)."""
    rnd = random.Random(own)
    texts = pages(30, own, rnd, 2) + ["a b", "a b c d e", "a b c d e f", "x"]
    for text in pages(10, 200, rnd):  # copies of other lengths
        words = text.split()
        texts += [text, " ".join(words[:-20]), " ".join(words[30:]), " ".join(words[:50] + ["new"] + words[50:]), " ".join(words + words[:40])]
    sets = as_sets(spark, texts)
    links = {(r.a, r.b) for r in near_copies.checked(met(spark, sets), sets).collect()}
    known = {near_copies.class_of(near_copies.shingles(t.encode())): sets_of(t) for t in texts}
    want = {(a, b) for a in known for b in known if a < b and len(known[a] & known[b]) >= 0.8 * len(known[a] | known[b])}
    assert links == want and want


@pytest.mark.parametrize("own", [28, 70])
def test_pages_of_a_template_do_not_meet(spark, own):
    """Jaccard 0.75 and 0.56: no links, and at most a few candidates a page, at any number of pages."""
    for count in (400, 1600):
        assert met(spark, as_sets(spark, pages(count, own, random.Random(1)))).count() <= count


def test_crowded_key_of_a_template(spark, docs):
    """Pages of a template, and near copies of some of them: the whole search against comparing all pairs."""
    rnd = random.Random(3)
    texts = pages(150, 70, rnd)
    for i in range(0, 60, 3):
        words = texts[i].split()
        words[rnd.randrange(len(words))] = f"changed{i}"
        texts.append(" ".join(words))
    known = [sets_of(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(known):
        for j, b in enumerate(known[:i]):
            if root[i] != root[j] and len(a & b) >= 0.8 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(i)
    want = {i: min(g) for g in groups.values() for i in g}
    found = near_copies.near_copies(docs(list(enumerate(texts))), hot=8)
    assert {r.id: r.component for r in found.collect()} == want and len(groups) == 150


def words_of(count, seed):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(10**9)}" for _ in range(count)]


def test_simhash_fingerprint_by_its_definition():
    """A bit is set if it is set in more than half of the distinct shingles' values."""
    found = near_copies.shingles(" ".join(words_of(90, 5)).encode())
    want = sum(1 << bit for bit in range(64) if 2 * sum(int(h) >> bit & 1 for h in found) > len(found))
    assert near_copies.mark(found) % (1 << 64) == want and near_copies.mark(near_copies.shingles(b" ")) == 0


def test_simhash_links_without_min_hash(spark, docs, monkeypatch):
    """With no candidates by min-hash keys, texts within 3 bits are still found, and what is near in bits only is no link."""
    base = [words_of(1500, k) for k in range(6)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:-1] + ["changed"]) for w in base] + [" ".join(w) + " more" for w in base]
    marks = [near_copies.mark(near_copies.shingles(t.encode())) % (1 << 64) for t in texts]
    near = [i for i in range(6, 18) if (marks[i] ^ marks[i % 6]).bit_count() <= 3]
    assert len(near) >= 10  # one word of 1500 changes few bits
    nothing = lambda classes, hot: tuple(written(spark, spark.createDataFrame([], schema), "test-none") for schema in ("a long, b long", "key long, fp long"))
    monkeypatch.setattr(near_copies, "candidates", nothing)
    found = {r.id: r.component for r in near_copies.near_copies(docs([*enumerate(texts), (18, ""), (19, None)])).collect()}
    assert all(found[i] == i % 6 for i in near) and all(found[i] == i for i in range(6)) and found[18] == found[19] == 18
    texts = ["a b c d e", "a b c d f"]  # few shingles: near in bits or not, their similarity is 0
    monkeypatch.setattr(near_copies, "mark", lambda found: 7)
    assert {r.id: r.component for r in near_copies.near_copies(docs(list(enumerate(texts)))).collect()} == {0: 0, 1: 1}


def test_keys_of_all_classes_are_not_shuffled_by_key(spark, monkeypatch):
    """Looking for crowded keys moves (key, class) only: not each class's keys once more for each of its keys."""
    plans = {}

    def seen(session, df, label):
        plans[label] = df._jdf.queryExecution().explainString(session._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return written(session, df, label)

    monkeypatch.setattr(near_copies, "written", seen)
    monkeypatch.setattr(near_copies, "hubs", lambda crowded: crowded.select("key", "fp").withColumnRenamed("fp", "one"))
    classes = written(spark, spark.range(50).selectExpr("id as fp", "transform(sequence(0, 19), i -> id * 20 + i) as keys", "array(0L, 0L) as sketch"), "test-classes")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near_copies.candidates(classes, 8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [b for b in plans["copies-crowded"].split("\n\n") if "Exchange" in b and "hashpartitioning(key" in b]
    assert moved and not any("keys" in b for b in moved)


def test_what_is_exploded_or_packed_tightly_is_not_broadcast(spark, monkeypatch):
    """Each class of crowded keys, and its shingles, are many times as large in memory as Spark takes them to be."""
    plans = {}

    def seen(session, df, label):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString().splitlines()
        return written(session, df, label)

    monkeypatch.setattr(near_copies, "written", seen)
    classes = written(spark, spark.range(50).selectExpr("id as fp", "transform(sequence(0, 19), i -> i * 100 + id % 2) as keys", "array(id, 0L) as sketch"), "test-classes")
    pairs, crowded = near_copies.candidates(classes, 8)
    assert {(r.a % 2, r.b % 2) for r in pairs.collect()} == {(0, 0), (1, 1)} and crowded.count() == 1000
    joins = [x for x in plans["copies-pairs"] if "Join" in x and "key" in x]
    assert any("SortMergeJoin [key" in x and ", part" in x for x in joins) and not any("BuildLeft" in x for x in joins)
    assert sum("LeftOuter" in x for x in joins) == 2  # with the majority and with the class nearest to it
    first = written(spark, spark.range(60).selectExpr("id div 3 as shingle", "id as fp", "id % 3 as root", "0 as place", "40 as size"), "test-first")
    assert near_copies.meetings(first).count() == 60
    assert sum("SortMergeJoin [shingle" in x for x in plans["copies-meetings"]) == 2
