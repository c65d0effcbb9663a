"""Sizes and shapes at the ends of what the operators admit."""

import time

import numpy as np
import pytest

from tidemark.llm import decontaminate, topk, url_filter


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("width, size", [(2, 2.0**22), (200, 2.0**20 - 1), (3, 2.0**23)])
def test_top_k_of_large_components(spark, width, size):
    rng = np.random.default_rng(width)
    rows = [(i, (rng.normal(size=width)).tolist()) for i in range(60)] + [(60 + i, (rng.choice([-1, 1], size=width) * (size - i) * (0.4 if width == 200 else 1)).tolist()) for i in range(4)]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    assert sorted(map(tuple, topk.op6(vectors(spark, rows)).collect())) == sorted(want)


def test_a_score_that_fits_no_long_is_an_error(spark):
    with pytest.raises(Exception, match="fits no long"):
        topk.op6(vectors(spark, [(50, [2.0**30, 2.0**30]), (1, [2.0**30, 2.0**30])])).collect()


def test_many_rules_under_one_node_cost_no_more():
    def seconds(count):
        trie = url_filter.RuleTrie([("example.com", f"/page{i:06d}", "block") for i in range(count)])
        paths = [f"/page{i % (2 * count):06d}/x" for i in range(0, 20_000, 7)]
        best = 10**9
        for _ in range(5):
            began = time.perf_counter()
            found = sum(trie.match("www.example.com", p) is not None for p in paths)
            best = min(best, time.perf_counter() - began)
        assert found == sum(int(p[5:11]) < count for p in paths)
        return best

    assert seconds(200_000) < 4 * seconds(100)


def test_the_longest_ending_wins_and_slashes_end_it():
    trie = url_filter.RuleTrie([("a.com", "/b", "block"), ("a.com", "/bcd", "allow"), ("a.com", "/", "block"), ("a.com", "/bc/d", "allow"), ("a.com", "", "allow")])
    verdicts = {p: trie.match("a.com", p)[:2] for p in ("/bcde", "/bcx", "/bc/", "/bc/d", "/x", "", "/b")}
    assert verdicts == {"/bcde": ("a.com/bcd", "allow"), "/bcx": ("a.com/b", "block"), "/bc/": ("a.com/b", "block"), "/bc/d": ("a.com/bc/d", "allow"), "/x": ("a.com/", "block"), "": ("a.com", "allow"), "/b": ("a.com/b", "block")}


def test_sums_in_two_steps_are_the_sums(spark, docs, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(120)]
    items = [(i, texts[i * 7], None) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string, answer string").drop("answer")
    found = []
    for fan_in, gathered in ((64, 8), (1, 1)):
        monkeypatch.setattr(decontaminate, "FAN_IN", fan_in)
        monkeypatch.setattr(decontaminate, "GATHERED", gathered)
        found.append(sorted((r.doc_id, r.item_id) for r in decontaminate.op5(docs(list(enumerate(texts))), bench).collect()))
    assert found[0] == found[1] and {(i * 7, i) for i in range(12)} <= set(found[0])


def test_quality_does_not_learn_from_held_out_labels(docs, labels):
    import zlib

    from test_classifiers import corpus

    from tidemark.llm import quality

    d, y = corpus(seed=6, n=200)
    held = {i for i, *_ in y if zlib.crc32(str(i).encode()) % 5 == 0}
    scores = lambda told: sorted((r.doc_id, r.held_out, r.score) for r in quality.op7(docs(d), labels(told)).collect())
    one = scores(y)
    assert one == scores([(i, 1 - q if i in held else q, t) for i, q, t in y]) and {i for i, h, _ in one if h} == held and len(held) > 20
    assert one != scores([(i, q if i in held else 1 - q, t) for i, q, t in y])


def test_a_worker_gives_freed_memory_back(spark):
    """A worker lives on after its task; what the task's small objects took must not stay with it."""
    import re

    import pyarrow as pa

    from tidemark.llm.common import map_batches

    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    def held():
        with open("/proc/self/smaps_rollup") as rollup:
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", rollup.read()))) / 1024

    few = []

    def function(columns, state):
        many = [bytes(1000) + bytes([i % 256]) for i in range(300_000)]
        few.extend(many[::1000])  # so that the rest is not at the end of the heap
        return {"n": [len(many)]}

    batch = pa.record_batch({"x": pa.array([1])})
    before = held()
    assert [b.to_pydict() for b in map_batches(Frame(), function, "n long")(iter([batch]))] == [{"n": [300_000]}]
    assert held() < before + 100  # of 300 MB
