import corpus_pipeline
from tidemark.llm import bpe, decontaminate, quality, toxicity
from tidemark.llm.common import table
from tidemark.llm.queries import ORACLES, QUERIES


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLES) <= set(QUERIES)


def first_of_groups(texts):
    """The smallest id of each group of texts of five-word Jaccard similarity 0.8 or more, by comparing all pairs."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in sets}


def test_pipeline_equals_its_stages(spark, sf):
    """Each stage against a plain computation over what its predecessor kept."""
    docs = table(spark, sf, "documents")
    labels, bench = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    toxic = {r.doc_id for r in toxicity.op1(docs, labels).collect() if r.predicted}
    one = steps["toxicity"](spark, docs, sf)
    assert one.columns == names and {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()} - toxic
    good = {r.doc_id for r in quality.op7(one, labels).collect() if r.predicted}
    two = steps["quality_classifier"](spark, one, sf)
    assert {r.doc_id for r in two.collect()} == good
    first = first_of_groups({r.doc_id: r.text for r in two.collect()})
    three = steps["simhash_near_dedup"](spark, two, sf)
    assert three.columns == names and {r.doc_id for r in three.collect()} == first
    leaks = {r.doc_id for r in decontaminate.op5(three, bench).collect()}
    four = steps["benchmark_decontamination"](spark, three, sf)
    assert {r.doc_id for r in four.collect()} == first - leaks
    want = {r.doc_id: r.ids_sha256 for r in bpe.op4(four).collect()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want
