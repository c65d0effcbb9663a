import math

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm import decontaminate, sharding, simhash, topk, url_filter, warc


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    component = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and component[j] > component[i]:
                    component[j], changed = component[i], True
    return component


def test_simhash_equals_brute_force(spark, docs, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = "one two three four five six seven eight nine ten".split()
    rows += [(1000 + k, " ".join(words[: 3 + k % 4] * 3 + ["x"] * (k // 10))) for k in range(60)] + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "ÄB c"), (5004, "äb c")]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10(docs(rows)).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_links_usual_and_crowded(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = {b ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for b in base for n in range(7) for _ in range(5)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    for hot in (1024, 2, 0):
        assert {(r.a, r.b) for r in simhash.links(frame, hot=hot).collect()} == want


def test_balls_are_never_broadcast(spark):
    """A table of few bytes is exploded to 35 times as many rows, of which Spark knows nothing."""
    frame = spark.range(100).selectExpr("xxhash64(id) as fp")
    for hot, joins in ((1024, 1), (0, 2)):  # the usual and the crowded segment values
        plan = simhash.links(frame, hot=hot)._jdf.queryExecution().sparkPlan().toString()
        assert len([x for x in plan.splitlines() if "SortMergeJoin" in x and "Inner" in x]) == joins and not any("BroadcastHashJoin" in x and "Inner" in x for x in plan.splitlines())


def test_keep_one(docs):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "zz yy xx ww vv"), (3, "q w e r t y"), (3, "q w e r t y"), (5, "q w e r t y"), (7, None), (8, "")]
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d e"), (0, "zz yy xx ww vv"), (3, "q w e r t y"), (7, "")]
    assert simhash.keep_one(docs([])).count() == 0 and simhash.op10(docs([])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("case", ["random", "ties", "one", "repeated", "clusters"])
def test_top_k_equals_brute_force(spark, case):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 6)) * 9
    rows = {
        "random": [(i, rng.normal(size=6).tolist(), 0) for i in range(400)],
        "ties": [(i, [float(i % 3), 1.0], 0) for i in range(300)],
        "one": [(50, [1.0, 2.0], 0)],
        "repeated": [(i % 60, rng.normal(size=3).tolist() if i < 200 else [1.0, 1.0, 1.0], 0) for i in range(2000)],
        "clusters": [(i, (centres[i % 20] + rng.normal(size=6) * 0.1).tolist(), 0) for i in range(3000)],
    }[case]
    if case == "random":
        rows += [(1000, None, 0), (1001, [float("nan")] * 6, 0), (1002, [None] * 6, 0), (1003, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (0, rows[0][1], 0), (1050, [1e30] * 6, 0)]
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and (case != "random" or i < 1000)]
    whole, ids = np.array([v for _, v in good], np.int64), np.array([i for i, _ in good])
    want = []
    for q, (i, v) in enumerate(good):
        if i % 50 == 0:
            scores = whole @ np.array(v)
            best = [c for c in np.lexsort((ids, -scores)) if c != q][:5]
            want += [(i, rank, int(ids[c]), int(scores[c])) for rank, c in enumerate(best, 1)]
    assert sorted(map(tuple, topk.op6(vectors(spark, rows)).collect())) == sorted(want)
    assert topk.op6(vectors(spark, [])).count() == 0


def test_the_index_prunes(spark):
    """Vectors in groups: a small part of all pairs is scored. Without structure, in many dimensions, nothing can be pruned."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    grouped = [(i, (centres[i % 40] / np.linalg.norm(centres[i % 40]) + rng.normal(size=16) * 0.02).tolist(), 0) for i in range(8000)]
    share = topk.visited_share(topk.integer_vectors(vectors(spark, grouped)), 50, annulus_rows=64)
    assert 0 < share < 0.2
    alike = [(i, [1.0, 2.0], 0) for i in range(2000)]
    assert topk.visited_share(topk.integer_vectors(vectors(spark, alike)), 50) == 1.0
    assert topk.visited_share(topk.integer_vectors(vectors(spark, [])), 50) == 0.0


def test_visits_are_never_broadcast(spark):
    """A query's visits to annuli, of which Spark knows nothing, are many times the queries' table."""
    rng = np.random.default_rng(6)
    rows = topk.integer_vectors(vectors(spark, [(i, rng.normal(size=4).tolist(), 0) for i in range(500)]))
    plan = topk.top_k(rows, 50)._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert any("SortMergeJoin" in x and "cell" in x for x in plan) and not any("BroadcastHashJoin" in x and "cell" in x for x in plan)


def test_the_sample_is_not_as_many_rows_as_the_tasks_hold(spark):
    rng = np.random.default_rng(7)
    rows = topk.integer_vectors(vectors(spark, [(i, rng.normal(size=4).tolist(), 0) for i in range(4000)]).repartition(40))
    index = topk.Index(rows, sample_rows=50)
    best = topk.F.xxhash64(topk.F.lit(7), "id", "row")
    assert [r.row for r in index.sample(index.rows, 50).collect()] == [r.row for r in index.rows.orderBy(best, "row").limit(50).collect()]
    plan = index.sample(index.rows, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan  # 40 tasks with 50 rows each would all be sent
    assert index.sample(index.rows, 3000).count() == 3000


def test_a_crowded_annulus_is_joined_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    monkeypatch.setattr(topk, "CHUNK", 2)
    rows = [(i, [1.0, 2.0] if i < 150 else [float(i), 3.0], 0) for i in range(200)]
    index = topk.Index(topk.integer_vectors(vectors(spark, rows)))
    chunks = [r.chunk for r in index.blocks().select("chunk").distinct().collect()]
    assert len(chunks) > 3
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    want = {(q, rank, i, -s) for q in range(0, 200, 50) for rank, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q)[:5], 1)}
    assert {tuple(r) for r in topk.op6(vectors(spark, rows)).collect()} == want


def test_top_k_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert {tuple(r) for r in topk.op6(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()} == set(c.execute(topk.ORACLE_SQL).fetchall())


def test_sharding(spark, docs):
    rows = [(i, "é" * (i % 7) or None) for i in range(2000)] + [(7, "é" * 0), (7, "x"), (None, "n"), (None, "n")]
    got = sharding.op2(docs(rows)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 40
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 14} == {(16, 0)}
    assert sorted(map(tuple, sharding.op2(docs(rows)).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert sharding.op2(docs([])).count() == 0


def test_shards_equal_a_recomputation(spark, docs):
    """Rendezvous hashing and the scatter into buckets, by the public hash; slots are a permutation that depends on the seed."""
    rows = [(i * 37, f"text {i}") for i in range(600)] + [(None, "n"), (None, "m")]
    chained = lambda *parts: __import__("functools").reduce(lambda seed, part: xxhash.xxh64_intdigest(part, seed), parts, 42)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    four, eight = (lambda n: n.to_bytes(4, "little", signed=True)), (lambda n: n.to_bytes(8, "little", signed=True))
    value = lambda i, s: signed(chained(four(sharding.SEED), *([] if i is None else [eight(i)]), four(s)))
    place = lambda i, n: max((value(i, s), s) for s in range(n))[1]
    got = sharding.op2(docs(rows)).collect()
    assert sorted((r.doc_id or -1, r.shard, r.grown_shard) for r in got) == sorted((i or -1 if i != 0 else -1, place(i, 40), place(i, 41)) for i, _ in rows)
    dealt = sharding.shuffle_into_shards(docs(rows), "doc_id", "text", ["doc_id", "text"], shards=2, least_buckets=3).collect()
    in_order = [r.doc_id for r in sorted(dealt, key=lambda r: (r.shard, r.slot))]
    assert in_order != sorted(in_order, key=lambda i: (i is None, i)) and {r.bucket for r in dealt} == {0, 1, 2}
    for shard in (0, 1):
        own = sorted((r.slot, r.bucket) for r in dealt if r.shard == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [b for _, b in own] == sorted(b for _, b in own)  # bucket after bucket


def test_shards_of_clashing_columns(spark, docs, tmp_path):
    rows = docs([(i, f"t{i}") for i in range(50)]).selectExpr("doc_id", "text", "'a' as size", "'b' as shard", "'c' as Bucket", "'d' as slot")
    back = sharding.write_shards(rows, str(tmp_path / "out"), shards=3)
    assert back.columns == ["doc_id", "text", "size", "shard", "Bucket", "slot", "_size", "_bucket", "_slot", "_shard"]
    assert back.count() == 50 and {(r.size, r.shard, r.Bucket, r.slot) for r in back.collect()} == {("a", "b", "c", "d")} and back.select("_shard").distinct().count() == 3


def test_shard_files(spark, docs, tmp_path):
    sharding.write_shards(docs([(i, f"t{i}") for i in range(500)]).select("doc_id", "text"), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and {r.text for r in back.collect()} == {f"t{i}" for i in range(500)}


def test_shards_hold_whole_records(spark, docs):
    """What op2 returns comes from shards on disk that hold the texts; a heavy shard gets buckets by its own bytes."""
    import glob

    rows = [(i, f"text {i} ") for i in range(100)] + [(None, f"{i} " * 1000) for i in range(100)]
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{root}/shards-*"))
    assert sharding.op2(docs(rows)).count() == len(rows)
    (path,) = set(glob.glob(f"{root}/shards-*")) - before
    assert sorted(r.text for r in spark.read.parquet(path).collect()) == sorted(t for _, t in rows)
    dealt = sharding.shuffle_into_shards(docs(rows), "doc_id", "text", ["doc_id", "text"], bucket_bytes=20_000)
    assert dealt.where("doc_id is null").select("bucket").distinct().count() > sharding.LEAST_BUCKETS
    assert dealt.where("doc_id is not null").agg({"bucket": "max"}).first()[0] is not None


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as digest", "'clash' as key")


def test_warc_round_trip(spark):
    import base64
    import hashlib

    rows = [(3, "http://a/", "same"), (1, None, "same"), (2, "http://b/\r\nX", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 3_000_000), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (None, "u", "lone")]
    got = {(r.page_id, r.payload_digest): tuple(r) for r in warc.op3(pages(spark, rows)).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    refers = {1: None, 2: 1, 3: 1, 4: None, 5: 4, 6: None, 7: None}
    want = {(i, digest(t)): (i, len((t or "").encode()), digest(t), "revisit" if refers[i] else "response", refers[i]) for i, _, t in rows if i}
    want |= {(None, digest("same")): (None, 4, digest("same"), "revisit", 1), (None, digest("lone")): (None, 4, digest("lone"), "response", None)}
    assert got == want
    assert warc.op3(pages(spark, [])).count() == 0


def test_warc_random_access(spark):
    frame = pages(spark, [(i, f"http://x/{i}", f"body {i} " * 500) for i in range(300)])
    folder, index = warc.archive(frame)
    chosen = index.where("key % 37 = 5")
    assert {(r.key, bytes(r.payload)) for r in warc.fetch(spark, folder, chosen).collect()} == {(i, (f"body {i} " * 500).encode()) for i in range(300) if i % 37 == 5}


def test_warc_is_read_by_many_tasks(spark):
    frame = pages(spark, [(i, f"http://x/{i}", f"body {i} " * 900) for i in range(2000)])
    folder, index = warc.archive(frame)
    for read in (warc.fetch(spark, folder, index), warc.read_bundles(spark, folder, index)):
        assert read.rdd.getNumPartitions() > 1
        assert {(r.key, r.payload_bytes) for r in read.collect()} == {(i, len(f"body {i} " * 900)) for i in range(2000)}
    wrong = index.where("key = 5").selectExpr("key + 1 as key", "bundle", "frame", "frame_start", "offset", "length")
    with pytest.raises(Exception, match="no record 6"):
        warc.fetch(spark, folder, wrong).collect()


def test_seekable_bundle():
    import io

    import pyarrow as pa
    import zstandard

    out = io.BytesIO()
    writer = warc.BundleWriter(out, frame_bytes=1000)
    records = [warc.encode_record(i, "u", b"x" * 400, None) for i in range(10)]
    places = [writer.add(r) for r in records]
    writer.close()
    data = out.getvalue()
    frames = warc.read_seek_table(pa.BufferReader(data), len(data))
    for (frame, start, offset, length), record in zip(places, records):
        plain = zstandard.ZstdDecompressor().decompress(data[start : start + frames[frame][1]], max_output_size=frames[frame][2])
        assert frames[frame][0] == start and plain[offset : offset + length] == record
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)


URLS = ["http://A.Example.NET/en/x?q#f", "https://example.net/en", "ftp://example.net", "x://notexample.net/en/", "http://b.example.com/de/1", "http://example.org/fr/", "http://org/fr/x", "http://EXAMPLE.org/FR/", None, "", "no scheme", "http://", "http://h:80/p", "http://x.net?/a", "a://b://c.net/d", "http://net/"]


def test_url_filter_equals_sql(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS)] + [(0, URLS[0], "")]
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    order = lambda r: str(r)
    assert sorted(map(tuple, url_filter.op8(pages(spark, rows)).collect()), key=order) == sorted(c.execute(url_filter.ORACLE_SQL).fetchall(), key=order)
    assert url_filter.op8(pages(spark, [])).count() == 0


def test_url_trie_precedence():
    trie = url_filter.RuleTrie([("net", "/", "block"), ("a.net", "/", "allow"), ("a.net", "/x/y", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/", "block")])
    assert trie.match("q.a.net", "/x/yes")[:2] == ("a.net/x/y", "block") and trie.match("a.net", "/x/z")[:2] == ("a.net/x/", "block")
    assert trie.match("a.net", "/z")[:2] == ("a.net/", "allow") and trie.match("b.net", "/z")[1] == "block" and trie.match("ba.nets", "/") is None


def test_a_long_list_of_rules_takes_several_tries(spark):
    rules = [("net", "/", "block"), ("a.net", "/", "allow"), ("a.net", "/x/y", "block"), ("a.net", "/x/", "allow"), ("a.net", "/x/", "block"), ("b.a.net", "/", "allow"), ("org", "/fr/", "block")]
    urls = [(i, f"http://{h}{p}", "") for i, (h, p) in enumerate((h, p) for h in ("net", "a.net", "q.a.net", "b.a.net", "org", "x.org", "com") for p in ("/", "/x/", "/x/yes", "/fr/z", ""))]
    order = lambda r: str(r)
    want = sorted(map(tuple, url_filter.filter_urls(pages(spark, urls), rules).collect()), key=order)
    for most in (1, 3):
        assert sorted(map(tuple, url_filter.filter_urls(pages(spark, urls), rules, most=most).collect()), key=order) == want
    assert {r[4] for r in want} == {"allow", "block"} and url_filter.filter_urls(pages(spark, urls), []).where("rule is not null").count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = rng.integers(0, 6, 25).astype(np.int32), rng.integers(0, 7, 40).astype(np.int32)
        assert decontaminate.common_subsequence(a.tolist(), b) == lcs(a, b)


def test_no_subsequence_is_worked_out_where_too_many_words_are_missing(monkeypatch):
    worked = []
    common = decontaminate._common
    monkeypatch.setattr(decontaminate, "_common", lambda *a: worked.append(1) or common(*a))
    rng = np.random.default_rng(5)
    skipped = 0
    for size in range(5, 60):
        item = decontaminate.Item(1, rng.integers(0, 2 * size, size).astype(np.uint32), np.arange(3, dtype=np.uint32))
        for few in range(size):  # the item, with more and more words of its end replaced
            region = np.concatenate([item.numbers[: size - few], rng.integers(10**6, 10**7, few).astype(np.uint32)])
            worked.clear()
            share = item.share(region)
            skipped += not worked
            whole = decontaminate.common_subsequence(item.numbers.tolist(), region) / size
            enough = whole >= decontaminate.SURE or whole >= decontaminate.LIKELY and 2 * decontaminate.common_subsequence(item.answer.tolist(), region) >= 3
            assert share == (whole if enough else None)
    assert skipped > 500


def test_decontamination(spark, docs):
    import random

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 7)))
    common = [word() for _ in range(30)]
    prose = lambda n: [rnd.choice(common) if rnd.random() < 0.4 else word() for _ in range(n)]
    items = [(i, " ".join(prose(rnd.randint(15, 60)))) for i in range(30)]
    rows, want = [], set()
    for d in range(200):
        text = prose(rnd.randint(1, 300))
        if d % 8 == 0:
            i, passage = items[d % 30]
            words = passage.split()
            if d % 16 == 0:  # a paraphrase: an eighth of the words replaced, other case and signs
                words = [w.upper() + "," if k % 8 else word() for k, w in enumerate(words, 1)]
            at = rnd.randrange(len(text) + 1)
            text[at:at] = words
            want.add((d, i))
        rows.append((d, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "word " * 100_000 + items[3][1]), (None, items[4][1])]
    want |= {(902, 3), (None, 4)}
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "a b")], "item_id long, text string")
    frame = docs(rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.op5(frame, bench).collect()} == want
    clean = decontaminate.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    blocks = decontaminate.find_leaks(frame, bench, block_items=11)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == want
    assert decontaminate.op5(docs([]), bench).count() == 0 and decontaminate.op5(frame, bench.limit(0)).count() == 0


def test_near_copies_equal_brute_force(spark, docs):
    """The pipeline's stage keeps one of each group of 5-word Jaccard 0.8, also where keys are crowded."""
    import random

    import corpus_pipeline

    rnd = random.Random(4)
    rows, at = [], 0
    for group in range(25):
        text = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 200))]
        for copy in range(60 if group == 0 else 3):
            words = [f"new{at}" if copy and k in {len(text) // 3, len(text) // 2}.union([5] * (copy % 2)) and len(text) > 90 else w for k, w in enumerate(text)]
            rows.append(((at := at + 1), " ".join(words)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (None, "of no id"), (None, "of no  ID"), (None, "another")]
    sets = [{*zip(*(w[i:] for i in range(5)), strict=False)} or {tuple(w)} for _, t in rows for w in [(t or "").lower().split()]]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for r, (doc, _) in zip(root, rows, strict=True):
        groups.setdefault(r, []).append(doc)
    want = sorted(min((d for d in g if d), default=0) for g in groups.values())
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(rows), "")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == want and kept.columns == docs(rows).columns
    assert corpus_pipeline.drop_near_duplicates(spark, docs([]), "").count() == 0


def searcher(items, weights):
    """A searcher over items of words of their own, in a basis with a direction for each item; gives {item: best place}."""
    features = decontaminate.Features(np.arange(sum(map(len, items)), dtype=np.uint32))
    basis, own, at = np.zeros((features.size, len(items))), [], 0
    for i, item in enumerate(items):
        numbers = np.arange(at, at + len(item), dtype=np.uint32)
        basis[numbers, i], at = 1.0, at + len(item)
        own.append(decontaminate.Item(i, numbers, numbers[-(len(item) // 5) :]))
    pieces = []
    for item in own:
        words, count = len(item.numbers), -(-len(item.numbers) // decontaminate.SIZES[-1])
        pieces += [(item, words * j // count, words * (j + 1) // count) for j in range(count)]
    made = decontaminate.Searcher(features, basis * np.array(weights)[:, None], pieces, [])
    return lambda text: {item.item_id: place for (_, item), place in made.search(text.astype(np.uint32), np.array([len(text)])).items()}


def test_decontamination_without_the_rarest_words():
    """A paraphrase that changes names and numbers keeps four fifths of an item, but a short vector."""
    items = [[f"{i}-{j}" for j in range(30)] for i in range(3)]
    found = searcher(items, [10.0 if j % 5 == 2 else 1.0 for _ in items for j in range(30)])
    text = np.array([90] * 50 + [90 if j % 5 == 2 else 30 + j for j in range(30)] + [90] * 50, np.int32)
    assert {k: place[0] for k, place in found(text).items()} == {1: 0.8}
    assert not found(text[:60]) and not found(text[:0])


def test_basis_is_fitted_on_whole_texts_of_all_documents(spark):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (0, 5, 100, 4000)]
    texts.append(np.append(np.full(70 * 48, 9), np.arange(9)).astype(np.int32))  # words 0 to 8 stand behind 3360 others
    weights, block = rng.random(9) + 0.1, rng.standard_normal((9, 4))
    rows = []
    for text in texts:
        for part in (text[i : i + 48] for i in range(0, len(text), 48)):
            row = np.bincount(part, minlength=10)[:9] * weights
            rows += [row / np.linalg.norm(row)] if row.any() else []
    a = np.array(rows)
    assert np.allclose(decontaminate._grams(texts, weights, block, 48), a.T @ (a @ block))
    numbered = spark.createDataFrame([(i, bytearray(t.astype(np.uint32).tobytes())) for i, t in enumerate(texts)], "doc_id long, numbers binary")
    basis = decontaminate.latent_basis(numbered, decontaminate.Features(np.arange(9, dtype=np.uint32)), weights, None, 9)
    assert np.allclose(np.linalg.norm(a @ basis, axis=0), np.linalg.svd(a)[1], rtol=1e-4)  # sums are in single precision


def test_decontamination_finds_long_items():
    """Copies of a long item, one across a segment's border, the other with only its last two thirds like the item."""
    words = 3000
    items = [[f"{i}-{j}" for j in range(n)] for i, n in enumerate((250, words))]
    found = searcher(items, [1.0] * (250 + words))
    copy, other = np.arange(250, 250 + words), 250 + words
    for at in (0, 7000, 8000):
        text = np.concatenate([np.full(at, other), copy, np.full(9000, other)]).astype(np.int32)
        assert {k: place[0] for k, place in found(text).items()} == {1: 1.0}
    text[8000 : 8000 + words // 3] = other
    text[20000 - 8000 :] = other
    assert {k: round(place[0], 2) for k, place in found(text).items()} == {1: 0.67}


def brute_leaks(texts, items):
    """Every (text, item) of which some region of the item's length and a half holds enough, by the plain recurrence."""
    found = set()
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            n = len(item)
            if n < decontaminate.LEAST_WORDS:
                if any(text[k : k + n] == item for k in range(len(text) - n + 1)):
                    found.add((t, i))
                continue
            for k in range(0, max(1, len(text) - n), max(1, n // 6)):
                region = text[max(0, k - n // 2) : k + n + n // 2]
                share = lcs(item, region) / n
                answer = item[-max(3, n // 5) :]
                if share >= decontaminate.SURE or share >= decontaminate.LIKELY and 2 * lcs(answer, region) >= len(answer):
                    found.add((t, i))
                    break
    return found


def test_decontamination_equals_brute_force(spark, docs):
    """Items of 1 to 200 words, exact, with words replaced, dropped and added, in texts of their common words."""
    import random

    rnd = random.Random(12)
    common = [f"c{k}" for k in range(40)]
    prose = lambda n: [rnd.choice(common) if rnd.random() < 0.5 else f"w{rnd.randrange(900)}" for _ in range(n)]
    items = [["lonely"], ["two", "together"], *(prose(n) for n in (3, 4, 5, 6, 9, 15, 22, 31, 47, 60, 90, 140, 200))]
    texts = [["nothing"], ["lonely"], ["together", "two"], ["so", "two", "together"]]
    for i, item in enumerate(items):
        for change in (0.0, 0.1, 0.19, 0.5):
            words = [w for w in item if rnd.random() >= change / 2]
            words = [w if rnd.random() >= change / 2 else f"new{rnd.randrange(10**6)}" for w in words]
            text = prose(rnd.randint(0, 150))
            at = rnd.randrange(len(text) + 1)
            texts.append(text[:at] + words + text[at:])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5(docs([(t, " ".join(w)) for t, w in enumerate(texts)]), bench).collect()}
    want = brute_leaks(texts, items)
    assert len(want) > 40 and len(got & want) >= 0.9 * len(want), sorted(want - got)
    assert len(got - want) <= 0.05 * len(want), sorted(got - want)  # regions that the brute force's steps of a sixth pass over


def test_decontamination_of_items_of_any_length(spark, docs):
    import random

    rnd = random.Random(2)
    sizes = (1, 2, 4, 5, 7, 30, 288, 289, 2000, 4000, 8000, 20_000)
    items = [" ".join(f"i{i}w{rnd.randrange(n)}" for _ in range(n)) for i, n in enumerate(sizes)]
    rows = [(i, text) for i, text in enumerate(items)] + [(100 + i, "before it " * 50 + text + " and after it" * 50) for i, text in enumerate(items)] + [(900, "clean text")]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.op5(docs(rows), bench).collect()}
    assert found == {(i, i) for i in range(len(sizes))} | {(100 + i, i) for i in range(len(sizes))}


def test_answers_of_the_benchmark(spark, docs):
    """With three fifths of an item, half of its answer decides; the answer may be a column."""
    words = [f"w{k}" for k in range(20)]
    held = " ".join(words[:13])
    for answer, want in ((None, set()), ("W1, w2", {1}), ("w18 w19", set())):
        bench = spark.createDataFrame([(7, " ".join(words), answer)], "item_id long, text string, answer string")
        rows = [(1, held), (2, "w1 w2"), *((k, f"other text {k}") for k in range(10, 400))]
        assert {r.doc_id for r in decontaminate.op5(docs(rows), bench).collect()} == want


def test_words_are_numbered_alike():
    texts = ["One, two", None, "", "  ONE\u00a0«two»\t(three)…", "don't don’t ... é É", "x" * 3_000_000 + " one"]
    numbers, lengths = decontaminate.number_words(texts)
    assert lengths.tolist() == [2, 0, 0, 3, 4, 2]
    assert numbers[0] == numbers[2] == numbers[10] and numbers[1] == numbers[3] and numbers[5] == numbers[6] and numbers[7] == numbers[8]
    assert len(set(numbers.tolist())) == 6


def test_warc_equals_sql(spark):
    rows = [(i, "u", ["a", "b", None, "é", f"own {i}"][i % 5]) for i in range(40)]
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    assert {tuple(r) for r in warc.op3(pages(spark, rows)).collect()} == set(c.execute(warc.ORACLE_SQL).fetchall())


def test_words_are_numbered_in_little_memory():
    """Texts are numbered some at a time: the same numbers as one by one, and arrays as large as some texts need, not all."""
    import tracemalloc

    texts = [" ".join(f"W{i}x{k}," for k in range(15_000)) for i in range(16)] + [None, "", "…", "end"]
    numbers, lengths = decontaminate.number_words(texts)  # the powers are made once
    apart = [decontaminate.number_words([t]) for t in texts]
    assert (numbers == np.concatenate([a[0] for a in apart])).all() and (lengths == np.concatenate([a[1] for a in apart])).all()
    assert [len(a) for a in decontaminate.number_words([])] == [0, 0] and lengths.tolist() == [15_000] * 16 + [0, 0, 0, 1]
    tracemalloc.start()
    decontaminate.number_words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * sum(len(t or "") for t in texts)
