"""Near copies by five-word shingles: SimHash finds groups, min-hash bands find what it cannot reach, exact similarity decides.

Words as in ``simhash``; the distinct 5-word shingles' XXH64 values (fewer words: the whole sequence) are a text's set.
Texts of equal sets form one class, texts without words another. Pairs of classes of Jaccard similarity ``LEAST`` or more,
computed from the whole sets, are linked; components as in ``simhash``. No link is made without that check.

First, SimHash: a class's fingerprint has the bits set in more than half of its set's values. Fingerprints of 3 or fewer differing bits
are found by multi-index hashing (``simhash.links``). The first class of a fingerprint is compared with the other classes of
it and with the first classes of the fingerprints near it, so work grows with the classes. This gives the first components.

Then the rest: sets of similarity 0.8 differ in 10 of 64 bits on average, so SimHash alone would lose most links at that
border. ``BANDS`` keys of ``ROWS`` minima each: two sets of similarity 0.8 share a key with probability
1 - (1 - 0.8**5)**20 = 0.9996. Classes of different components that share a key are candidates too.

A key of more than ``HOT`` classes (a large group of near copies, or a passage that many texts share) is not paired out. In it
every class is compared with the class nearest to the majority of the key's sketches, which in a group of copies is what they
were copied from, and with one class of each of its sub-buckets by ``PARTS`` other keys; so work grows with the classes and
not with their square. A crowded key whose classes all ended in one component needs no more. What is left open in the others is
found by prefixes, exactly: each of their classes puts its shingles in one order for all, rarest first. Two sets of similarity
``LEAST`` share a shingle among the first ninth of the smaller one and the first fifth of the larger one (the rest would be
too little to be common), so only classes of different components that share such a shingle become candidates, where the places
of that shingle leave room for enough. In pages of one template these are shingles of their own; what all hold comes last. The
order is by counts in ``COUNTERS`` cells, which shingles share: any order is exact, a finer one only makes fewer candidates.
Links are always checked, so no wrong one is made.

Nulls, repeated rows and empty tables: as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import TEXT_BYTES, arrow_schema, forget, map_batches, slices, written
from tidemark.llm.simhash import SEED, components, links, majority

SHINGLE, LEAST, BANDS, ROWS, HOT, PARTS, COUNTERS, SLICE = 5, 0.8, 20, 5, 32, 4, 1 << 18, 1 << 12
_RANDOM = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_TIMES, _PLUS, _ODD = _RANDOM[0] | np.uint64(1), _RANDOM[1], np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted; none for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in grams], np.uint64))


def class_of(found: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(found.tobytes(), SEED), "big", signed=True) if len(found) else 0


def sign(found: np.ndarray) -> tuple[list[int], list[int]]:
    """(a key for each band, a sketch of two numbers); no keys for a text without words."""
    if not len(found):
        return [], [0, 0]
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for start in range(0, len(found), 512):
        mixed = found[None, start : start + 512] * _TIMES + _PLUS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(1))
    digest = xxhash.xxh64_digest
    bits = np.packbits(np.resize(((least * _ODD) >> np.uint64(63)).astype(np.uint8), 128) * (np.arange(128) < len(least)))
    return [int.from_bytes(digest(row.tobytes(), i), "big", signed=True) for i, row in enumerate(least.reshape(BANDS, ROWS))], bits.view(">i8").tolist()


def mark(found: np.ndarray) -> int:
    """The set's SimHash fingerprint; zero for a text without words."""
    return majority(found.byteswap().view(np.uint8).reshape(-1, 8)) if len(found) else 0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def fingerprint(text: bytes | None) -> int:
    return class_of(shingles(text))


def marked(classes: DataFrame) -> DataFrame:
    """Distinct pairs of classes (a, b), a < b, that SimHash finds, written: of one fingerprint, or first classes of near ones."""
    spark = classes.sparkSession
    members = classes.where("size(keys) > 0").select("fp", "mark")
    firsts = written(spark, members.groupBy("mark").agg(F.min("fp").alias("first"), F.count("*").alias("n")), "copies-marks")
    same = members.join(firsts.where("n > 1"), "mark").where("fp <> first").select("fp", "first")
    near = links(firsts.select(F.col("mark").alias("fp")))
    for side in ("a", "b"):
        near = near.join(firsts.select(F.col("mark").alias(side), F.col("first").alias(f"first_{side}")), side)
    pairs = same.unionByName(near.select(F.col("first_a").alias("fp"), F.col("first_b").alias("first")))
    pairs = written(spark, pairs.select(F.least("fp", "first").alias("a"), F.greatest("fp", "first").alias("b")).distinct(), "copies-marked")
    forget(firsts)
    return pairs


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes are in different components, written."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return written(pairs.sparkSession, pairs.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"), "copies-across")


def joined(roots: DataFrame, late: DataFrame) -> DataFrame:
    """(node, root) as ``components`` gives it, after more links."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))


def candidates(classes: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of classes (a, b), a < b, that are to be compared, and (key, fp) of the crowded keys, both written."""
    spark = classes.sparkSession
    dealt = classes.select("fp", F.posexplode("keys").alias("band", "key"))
    shared = written(spark, dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "copies-keys")
    few = written(spark, dealt.join(shared.where(F.col("n") <= hot), "key").select("key", "fp"), "copies-few")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b")
    many = written(spark, shared.where(F.col("n") > hot).select("key"), "copies-many")  # a table of its own: few keys, so the rows of all others stay where they are
    banded = dealt.join(many, "key", "left_semi").join(classes.select("fp", "keys", "sketch"), "fp")
    others = F.array(*(F.element_at("keys", (F.col("band") + j) % BANDS + 1) for j in range(1, PARTS + 1)))
    crowded = written(spark, banded.select("key", "fp", "sketch", others.alias("parts")), "copies-crowded")
    inside = crowded.select("fp", "key", F.explode("parts").alias("part"))
    chosen = inside.groupBy("key", "part").agg(F.min_by("fp", F.xxhash64("fp", "key", "part")).alias("one"))
    met = inside.hint("merge").join(chosen, ["key", "part"]).where("fp <> one").select("fp", "one")  # Spark takes what is exploded to be as small as before
    met = met.unionByName(crowded.join(hubs(crowded), "key", "left").where("not fp <=> one").select("fp", "one"))
    pairs = pairs.unionByName(met.select(F.least("fp", "one").alias("a"), F.greatest("fp", "one").alias("b")))
    pairs = written(spark, pairs.distinct(), "copies-pairs")
    open_ = written(spark, crowded.select("key", "fp"), "copies-members")
    forget(shared, few, many, crowded)
    return pairs, open_


def hubs(crowded: DataFrame) -> DataFrame:
    """(key, one): the class of each key whose sketch is nearest to the bits that most of its classes have.

    Every key has both, so left joins find the same rows: the side of the classes, which is packed tightly on disk, is not for broadcasts.
    """
    bits = BANDS * ROWS
    place = lambda i: f"sketch[{i // 64}] >> {63 - i % 64}"
    ones = crowded.groupBy("key").agg(F.count("*").alias("n"), *(F.sum(F.expr(f"({place(i)}) & 1")).alias(f"b{i}") for i in range(bits)))
    word = lambda low, high: F.expr(" | ".join(f"if(2 * b{i} > n, shiftleft(1L, {63 - i % 64}), 0L)" for i in range(low, high)))
    most = ones.select("key", word(0, 64).alias("m0"), word(64, bits).alias("m1"))
    far = F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("m0"))) + F.bit_count(F.col("sketch")[1].bitwiseXOR(F.col("m1")))
    return crowded.join(most, "key", "left").groupBy("key").agg(F.min_by("fp", F.struct(far.alias("far"), F.col("fp").alias("fp"))).alias("one"))


def _sets(asked: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(fp, held) of the classes in ``asked``, written: their packed sets, each read from one text of its class."""
    spark = classes.sparkSession
    # a table of its own, so that Spark knows its size: where that is small the texts are not shuffled
    ids = written(spark, classes.join(asked, "fp", "left_semi").where("least is not null").select(F.col("least").alias("id")), "copies-ids")
    texts = rows.join(ids, "id", "left_semi").select("text").unionByName(rows.where("id is null").select("text"))

    def gathered(columns: dict[str, list], _: None) -> dict[str, list]:
        sets = [*map(shingles, columns["text"])]
        return {"fp": [*map(class_of, sets)], "held": [s.tobytes() for s in sets]}

    sets = written(spark, map_batches(texts, gathered, "fp long, held binary", None, TEXT_BYTES).dropDuplicates(["fp"]), "copies-sets")
    forget(ids)
    return sets


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each of ``COUNTERS`` cells; as large as that for any number of sets.

    A task adds up its own cells and emits them by slices of ``SLICE``; a second stage adds up each slice.
    """
    schema = "slice int, counts binary"
    target = arrow_schema(sets.sparkSession, schema)

    def emitted(total: np.ndarray) -> pa.RecordBatch:
        rows = [(i, block.tobytes()) for i, block in enumerate(total.reshape(-1, SLICE)) if block.any()]
        return pa.RecordBatch.from_pylist([{"slice": i, "counts": block} for i, block in rows], schema=target)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches, most_bytes=TEXT_BYTES):
            cells = _unpacked(b"".join(batch.column(0).to_pylist())) & np.uint64(COUNTERS - 1)
            total += np.bincount(cells.astype(np.int64), minlength=COUNTERS)
        yield emitted(total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for i, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i * SLICE : (i + 1) * SLICE] += np.frombuffer(block, np.int64)
        yield emitted(total)

    out = np.zeros(COUNTERS, np.int64)
    for row in sets.select("held").mapInArrow(counted, schema).repartition("slice").mapInArrow(added, schema).collect():  # a row a slice
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], np.int64)
    return out


def prefixes(sets: DataFrame) -> DataFrame:
    """(shingle, fp, root, place, size) for the first fifth of each set of (fp, root, held), rarest first."""
    counts = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def ordered(columns: dict[str, list], _: None) -> dict[str, np.ndarray]:
        first, sizes, lengths = [], [], []
        for held in map(_unpacked, columns["held"]):
            size = len(held)
            most = size - (4 * size + 4) // 5 + 1
            first.append(held[np.lexsort((held, counts.value[held & np.uint64(COUNTERS - 1)]))[:most]])
            sizes.append(size)
            lengths.append(most)
        each = lambda values, kind: np.repeat(np.array(values, kind), lengths)
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        return {"shingle": np.concatenate(first).view(np.int64), "fp": each(columns["fp"], np.int64), "root": each(columns["root"], np.int64), "place": place, "size": each(sizes, np.int32)}

    return map_batches(sets.select("fp", "root", "held"), ordered, "shingle long, fp long, root long, place int, size int", None, TEXT_BYTES)


def meetings(first: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of classes of different components that share a shingle early enough in both sets.

    ``first``: what ``prefixes`` gives, written. Classes of the component that holds most of a shingle's rows never meet each other.
    """
    spark = first.sparkSession
    several = first.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    met = written(spark, first.join(several, "shingle", "left_semi"), "copies-met")
    main = met.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    tied = written(spark, met.join(main, "shingle", "left"), "copies-tied")
    others = tied.where("root <> main")
    short = "place <= size - (8 * size + 8) div 9"  # the smaller set's first ninth

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("shingle", *(F.col(c).alias(f"{c}_{name}") for c in ("fp", "root", "place", "size", "main")))

    room = "9 * least(size_x - place_x, size_y - place_y) >= 4 * (size_x + size_y) and root_x <> root_y"
    # both tables are many times as large in memory as on disk, by which Spark sizes them: they are shuffled
    smaller = side(others.where(short), "x").hint("merge").join(side(tied, "y"), "shingle").where(f"size_x <= size_y and {room}")
    larger = side(others, "x").hint("merge").join(side(tied.where(short), "y"), "shingle").where(f"size_x >= size_y and {room}")
    pairs = smaller.unionByName(larger).select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b"))
    pairs = written(spark, pairs.distinct(), "copies-meetings")
    forget(met, tied)
    return pairs


def stragglers(crowded: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links between classes of crowded keys whose classes are in different components.

    ``sets`` holds those of all compared classes, so of every class of a crowded key: each meets the one nearest to the majority.
    """
    spark = crowded.sparkSession
    tied = crowded.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    parted = tied.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = written(spark, tied.join(parted, "key", "left_semi").select("fp", "root").distinct(), "copies-open")
    first = written(spark, prefixes(sets.join(left, "fp")), "copies-prefixes")
    pairs = meetings(first)
    late = checked(pairs, sets)
    forget(left, first, pairs)
    return late


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar, written."""

    def compared(columns: dict[str, list], _: None) -> dict[str, list]:
        near = [similarity(_unpacked(x), _unpacked(y)) >= LEAST for x, y in zip(columns["x"], columns["y"], strict=True)]
        return {c: [v for v, n in zip(columns[c], near, strict=True) if n] for c in ("a", "b")}

    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("held").alias("y")), "b")
    return written(pairs.sparkSession, map_batches(both.select("a", "b", "x", "y"), compared, "a long, b long", None, TEXT_BYTES), "copies-links")


def near_copies(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, fp, root, component) for every row: its class, and the smallest class and smallest id of its group."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))

    def signed(columns: dict[str, list], _: None) -> dict[str, list]:
        sets = [*map(shingles, columns["text"])]
        signs = [*map(sign, sets)]
        return {"id": columns["id"], "fp": [*map(class_of, sets)], "mark": [*map(mark, sets)], "keys": [s[0] for s in signs], "sketch": [s[1] for s in signs]}

    signs = written(spark, map_batches(rows, signed, "id long, fp long, mark long, keys array<long>, sketch array<long>", None, TEXT_BYTES), "copies-rows")
    classes = written(spark, signs.groupBy("fp").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("mark", "keys", "sketch"))), "copies-classes")
    close = marked(classes)
    pairs, crowded = candidates(classes, hot)
    sets = _sets(close.unionByName(pairs).select(F.explode(F.array("a", "b")).alias("fp")).distinct(), classes, rows)
    found = checked(close, sets)
    roots = components(found)
    rest = across(pairs, roots)
    late = checked(rest, sets)
    roots = joined(roots, late)
    forget(close, pairs, found, rest, late)
    if not crowded.isEmpty():
        late = stragglers(crowded, sets, roots)
        if not late.isEmpty():
            roots = joined(roots, late)
        forget(late)
    forget(crowded, sets)
    tied = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = tied.groupBy("root").agg(F.min("least").alias("component"))
    return signs.select("id", "fp").join(tied.join(least, "root").select("fp", "root", "component"), "fp").select("id", "fp", "root", "component")
