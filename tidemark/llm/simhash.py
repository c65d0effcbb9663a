"""SimHash near-duplicates by multi-index hashing.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats (fewer words: the whole
sequence), XXH64 with seed 42; a bit is set if it is set in more than half of the hashes. A text without words, empty or
null has fingerprint zero and is linked like any other.

Search: a fingerprint is two 32-bit segments. Two fingerprints within 3 bits have a segment within 1 bit, so every
fingerprint is stored under both of its segments and looks up the Hamming ball of radius 1 around each; of two segments
that differ in one bit only the one whose bit is clear looks up the other. Matches are verified over all 64 bits. A
segment value with more than ``HOT`` fingerprints is searched again inside, by the two 16-bit halves of the other
segment, so a bucket never holds more than 2**16 fingerprints; no match is dropped.

Groups: equal fingerprints first become one class (a combined aggregate), links are made between classes only, and
components come from alternating large-star and small-star passes over tables in the shared folder.

Null ``doc_id``: the row gets a fingerprint; its component is the smallest non-null id reachable, null if there is none.
Repeated rows give repeated result rows. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import TEXT_BYTES, forget, map_batches, written

SEED, SHINGLE, MAX_BITS, HOT = 42, 3, 3, 1024
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_OFFSETS = (256 * np.arange(8)).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 bytes, as a signed integer."""
    words = (text or b"").lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes (rows of 8 bytes, the highest first), as a signed integer."""
    counts = np.bincount((hashes + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, lambda c, _: {"id": c["id"], "fp": [fingerprint(t, shingle) for t in c["text"]]}, "id long, fp long", None, TEXT_BYTES)


def _split(rows: DataFrame, start: Column, width: int, number: str, value: str) -> DataFrame:
    """Each row twice: with the numbers and values of the two segments of ``width`` bits from bit ``start`` on."""
    both = rows.withColumn(number, F.explode(F.array(F.lit(0), F.lit(1))))
    shifted = F.call_function("shiftrightunsigned", F.col("fp"), (start + F.col(number) * width).cast("int"))
    return both.withColumn(value, shifted.bitwiseAND(F.lit((1 << width) - 1).cast("long")))


def _ball(value: Column, bits: int, flip: bool) -> Column:
    """The value and its neighbours at one bit: all of them, or those in which a clear bit is set."""

    def neighbour(i: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        return value.bitwiseXOR(bit) if flip else value.bitwiseOR(bit)

    return F.array_distinct(F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), neighbour)))


def _matches(stored: DataFrame, probes: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """Pairs with equal keys, verified over 64 bits; fingerprints with the same segment meet from one side only.

    Both sides are shuffled: Spark takes an exploded table to be as small as the one it came from and would broadcast the balls.
    """
    pairs = probes.withColumnRenamed("fp", "a").hint("merge").join(stored.withColumnRenamed("fp", "b"), keys)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.where(near & ((F.col("a") < F.col("b")) | ((F.col("a") != F.col("b")) & ~F.col("own")))).select("a", "b")


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(a, b): distinct pairs of different fingerprints at ``max_bits`` (3 at most) or fewer differing bits.

    ``fps`` has one column ``fp`` with distinct values, best a table on disk: it is read several times.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius 1 cover 3 differing bits at most")
    keys = ["no", "key"]
    stored = _split(fps, F.lit(0), 32, *keys)
    probes = stored.withColumn("own", F.explode(_ball(F.col("key"), 32, flip=False)))
    probes = probes.select("fp", "no", F.col("own").alias("key"), (F.col("own") == F.col("key")).alias("own"))
    crowded = written(fps.sparkSession, stored.groupBy(keys).count().where(F.col("count") > hot).select(keys), "simhash-crowded")
    if crowded.isEmpty():
        pairs = _matches(stored, probes, keys, max_bits)
    else:
        usual = _matches(stored.join(crowded, keys, "left_anti"), probes, keys, max_bits)
        # inside a crowded value the other 32 bits differ in 3 bits at most, so one of their halves in 1 at most
        other = (1 - F.col("no")) * 32
        inside = _split(stored.join(crowded, keys, "left_semi"), other, 16, "half", "part")
        around = _split(probes.join(crowded, keys, "left_semi"), other, 16, "half", "part").withColumn("part", F.explode(_ball(F.col("part"), 16, flip=True)))
        pairs = usual.unionByName(_matches(inside, around, [*keys, "half", "part"], max_bits))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges ``(a, b)``: root is the smallest node reachable.

    Every pass works with combined minima and joins on the node, never with a collected list of neighbours. Each pass that
    changes anything lowers some edge's end, so the passes come to an end; their number grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(spark, large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now, last = written(spark, small, "cc"), now
        forget(last, large)  # the new edges are a table of their own
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, root, component) for every row; see the module's docstring."""
    spark = docs.sparkSession
    rows = written(spark, fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    classes = written(spark, rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_bits))
    tied = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = tied.groupBy("root").agg(F.min("least").alias("component"))
    found = tied.join(least, "root").select("fp", "root", "component")
    return rows.join(found, "fp").select("id", "fp", "root", "component")


def hex64(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op10(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), hex64(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, search: Callable[[DataFrame], DataFrame] = near_duplicates, mark_of: Callable[[bytes | None], int] = fingerprint) -> DataFrame:
    """Keep one document of each group, all columns: the one with the smallest id.

    ``search`` gives (id, fp, root, component) of every row, ``mark_of`` a text's fp. Of repeated rows of that id one stays; a group without any non-null id keeps one of its rows.
    """
    spark, names = docs.sparkSession, docs.columns
    found = written(spark, search(docs), "simhash-found")
    stay = written(spark, found.where("id = component").groupBy("id").count(), "simhash-stay")
    ids = stay.select("id")
    kept = docs.join(ids, docs["doc_id"].cast("long") == ids["id"], "left_semi")
    if not stay.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    nameless = written(spark, found.where("component is null").select("root").distinct(), "simhash-nameless")
    if nameless.isEmpty():
        return kept.select(*names)
    # groups of null ids only: one row of each group, of its smallest fingerprint
    mark = "_".join(["fp", *names])  # a name that no column has
    first = nameless.select(F.col("root").alias(mark))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = map_batches(docs.where("doc_id is null"), lambda c, _: {**{n: c[n] for n in names}, mark: [mark_of(None if t is None else t.encode("utf-8", "surrogatepass")) for t in c["text"]]}, f"{shape}, `{mark}` long")
    return kept.select(*names).unionByName(marked.join(first, mark, "left_semi").dropDuplicates([mark]).select(*names))
