"""Substring de-duplication by seed and extend: word sequences that a document with a smaller id also has are found and removed.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``length`` consecutive words of one document; it is a repeat if its
words also stand in a document with a smaller id. Overlapping and adjacent repeats make maximal ones, which are removed.

Seed: every window selects the ``GRAM``-word gram in it whose hash is least (winnowing), so equal windows select equal grams
at the same place. Consecutive windows that select the same gram make one row (anchor, context, document, place), where the
context is a hash of all the words of these windows: about one row for each five words.

Extend: the rows of an anchor are joined by being dealt out together. Where a row's whole context, all that the anchor's windows
reach both ways, also stands in a smaller document, all its windows are repeats: no pair is made, each context only keeps its
smallest document. What is left open are the smallest documents of anchors that have several contexts, where a repeat may
begin or end: there each window, that is each way to split the reach between the two sides, is a key of its own (128 bits),
and the smallest document of each key decides. Anchors that stand in one document only go no further.

Anchors that a bounded sample of the documents (``SAMPLE_ROWS``) shows to be frequent are dealt out over ``SALTS`` tasks. The smallest
documents of their contexts are then the smallest in a task; they all stay open, and so are settled by the second step. The sample
changes where rows go and never the result.

Windows are judged on the documents as they are given. Null text: no words. Null id: neither removed from nor a source. Repeated
ids: none is smaller than the other; texts of one id are told apart by a 64-bit hash. Fewer words than a window: nothing is
removed. Empty table: empty result. Other columns are not read. A text's words are held while it is looked at.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import TEXT_BYTES, forget, map_batches, written

LENGTH, GRAM = 13, 5
SAMPLE_ROWS, HOT_SHARE, MOST_HOT, SALTS = 10_000, 500, 4096, 64
#: A place and a number of windows in one long; contexts of salted anchors are marked as such.
PLACES, SALTED = 1 << 12, 1 << 60
_RANDOM = np.random.default_rng(20_240_613).integers(0, 2**64, 8, np.uint64) | np.uint64(1)
_STEP, _BACK = ([int(x) for x in _RANDOM[:2]], [pow(int(x), -1, 2**64) for x in _RANDOM[:2]])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes: ASCII white space only


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _RANDOM[2]
    return x ^ (x >> np.uint64(29))


def hashed(texts: list[list[bytes]]) -> np.ndarray:
    """Two hashes of every word of the texts, one row each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(texts))), np.uint64).reshape(-1, 2)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def sequences(words: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A hash of each sequence of words, by sums along the text: it depends on the words and their order alone."""
    along = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_STEP[which], len(words))[:-1], out=along[1:], dtype=np.uint64)
    return _mixed((along[end] - along[begin]) * _powers(_BACK[which], len(words))[begin])


def seeds(texts: list[list[bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, windows, anchor, context) of the texts' anchors, as arrays."""
    counts = np.array([*map(len, texts)], np.int64)
    words, n = hashed(texts), int(counts.sum())
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    of = np.repeat(np.arange(len(texts)), counts)
    grams = n - gram + 1
    hashes = sequences(words[:, 0], np.arange(grams), np.arange(gram, n + 1), 0)
    span = length - gram + 1
    chosen = np.arange(n - length + 1) + np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(1)
    whole = of[: n - length + 1] == of[length - 1 :]
    same = np.zeros(len(chosen) + 1, bool)  # whether a window goes on with the anchor of the one before
    same[1:-1] = (chosen[1:] == chosen[:-1]) & whole[1:] & whole[:-1]
    first = np.flatnonzero(whole & ~same[:-1])
    last = np.flatnonzero(whole & ~same[1:])
    context = sequences(words[:, 1], first, last + length, 1)
    begins = np.cumsum(counts) - counts
    text = of[first]
    return text, first - begins[text], last - first + 1, hashes[chosen[first]], _mixed(context + (last - first).astype(np.uint64))


def window_keys(words: list[bytes], places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the windows at the places."""
    found = hashed([words])
    return tuple(sequences(found[:, i], places, places + length, i) for i in (0, 1))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, context, doc, mark, at) of the rows (doc, mark, text)."""

    def emitted(columns: dict[str, list], _: None) -> dict[str, list]:
        import pyarrow as pa

        text, place, windows, anchor, context = seeds([*map(words_of, columns["text"])], length, gram)
        doc, mark = (np.array(columns[c], np.int64)[text] for c in ("doc", "mark"))
        return {k: pa.array(v) for k, v in (("anchor", _signed(anchor)), ("context", _signed(context)), ("doc", doc), ("mark", mark), ("at", place * PLACES + windows))}

    return map_batches(rows, emitted, "anchor long, context long, doc long, mark long, at long", None, TEXT_BYTES)


def frequent(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor): at most ``MOST_HOT`` anchors that are frequent in a sample of ``SAMPLE_ROWS`` rows."""
    n = rows.count()
    sample = rows.sample(min(1.0, SAMPLE_ROWS / max(n, 1)), seed=1)
    counts = anchors(sample, length, gram).groupBy("anchor").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= max(20, min(n, SAMPLE_ROWS) // HOT_SHARE)).orderBy(F.desc("n"), "anchor").limit(MOST_HOT).select("anchor")


def first_step(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, mark, at, covered): contexts that are repeats as a whole, and those left open; see the module's docstring."""
    spark = rows.sparkSession
    hot = written(spark, frequent(rows, length, gram), "repeats-frequent")
    found = anchors(rows, length, gram).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "anchor", "left")
    salted = F.xxhash64("anchor", F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)))
    found = found.select(F.when(F.col("hot"), salted).otherwise(F.col("anchor")).alias("anchor"), "context", "doc", "mark", F.when(F.col("hot"), F.col("at") + SALTED).otherwise(F.col("at")).alias("at"))
    alike, together = Window.partitionBy("anchor", "context"), Window.partitionBy("anchor")
    dealt = found.repartition("anchor").withColumn("least", F.min("doc").over(alike))
    dealt = dealt.withColumns({"several": F.min("context").over(together) != F.max("context").over(together), "shared": F.min("doc").over(together) != F.max("doc").over(together)})
    covered, salt = F.col("doc") > F.col("least"), F.col("at") >= SALTED
    kept = dealt.where(covered | salt | (F.col("several") & F.col("shared")))
    out = written(spark, kept.select("doc", "mark", F.when(salt, F.col("at") - SALTED).otherwise(F.col("at")).alias("at"), covered.alias("covered")), "repeats-contexts")
    forget(hot)
    return out


def by_text(found: DataFrame, name: str) -> DataFrame:
    """(doc, mark, name): what was found in each text; a text's own places only."""
    return found.groupBy("doc", "mark").agg(F.collect_set("at").alias(name))


def second_step(rows: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """(doc, mark, at): the open windows that are repeats."""
    spark = rows.sparkSession

    def emitted(columns: dict[str, list], _: None) -> dict[str, list]:
        import pyarrow as pa

        parts = []
        for doc, mark, text, open_ in zip(*(columns[c] for c in ("doc", "mark", "text", "open")), strict=True):
            places = spread(np.array(open_, np.int64))
            parts.append((*map(_signed, window_keys(words_of(text), places, length)), np.full(len(places), doc), np.full(len(places), mark), places * PLACES + 1))
        return {c: pa.array(np.concatenate(v) if parts else []) for c, v in zip(("k1", "k2", "doc", "mark", "at"), zip(*parts, strict=True) if parts else [()] * 5, strict=True)}

    texts = rows.join(by_text(opened, "open"), ["doc", "mark"])
    windows = written(spark, map_batches(texts.select("doc", "mark", "text", "open"), emitted, "k1 long, k2 long, doc long, mark long, at long", None, TEXT_BYTES), "repeats-windows")
    least = windows.groupBy("k1", "k2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    out = written(spark, windows.join(least, ["k1", "k2"]).where("doc > least").select("doc", "mark", "at"), "repeats-single")
    forget(windows)
    return out


def spread(packed: np.ndarray) -> np.ndarray:
    """All places of (place, number of windows) in one long each, sorted."""
    packed = np.sort(packed)
    begin, n = packed // PLACES, packed % PLACES
    return np.unique(np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def maximal(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The spans of words that windows at these sorted places cover, as far as they go."""
    if not len(places):
        return []
    cut = np.flatnonzero(places[1:] > places[:-1] + length)
    begins, ends = places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])] + length
    return [*zip(begins.tolist(), ends.tolist(), strict=True)]


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, text) of every row: its maximal repeats as (begin, end) in words, and the words that are left, space-joined."""
    gram = min(GRAM, length) if gram is None else gram
    if not 1 <= gram <= length < PLACES:
        raise ValueError(f"a gram of 1 to {length} words, a length under {PLACES}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    repeated = not rows.groupBy("doc").count().where("doc is not null and count > 1").isEmpty()
    rows = rows.withColumn("mark", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    named = rows.where("doc is not null")
    contexts = first_step(named, length, gram)
    single = second_step(named, contexts.where(~F.col("covered")), length)
    places = contexts.where("covered").select("doc", "mark", "at").unionByName(single)
    whole = rows.join(by_text(places, "covered"), ["doc", "mark"], "left").select("doc", "text", "covered")

    def cut(columns: dict[str, list], _: None) -> dict[str, list]:
        out = {"doc_id": columns["doc"], "n_words": [], "spans": [], "text": []}
        for text, covered in zip(columns["text"], columns["covered"], strict=True):
            words = words_of(text)
            spans = maximal(spread(np.array(covered or [], np.int64)), length)
            bounds = [0, *chain.from_iterable(spans), len(words)]
            out["n_words"].append(len(words))
            out["spans"].append([{"begin": b, "end": e} for b, e in spans])
            out["text"].append(b" ".join(chain.from_iterable(words[b:e] for b, e in zip(bounds[::2], bounds[1::2], strict=True))))
        return out

    return map_batches(whole, cut, "doc_id long, n_words long, spans array<struct<begin:long,end:long>>, text binary", None, TEXT_BYTES)


def removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) of every row without its repeats."""
    return find_repeats(docs, length).select("doc_id", F.col("text").cast("string").alias("text"))


def op11(docs: DataFrame) -> DataFrame:
    found = find_repeats(docs)
    return found.select("doc_id", "n_words", removed(F.col("spans")).alias("n_removed"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, row_number() over () as r from documents),
g as (select r, doc_id, unnest(range(1, len(w) - {LENGTH - 2})) as i, w from d where len(w) >= {LENGTH}),
k as (select r, doc_id, i, array_to_string(w[i:i + {LENGTH - 1}], ' ') as k from g),
m as (select k, min(doc_id) as least from k group by k),
c as (select distinct r, unnest(range(i, i + {LENGTH})) as i from k join m using (k) where k.doc_id > least),
gone as (select r, list(i) as places from c group by r),
o as (select d.*, coalesce(places, []) as places from d left join gone using (r))
select doc_id, len(w)::bigint as n_words, len(places)::bigint as n_removed, sha256(array_to_string(w_left, ' ')) as kept_sha256
from (select *, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(places, x[2])), lambda x: x[1]) as w_left from o)"""
