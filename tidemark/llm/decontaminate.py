"""Benchmark decontamination by latent semantic retrieval.

1. Words are lower-cased, stripped of the signs at their ends and numbered by a 32-bit hash. The benchmark's words are the features, at most
   ``FEATURES`` of them: a larger vocabulary shares features by its hash, which bounds every broadcast and every block below.
2. All documents are read once as numbers, in whole texts, into a written table. Document frequencies come from all of them.
3. A randomised SVD of the TF-IDF passages of all documents, the benchmark's items included, gives one latent basis for the
   whole benchmark: two passes of A'A times a block, added up by slices of features in a second stage.
4. Every whole document is read in overlapping windows of several sizes. Each window's latent vector is compared with all
   items near that size, in blocks; longer items are looked for by pieces.
5. Around each window of cosine ``COSINE`` or more the longest common subsequence with the item's words is taken, and its
   answer (an ``answer`` column, else its last words) is looked for in order. A document holds the item if the subsequence
   covers ``SURE`` of it, or ``LIKELY`` of it and half of the answer.

Items of fewer than ``LEAST_WORDS`` words are too short for a latent vector: they are looked up exactly, as words in a row.
Items without words (null and empty ones) are held by no document; null and empty texts hold nothing. The items are a table;
``BLOCK_ITEMS`` of them, pieces counted one by one, are broadcast at a time, so a larger benchmark takes more searches, not more memory. Null
ids stay null. Repeated documents give repeated rows; of repeated item ids the row with the smallest text counts. Empty
tables: empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, forget, map_batches, shared_dir, slices, written

RANK, PASSAGE_WORDS, FEATURES, BLOCK_ITEMS = 96, 48, 1 << 15, 4096
#: In the fit an item weighs as much as this many passages, squared, so that the basis tells items apart.
ITEM_WEIGHT = 6.0
COSINE, SURE, LIKELY, LEAST_WORDS = 0.65, 0.8, 0.6, 5
#: A window is three blocks of as many words, and one starts with every block. An item goes to the nearest window size. The
#: blocks of each row below are made from those before it, two by two. Items longer than the last size are looked for by
#: pieces, each of which points to the region of the whole item.
CHAINS = ((2, 4, 8, 16, 32, 64), (6, 12, 24, 48, 96))
SIZES = tuple(sorted(3 * block for chain in CHAINS for block in chain))
#: Bytes of text, words and features that are held as arrays at a time; low bits of a word's number in the feature table.
BATCH_BYTES, CHUNK_WORDS, SLICE, LOW_BITS = 2 << 20, 4096, 512, 22
#: Bytes of text that are numbered, and passages that are multiplied, at a time: so few that their arrays stay in a core's cache.
NUMBERED_BYTES, PASSAGES = 256 << 10, 32
#: Signs that are written in several ways, and the plain sign for each.
_SIGNS = {"«": '"', "»": '"', "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": ".", "¡": "!", "¿": "?"}
_TRANSLATED = str.maketrans(_SIGNS | dict.fromkeys("\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", " ") | {chr(c): " " for c in range(0x2000, 0x200B)})
_TO_TRANSLATE = re.compile("[" + "".join(map(chr, _TRANSLATED)) + "]")
#: Partitions whose sums a task adds up at most, and the number of blocks of sums from which on they are added in two steps.
GATHERED, FAN_IN = 8, 64
_SPACE, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: A byte counts times a power of an odd number by its place in the text; the inverse power takes the place out again.
_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)
_TIMES = np.uint64(_POWER)


@lru_cache(maxsize=2)  # the usual ones, and those of a text that is longer
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of ``_POWER`` and of its inverse, modulo 2**64."""
    out = []
    for base in (_POWER, _INVERSE):
        powers = np.ones(1 << bits, np.uint64)
        powers[1:] = base
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def _folded(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii() and _TO_TRANSLATE.search(text):
        text = text.translate(_TRANSLATED)
    return text.lower().encode("utf-8", "surrogatepass")


def number_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, lengths): the words of all texts one after the other, and how many each has.

    A word is what is left between white space without the signs at its ends; signs alone are no words.
    """
    numbers, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    some: list[bytes] = []
    size = 0
    for folded in map(_folded, texts):
        if size + len(folded) > NUMBERED_BYTES and some:
            for out, found in zip((numbers, lengths), _numbered(some), strict=True):
                out.append(found)
            some, size = [], 0
        some.append(folded)
        size += len(folded) + 1
    for out, found in zip((numbers, lengths), _numbered(some), strict=True):
        out.append(found)
    return np.concatenate(numbers), np.concatenate(lengths)


def _numbered(folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(folded), np.uint8)  # the space stands for a border
    space = _SPACE[data]
    core = np.flatnonzero(~(space | _SIGN[data]))
    if not len(core):
        return np.zeros(0, np.uint32), np.zeros(len(folded), np.int64)
    run = np.cumsum(space, dtype=np.int32)[core]
    change = np.flatnonzero(run[1:] != run[:-1])
    first, last = core[np.append(0, change + 1)], core[np.append(change, len(core) - 1)] + 1
    powers, inverse = _powers(max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    mixed = (sums[last] - sums[first]) * inverse[first]
    numbers = (((mixed ^ (mixed >> np.uint64(29))) * _TIMES) >> np.uint64(32)).astype(np.uint32)
    borders = np.cumsum([len(f) + 1 for f in folded])
    return numbers, np.diff(np.searchsorted(first, borders), prepend=0)


def numbered_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, numbers) of all documents, whole, written: the packed number of every word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(columns: dict[str, list], _: None) -> dict[str, object]:
        numbers, lengths = number_words(columns["text"])
        ends = np.append(0, np.cumsum(lengths) * 4).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(numbers.tobytes())])
        return {"doc_id": columns["doc_id"], "numbers": packed}

    return written(docs.sparkSession, map_batches(rows, run, "doc_id long, numbers binary", None, BATCH_BYTES), "lsa-documents")


class Features:
    """From word numbers to features, ``none`` for words that the benchmark lacks."""

    def __init__(self, used: np.ndarray):
        """``used``: the distinct numbers of the benchmark's words."""
        self.used, self.size = used, min(max(1, len(used)), FEATURES)
        self.none = self.size
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}  # made again where it is used

    def of(self, numbers: np.ndarray) -> np.ndarray:
        low = np.uint32((1 << LOW_BITS) - 1)
        if self.table is None:
            self.table = np.full(1 << LOW_BITS, self.none, np.int32)  # words that share the low bits share the feature
            self.table[self.used & low] = np.arange(len(self.used)) % FEATURES
        return self.table[numbers & low]


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(packed or b"", np.uint32) for packed in batch.column("numbers").to_pylist()]


def _added(numbered: DataFrame, make, kind: type, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all documents of what ``make(texts)`` gives: a matrix with a row a feature.

    Each task of the first stage adds up its own and emits it by slices of ``SLICE`` features; the second adds up each slice.
    The driver gets one row a slice, so as much as the matrix itself.
    """
    spark, (rows, width) = numbered.sparkSession, shape
    schema = "slice int, block binary"
    target = arrow_schema(spark, schema)

    def emitted(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([b.tobytes() for b in total.values()], pa.binary())], schema=target)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in slices(batches, most_bytes=BATCH_BYTES):
            total += make(_unpacked(batch))
        yield emitted({i: total[i * SLICE : (i + 1) * SLICE] for i in range(-(-rows // SLICE))})

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(packed, kind)
                total[i] = total[i] + part if i in total else part
        if total:
            yield emitted(total)

    # a task makes one block of sums, of up to GATHERED partitions where there are more of them than cores
    parts = numbered.rdd.getNumPartitions()
    wide = max(1, 2 * spark.sparkContext.defaultParallelism, -(-parts // GATHERED))
    sums = numbered.select("numbers").coalesce(wide).mapInArrow(first, schema)
    if wide > FAN_IN:  # summed in two steps, so that no task meets every block
        sums = sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(wide)))).repartition("slice", "part").drop("part").mapInArrow(second, schema)
    found = sums.repartition("slice").mapInArrow(second, schema).collect()
    out = np.zeros(shape, kind)
    for row in found:
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["block"], kind).reshape(-1, width)
    return out


def document_frequencies(numbered: DataFrame, features: Features) -> tuple[np.ndarray, int]:
    """In how many documents each feature stands, and how many documents there are; of all documents."""
    size = features.size

    def make(texts: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        cells = np.unique(owner * (size + 1) + features.of(np.concatenate(texts))) if texts else np.zeros(0, np.int64)
        counts = np.bincount(cells % (size + 1), minlength=size + 1)
        counts[size] = len(texts)
        return counts[:, None]

    counts = _added(numbered, make, np.int64, (size + 1, 1))[:, 0]
    return counts[:size], int(counts[size])


def _grams(texts: list[np.ndarray], weights: np.ndarray, block: np.ndarray, words: int) -> np.ndarray:
    """A'A times the block, of the texts' passages of so many words each, A being TF-IDF with rows of length 1."""
    out, size = np.zeros_like(block), len(block)
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return out
    begin = np.cumsum(-(-lengths // words)) - -(-lengths // words)  # each text's first passage
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    numbers, passages = np.concatenate(texts), np.repeat(begin, lengths) + place // words
    known = numbers < size
    numbers, passages = numbers[known].astype(np.int64), passages[known]
    column = np.zeros(size, np.int64)
    count = int(passages[-1]) + 1 if len(passages) else 0
    edges = np.searchsorted(passages, np.arange(0, count + PASSAGES, PASSAGES)).tolist()
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):  # few passages have few features: a small dense matrix
        if low == high:
            continue
        own = numbers[low:high]
        terms = np.flatnonzero(np.bincount(own, minlength=size))
        column[terms] = np.arange(len(terms))
        cells = (passages[low:high] - k * PASSAGES) * len(terms) + column[own]
        part = np.bincount(cells, minlength=PASSAGES * len(terms)).reshape(PASSAGES, -1) * weights[terms]
        part = (part / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-12)[:, None]).astype(block.dtype)
        out[terms] += part.T @ (part @ block[terms])
    return out


def latent_basis(numbered: DataFrame, features: Features, weights: np.ndarray, items: DataFrame | None, rank: int) -> np.ndarray:
    """(features, rank): leading right singular vectors of the TF-IDF passages, by randomised subspace iteration.

    The passages are those of all documents, and the items, each a passage of its own.
    """
    size = features.size
    rank = min(rank, size)

    def times(block: np.ndarray) -> np.ndarray:
        sent = numbered.sparkSession.sparkContext.broadcast(block.astype(np.float32))

        def of_documents(texts: list[np.ndarray]) -> np.ndarray:
            return _grams([*map(features.of, texts)], weights, sent.value, PASSAGE_WORDS)

        def of_items(texts: list[np.ndarray]) -> np.ndarray:
            return ITEM_WEIGHT**2 * _grams([*map(features.of, texts)], weights, sent.value, max(map(len, texts)))

        total = _added(numbered, of_documents, np.float32, block.shape).astype(float)
        if items is not None:
            total += _added(items, of_items, np.float32, block.shape)
        sent.destroy()
        return total

    block = np.random.default_rng(17).standard_normal((size, min(size, rank + 8)))
    basis = np.linalg.qr(times(block))[0]
    values, vectors = np.linalg.eigh(basis.T @ times(basis))
    return (basis @ vectors[:, np.argsort(-values)])[:, :rank]


def common_subsequence(item: list[int], region: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    return _common(_masks(item), len(item), region.tolist())


def _masks(item: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _common(masks: dict[int, int], size: int, region: list[int]) -> int:
    full = row = (1 << size) - 1
    for mask in map(masks.get, region):
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


class Item:
    """One item: its words' numbers, and those of its answer."""

    def __init__(self, item_id: int | None, numbers: np.ndarray, answer: np.ndarray):
        self.item_id, self.numbers, self.answer = item_id, numbers, answer

    def share(self, region: np.ndarray) -> float | None:
        """How much of the item the region holds in order; None if that is too little.

        Each word that the region lacks is lacking in any subsequence; where these are too many already, none is worked out.
        """
        size, words = len(self.numbers), region.tolist()
        if (size - len(self.masks.keys() - words)) / size < LIKELY:
            return None
        share = _common(self.masks, size, words) / size
        if share < LIKELY or share < SURE and 2 * _common(self.answer_masks, len(self.answer), words) < len(self.answer):
            return None
        return share

    def __getattr__(self, name: str) -> dict[int, int]:
        if name not in ("masks", "answer_masks"):
            raise AttributeError(name)
        found = self.__dict__[name] = _masks((self.numbers if name == "masks" else self.answer).tolist())
        return found

    def __getstate__(self) -> dict:
        return {"item_id": self.item_id, "numbers": self.numbers, "answer": self.answer}


def _row_keys(numbers: np.ndarray, words: int) -> np.ndarray:
    """A number for each run of so many words."""
    key = np.zeros(max(0, len(numbers) - words + 1), np.uint64)
    for i in range(words if len(key) else 0):
        key = (key + numbers[i : i + len(key)]) * _TIMES
    return key


class Searcher:
    """Some items: their vectors by window size, and the checks; broadcast as a whole."""

    def __init__(self, features: Features, vectors: np.ndarray, pieces: list[tuple[Item, int, int]], short: list[Item]):
        """``vectors``: of each feature, weighted; ``pieces``: (item, first word, last word)."""
        self.features, self.short = features, short
        self.vectors = np.vstack([vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)  # the last is that of other words
        #: (item, words of the region before and after a window)
        self.pieces = [(item, first + len(item.numbers) // 2 + 2, len(item.numbers) - last + len(item.numbers) // 2 + 2) for item, first, last in pieces]
        members: dict[int, list[int]] = {}
        for p, (_, first, last) in enumerate(pieces):
            members.setdefault(min(SIZES, key=lambda s, n=last - first: abs(math.log(s / n))) // 3, []).append(p)
        self.by_block: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # pieces and their unit vectors
        for block, own in members.items():
            z = np.stack([vectors[features.of(item.numbers[first:last])].sum(0) for item, first, last in (pieces[p] for p in own)])
            self.by_block[block] = np.array(own), np.ascontiguousarray((z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]).T, np.float32)

    def candidates(self, numbers: np.ndarray, lengths: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, ...]]:
        """(piece, text, first words, last words, cosines) of the windows like a piece; first and last are counted in the text."""
        features = self.features.of(numbers)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        for chain in CHAINS:
            used = [block for block in chain if block in self.by_block]
            if not used or not len(numbers):
                continue
            least, widest = used[0], used[-1]
            # every text begins with a block and ends with two empty ones, so that windows do not reach into the next text
            begins = np.cumsum(padded := (-(-lengths // widest) + 2) * widest) - padded
            laid = np.full(int(padded.sum()) + 2 * widest, self.features.none, np.int32)
            laid[begins[owner] + place] = features
            step = max(1, CHUNK_WORDS // widest) * widest
            held = np.empty((3, (step + 2 * widest) // least, self.vectors.shape[1]), np.float32)  # the same memory for every chunk
            for start in range(0, len(laid) - 2 * widest, step):
                words = laid[start : start + step + 2 * widest].reshape(-1, least).T
                sums, added, three = held[:, : words.shape[1]]
                self.vectors.take(words[0], axis=0, out=sums, mode="clip")
                for own in words[1:]:
                    sums += self.vectors.take(own, axis=0, out=added, mode="clip")
                block = least
                while True:
                    if block in self.by_block:
                        members, unit = self.by_block[block]
                        z = np.add(sums[:-2], sums[1:-1], out=three[: len(sums) - 2])
                        z += sums[2:]
                        z = z[: step // block]
                        norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-6)
                        products = z @ unit
                        window, member = np.divmod(np.flatnonzero(products >= (cosine * norms)[:, None]), len(members))
                        if len(window):
                            first = start + window * block
                            text = np.searchsorted(begins, first, side="right") - 1
                            near, first = products[window, member] / norms[window], first - begins[text]
                            kept = first < lengths[text]
                            yield tuple(x[kept] for x in (members[member], text, first, np.minimum(first + 3 * block, lengths[text]), near))
                    if block == widest:
                        break
                    sums, block = sums[0::2] + sums[1::2], block * 2

    def search(self, numbers: np.ndarray, lengths: np.ndarray, cosine: float = COSINE) -> dict[tuple[int, Item], tuple[float, float, int, int]]:
        """(share of the item, cosine, first word, last word) of the best place of each item in each text that holds it."""
        found: dict[tuple[int, Item], tuple[float, float, int, int]] = {}
        begins = np.cumsum(lengths) - lengths
        for some in self.candidates(numbers, lengths, cosine):
            order = np.argsort(-some[4], kind="stable")
            for piece, text, first, last, near in zip(*(x[order].tolist() for x in some), strict=True):
                item, left, right = self.pieces[piece]
                best = found.get((text, item))
                if best and best[0] == 1.0:
                    continue
                begin = int(begins[text])
                share = item.share(numbers[begin + max(0, first - left) : begin + min(int(lengths[text]), last + right)])
                if share is not None and (best is None or (share, near) > best[:2]):
                    found[text, item] = (share, near, first, last)
        for item in self.short:
            words = len(item.numbers)
            for place in np.flatnonzero(_row_keys(numbers, words) == _row_keys(item.numbers, words)[0]).tolist():
                text = int(np.searchsorted(begins, place, side="right")) - 1
                if place + words <= begins[text] + lengths[text] and (numbers[place : place + words] == item.numbers).all():
                    found.setdefault((text, item), (1.0, 1.0, place - int(begins[text]), place - int(begins[text]) + words))
        return found


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, numbers, answer): the items that have words, written; an item's row is the one with the smallest text."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.struct(F.col("text").cast("string").alias("text"), answer.alias("answer")).alias("row"))
    once = rows.where("row.text is not null").groupBy("item_id").agg(F.min("row").alias("row")).select("item_id", "row.text", "row.answer")

    def run(columns: dict[str, list], _: None) -> dict[str, list]:
        out: dict[str, list] = {"item_id": [], "numbers": [], "answer": []}
        for i, text, given in zip(columns["item_id"], columns["text"], columns["answer"], strict=True):
            numbers = number_words([text])[0]
            if len(numbers):
                own = number_words([given])[0]
                out["item_id"].append(i)
                out["numbers"].append(numbers.tobytes())
                out["answer"].append((own if len(own) else numbers[-max(3, len(numbers) // 5) :]).tobytes())
        return out

    return written(benchmark.sparkSession, map_batches(once, run, "item_id long, numbers binary, answer binary"), "lsa-items")


def _searchers(numbered: DataFrame, items: DataFrame, rank: int, block_items: int) -> Iterator[Searcher]:
    """One fit, then the items block by block."""
    each = map_batches(items.select("numbers"), lambda c, _: {"word": np.unique(np.frombuffer(b"".join(c["numbers"]), np.uint32)).astype(np.int64).tolist()}, "word long")
    used = np.array(sorted(r[0] for r in each.distinct().collect()), np.uint32)  # the driver holds the benchmark's distinct words only
    if not len(used):
        return
    features = Features(used)
    frequencies, documents = document_frequencies(numbered, features)
    weights = np.log((documents + 1) / (frequencies + 1.0)) ** 2 + 1e-3  # squared: common words say little here
    vectors = latent_basis(numbered, features, weights, items, rank) * weights[:, None]
    in_order = items.orderBy(F.col("item_id").asc_nulls_last())
    pieces, short = [], []
    for row in in_order.toLocalIterator():
        item = Item(row["item_id"], np.frombuffer(row["numbers"], np.uint32), np.frombuffer(row["answer"], np.uint32))
        words = len(item.numbers)
        count = -(-words // SIZES[-1])
        if words < LEAST_WORDS:
            short.append(item)
        else:
            pieces += [(item, words * j // count, words * (j + 1) // count) for j in range(count)]
        if len(pieces) + len(short) >= block_items:
            yield Searcher(features, vectors, pieces, short)
            pieces, short = [], []
    if pieces or short:
        yield Searcher(features, vectors, pieces, short)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, share, cosine, first_word, last_word): each item that a document holds, at its best place."""
    spark = docs.sparkSession
    names = ("doc_id", "item_id", "share", "cosine", "first_word", "last_word")
    schema = "doc_id long, item_id long, share double, cosine double, first_word int, last_word int"
    numbered, items, parts = numbered_documents(docs), benchmark_items(benchmark), []
    for searcher in _searchers(numbered, items, rank, block_items):
        sent = spark.sparkContext.broadcast(searcher)
        target = arrow_schema(spark, schema)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, target=target) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most_bytes=BATCH_BYTES):
                texts, ids = _unpacked(batch), batch.column("doc_id").to_pylist()
                found = sent.value.search(np.concatenate(texts), np.array([*map(len, texts)], np.int64))
                rows = sorted(((text, item.item_id is None, item.item_id or 0), (ids[text], item.item_id, *place)) for (text, item), place in found.items())
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for _, row in rows], schema=target)

        path = shared_dir(spark, "lsa-leaks")
        numbered.mapInArrow(run, schema).write.parquet(path)
        sent.destroy()
        parts.append(spark.read.schema(schema).parquet(path))
    forget(numbered, items)  # what was found is in tables of its own
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    spark = docs.sparkSession
    blocks, numbered, items = 0, numbered_documents(docs), benchmark_items(benchmark)
    for searcher in _searchers(numbered, items, rank, block_items):
        if blocks:  # one block after the other: what is left after the last one is written, so that it can be let go
            docs = written(spark, docs, "lsa-clean")
            sent.destroy()
        blocks += 1
        sent = spark.sparkContext.broadcast(searcher)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most_bytes=BATCH_BYTES):
                numbers, lengths = number_words(batch.column("text").to_pylist())
                clean = np.ones(batch.num_rows, bool)
                clean[[text for text, _ in sent.value.search(numbers, lengths)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    forget(numbered, items)  # the searchers hold what the search needs
    return docs
