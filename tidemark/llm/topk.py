"""Exact top-k by inner product over a pivot-distance index.

Vectors become integers: floor(256 * x). One more coordinate, sqrt(M - |x|^2) with M the largest squared norm, puts them
on a sphere, where the nearest neighbours of a query are the rows with its largest inner products. Every vector is keyed
by its nearest pivot and its distance to it. Pivots grow with the square root of the rows up to ``PIVOTS``; an annulus is a
range of one pivot's distances of about ``ANNULUS_ROWS`` rows, up to ``ANNULI`` of them a pivot, so the index's summary has at most
PIVOTS * ANNULI rows, whatever the table's size. An annulus is stored as blocks of up to ``BLOCK_ROWS`` rows; one that holds
more (a vector that many rows share, a crowded pivot) fills several, which different tasks pack.

Search in two expansions. First each query visits the annuli with the smallest lower bounds until they hold ``FIRST_ROWS``
candidates; the k-th score found bounds its distance. Then it visits exactly those further annuli whose triangle-inequality
lower bound is within that distance, and stops: nothing else can hold a better row or a tie. Queries of near pivots are packed
into blocks of up to ``QUERY_ROWS`` before they visit, so work is matrix products between bounded blocks, and vectors are packed in as few
bytes as all of them fit. Query blocks and annuli are joined by a shuffle: Spark takes visits to be as few as their queries and would
broadcast them. An annulus of more than ``CHUNK`` blocks is joined in chunks of so many.

Pivots come from a bounded sample of ``PIVOT_SAMPLE`` rows with the smallest seeded hashes, of which the driver gets about twice as
many however many tasks there are; every row is indexed. The
result is exact whatever the pivots are. How much is visited depends on the data: see ``visited_share``.

Vectors that are null or hold null or non-finite components take no part, neither do rows with a null id, nor vectors with a
component of ``MOST`` or more in size, whose integers fit no long. Products are exact whatever their size; one of the k best
that fits no long is an error. Shorter vectors count as ending in zeros. Every
row is a candidate of every query but its own, rows that repeat an id too, and each row of a repeated id is a query of its
own. Ties go to the smaller id. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import arrow_schema, slices, written

SCALE, K, PIVOTS, ANNULI, ANNULUS_ROWS, PIVOT_SAMPLE = 256, 5, 1024, 256, 1024, 4096
FIRST_ROWS, BLOCK_ROWS, QUERY_ROWS, CHUNK, PACKED_BYTES, MOST = 64, 512, 256, 4, 1 << 22, 2.0**54
_PACKED = "ids binary, rows binary, vectors binary"


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<long>): the vectors that take part."""
    fit = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < MOST))
    usable = F.when(F.coalesce(fit, F.lit(False)), F.col(vector_col))  # no cast meets a value that is too large
    whole = F.transform(usable, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).where("v is not null")


def _matrix(vectors: pa.Array | list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """On the sphere of squared radius ``most``."""
    norms = np.einsum("ij,ij->i", x.astype(float), x.astype(float))
    return np.hstack([x, np.sqrt(np.maximum(most - norms, 0.0))[:, None]])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0.0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample row farthest from those before."""
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where every sum fits its 53 bits."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * x.shape[1]
    if most < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T if most < 2**63 else np.array(x.astype(object) @ y.astype(object).T)


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best in this block, ties to smaller ids, never the query's own row."""
    n = min(k + 1, scores.shape[1])
    order = np.argsort(ids, kind="stable")
    ids, rows, scores = ids[order], rows[order], scores[:, order]
    cut = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
    query, column = np.nonzero(scores >= cut[:, None])
    keep = rows[column] != own[query]
    query, column = query[keep], column[keep]
    value = scores[query, column]
    sort = np.lexsort((ids[column], -value, query))
    query, column, value = query[sort], column[sort], value[sort]
    keep = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return query[keep], ids[column[keep]], value[keep]


def _blocks(rows: DataFrame, by: list[str], size: int, width: int, kind: type) -> DataFrame:
    """Rows (by..., id, row, v) as packed blocks of up to ``size`` rows (by..., ids, rows, vectors)."""
    names = ", ".join(f"{c} int" for c in by)
    target = arrow_schema(rows.sparkSession, f"{names}, {_PACKED}")

    def packed(key: tuple, ids: list, numbers: list, vectors: list) -> pa.RecordBatch:
        row = dict(zip(by, key, strict=True)) | {"ids": np.array(ids, np.int64).tobytes(), "rows": np.array(numbers, np.int64).tobytes(), "vectors": _matrix(vectors, width).astype(kind).tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [])
        for batch in slices(batches):
            for *key, i, r, v in zip(*(batch.column(c).to_pylist() for c in [*by, "id", "row", "v"]), strict=True):
                if held[0] and (key != last or len(held[0]) >= size):
                    yield packed(last, *held)
                    held = ([], [], [])
                last = key
                for values, value in zip(held, (i, r, v), strict=True):
                    values.append(value)
        if held[0]:
            yield packed(last, *held)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"{names}, {_PACKED}")


def _search(pairs: DataFrame, width: int, kind: type, k: int) -> DataFrame:
    """Block pairs to (query_row, query_id, vec_id, score): each query's k best of the block."""
    schema = "query_row long, query_id long, vec_id long, score long"
    target = arrow_schema(pairs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            query_ids, own, ids, rows = (np.frombuffer(batch.column(c)[0].as_py(), np.int64) for c in ("query_ids", "query_rows", "ids", "rows"))
            queries, vectors = (np.frombuffer(batch.column(c)[0].as_py(), kind).reshape(-1, width).astype(np.int64) for c in ("queries", "vectors"))
            query, found, value = _best(products(queries, vectors), ids, rows, own, k)
            if value.dtype == object and any(not -(2**63) <= v < 2**63 for v in value):
                raise ValueError("a score fits no long")
            yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(query_ids[query]), pa.array(found), pa.array(value.astype(np.int64))], schema=target)

    return pairs.mapInArrow(run, schema)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row, ranked: it has at most k rows for each block it met."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def squared(column: str = "v") -> Column:
    return F.aggregate(column, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))


class Index:
    """The written rows (id, v, row, pivot, distance), and on the driver the pivots and the bounded summary of the annuli."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, annulus_rows: int = ANNULUS_ROWS, sample_rows: int = PIVOT_SAMPLE):
        spark = vectors.sparkSession
        rows = written(spark, vectors.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
        self.count, self.most, width = rows.agg(F.count("*"), F.max(squared()), F.max(F.size("v"))).first()
        if not self.count:
            return
        self.width = width = max(width, 1)
        most = self.most
        self.kind = np.int16 if most < 2.0**29 else np.int32 if most < 2.0**61 else np.int64  # no component is larger than the square root
        sample = self.sample(rows, sample_rows).collect()
        self.centres = centres = choose_pivots(_lifted(_matrix([r["v"] for r in sample], width), most), max(1, min(pivots, math.isqrt(self.count) // 4 + 1)))
        schema = "id long, v array<long>, row long, pivot int, distance double"
        target = arrow_schema(spark, schema)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 2048):
                far = _distances(_lifted(_matrix(batch.column("v").to_pylist(), width), most), centres)
                nearest = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "row")), pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(far)), nearest])], schema=target)

        self.rows = written(spark, rows.mapInArrow(keyed, schema), "topk-index")
        shares = F.percentile_approx("distance", [i / ANNULI for i in range(1, ANNULI)], 2000)
        self.edges = [np.zeros(0)] * len(centres)  # of each pivot's annuli, at most PIVOTS * ANNULI numbers
        for r in self.rows.groupBy("pivot").agg(F.count("*").alias("n"), shares.alias("at")).collect():
            annuli = max(1, min(ANNULI, -(-r["n"] // annulus_rows)))
            self.edges[r["pivot"]] = np.array([r["at"][ANNULI * i // annuli - 1] for i in range(1, annuli)])
        edges = self.edges
        spread = "cell int, id long, row long, v array<long>, distance double"
        cells = arrow_schema(spark, spread)

        def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pivot, distance = batch.column("pivot").to_numpy(), batch.column("distance").to_numpy()
                ring = np.array([np.searchsorted(edges[p], d, side="right") for p, d in zip(pivot.tolist(), distance.tolist(), strict=True)], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pivot * ANNULI + ring, pa.int32()), *(batch.column(c) for c in ("id", "row", "v", "distance"))], schema=cells)

        self.ringed = self.rows.mapInArrow(ringed, spread)
        summary = self.ringed.groupBy("cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
        held = sorted(tuple(r) for r in summary.collect())  # at most PIVOTS * ANNULI rows
        self.cells, self.lows, self.highs, self.counts = (np.array(c) for c in zip(*held, strict=True))

    def sample(self, rows: DataFrame, most: int) -> DataFrame:
        """The ``most`` rows with the smallest seeded hashes.

        Each task sends the driver as many rows as it has up to ``most``; so only rows of the lowest hashes, twice as many as wanted, are sorted.
        """
        mark = F.xxhash64(F.lit(7), "id", "row")
        low = rows if self.count <= 2 * most else rows.where(mark < -(2**63) + 2**64 * 2 * most // self.count)
        return low.orderBy(mark, "row").limit(most)

    def parts(self) -> np.ndarray:
        """Of each annulus: the blocks that it needs."""
        return np.maximum(1, -(-self.counts // BLOCK_ROWS))

    def blocks(self) -> DataFrame:
        """The annuli as packed blocks (cell, chunk, ids, rows, vectors); the rows of one annulus are dealt to as many tasks as it needs blocks."""
        cells = self.ringed.sparkSession.createDataFrame([(int(c), int(n)) for c, n in zip(self.cells, self.parts(), strict=True)], "cell int, parts int")
        part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
        dealt = self.ringed.join(F.broadcast(cells), "cell").select("cell", part.alias("part"), "id", "row", "v")  # as bounded as the summary
        packed = _blocks(dealt, ["cell", "part"], BLOCK_ROWS, self.width, self.kind)
        return written(cells.sparkSession, packed.select("cell", F.expr(f"int(part div {CHUNK})").alias("chunk"), "ids", "rows", "vectors"), "topk-blocks")

    def visits(self, asked: DataFrame, k: int, first: bool) -> DataFrame:
        """(cell, chunk, query_ids, query_rows, queries): a block of queries for each annulus that some of it visit, and each of its chunks.

        A query visits the annuli nearest at first, then those within its ``reach``.
        """
        cells, lows, highs, counts, centres, width, kind = self.cells, self.lows, self.highs, self.counts, self.centres, self.width, self.kind
        chunks, step = -(-self.parts() // CHUNK), max(1, (1 << 20) // len(cells))
        of, slack, enough = cells // ANNULI, 1e-6 * (math.sqrt(self.most) + 1), max(k + 1, FIRST_ROWS)  # slack: rounding of distances
        schema = "cell int, chunk int, query_ids binary, query_rows binary, queries binary"
        target = arrow_schema(asked.sparkSession, schema)

        def visited(x: np.ndarray, reach: np.ndarray) -> np.ndarray:
            far = _distances(np.hstack([x, np.zeros((len(x), 1))]), centres)[:, of]
            low = np.maximum(np.maximum(lows - far, far - highs), 0.0) - slack  # on the distance to any row of the annulus
            order = np.argsort(low, axis=1, kind="stable")
            before = np.cumsum(counts[order], axis=1) - counts[order]
            wanted = np.zeros(low.shape, bool)
            np.put_along_axis(wanted, order, before < enough, axis=1)
            return wanted if first else ~wanted & (low <= reach[:, None])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in slices(batches, QUERY_ROWS):
                x = _matrix(batch.column("v").to_pylist(), width)
                reach = np.array([np.inf if r is None else r for r in ([None] * len(x) if first else batch.column("reach").to_pylist())])
                wanted = np.vstack([visited(x[i : i + step], reach[i : i + step]) for i in range(0, len(x), step)])
                columns = [batch.column(c).to_numpy() for c in ("id", "row")] + [x.astype(kind)]
                for cell in np.flatnonzero(wanted.any(axis=0)).tolist():
                    block = [c[wanted[:, cell]].tobytes() for c in columns]
                    yield from ((cells[cell], chunk, *block) for chunk in range(chunks[cell]))

        def gathered(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for row in rows(batches):
                held.append(row)
                size += sum(map(len, row[2:]))
                if size >= PACKED_BYTES:
                    yield gathered(held)
                    held, size = [], 0
            if held:
                yield gathered(held)

        return asked.sortWithinPartitions("pivot", "distance").mapInArrow(run, schema)

    def queries(self, every: int) -> DataFrame:
        return self.rows.where(F.col("id") % every == 0)

    def with_reach(self, queries: DataFrame, near: DataFrame, k: int) -> DataFrame:
        """Queries with the distance of their k-th score so far; null where there are fewer."""
        worst = near.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        # a query's own last coordinate is 0, so its squared distance to a lifted row x is |q|^2 + M - 2 q.x
        reach = F.sqrt(F.greatest(squared() + F.lit(float(self.most)) - 2 * F.col("least").cast("double"), F.lit(0.0)))
        return queries.join(worst, F.col("row") == F.col("query_row"), "left").select("id", "row", "v", "pivot", "distance", reach.alias("reach"))


def _expand(index: Index, blocks: DataFrame, asked: DataFrame, k: int, first: bool) -> DataFrame:
    return _search(index.visits(asked, k, first).hint("merge").join(blocks, ["cell", "chunk"]), index.width, index.kind, k)


def top_k(vectors: DataFrame, every: int, k: int = K, **options: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (id, v) whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    index = Index(vectors, **options)
    if not index.count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, queries = index.blocks(), written(spark, index.queries(every), "topk-queries")
    near = written(spark, _merged(_expand(index, blocks, queries, k, True), k).drop("rank"), "topk-near")
    further = _expand(index, blocks, index.with_reach(queries, near, k), k, False)
    return _merged(near.unionByName(further), k).select("query_id", "rank", "vec_id", "score")


def visited_share(vectors: DataFrame, every: int, k: int = K, **options: int) -> float:
    """The share of all (query, row) pairs whose score the search computes; 1 is brute force."""
    index = Index(vectors, **options)
    queries = index.queries(every) if index.count else None
    total = queries.count() * index.count if queries else 0
    if not total:
        return 0.0
    blocks, sizes = index.blocks(), dict(zip(index.cells.tolist(), index.counts.tolist(), strict=True))
    near = written(vectors.sparkSession, _merged(_expand(index, blocks, queries, k, True), k), "topk-near")
    met = [index.visits(queries, k, True), index.visits(index.with_reach(queries, near, k), k, False)]
    visits = (m.where("chunk = 0").groupBy("cell").agg(F.sum(F.octet_length("query_ids") / 8).alias("n")) for m in met)
    return sum(r["n"] * sizes[r["cell"]] for m in visits for r in m.collect()) / total


def op6(embeddings: DataFrame) -> DataFrame:
    return top_k(integer_vectors(embeddings), every=50)


ORACLE_SQL = """
with v as (
  select vec_id, row_number() over (order by vec_id) as own, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, q.own, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and c.own <> q.own
), ranked as (
  select query_id, cast(row_number() over (partition by own order by score desc, vec_id) as integer) as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
