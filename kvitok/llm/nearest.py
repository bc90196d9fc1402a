"""Exact top-k inner products by best-first search in a paged M-tree.

Metric. With M the greatest norm, a vector x stands at (x, sqrt(M^2 - |x|^2)) and a query q at (q, 0); then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the greatest inner products are the nearest vectors, and bounds of
the triangle inequality hold. Scores themselves are computed on integers; bounds have some slack.

Tree. The root holds at most ``PIVOTS`` routing vectors with covering radii. Each vector goes to its
nearest one. A routing vector's rows are dealt over pages of about ``PAGE_ROWS`` rows by a hash of their
ids, so copies of one vector fill pages and not a task. A page is a node of leaves: leaf pivots with
covering radii and their distance to the parent pivot, and entries with their distance to the leaf's.

Search. Each query first searches one page of its nearest routing vector, which gives a score that its
k-th best cannot fall below. Then it goes to the pages whose bound reaches that score, together with up to
``QUERY_ROWS`` other queries, as often as blocks of queries need the page. In a page every query visits leaves from
its best bound on, in waves that all queries of the block take together, until no bound reaches its
k-th best. Bounds from stored parent distances come first and need no distance; leaves and entries
that they exclude are not computed.

Vectors that are null, empty, or hold null or non-finite components take no part, nor rows of a null id. Shorter
vectors are filled up with zeros. Of rows that repeat an id the one of the smallest vector counts. Ties
go to the smaller id. Components beyond 2**20 can leave 64-bit integers. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvitok.llm.common import small_batches, stored, table

PIVOTS, PAGE_ROWS, QUERY_ROWS = 32, 4096, 4096
#: Bounds give way by so much, relative to the greatest norm, for rounding.
SLACK = 1e-6
#: Above this the place of an id does not fit beside a score in 64 bits.
_FITS = 1 << 42


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def placed(x: np.ndarray, norm2: float) -> np.ndarray:
    """Where vectors stand in the metric space."""
    x = x.astype(np.float64)
    return np.concatenate((x, np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(axis=1)))[:, None]), axis=1)


def asked(q: np.ndarray) -> np.ndarray:
    return np.concatenate((q.astype(np.float64), np.zeros((len(q), 1))), axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query so far; ids are places in one sorted list."""

    def __init__(self, queries: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach to matter."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, barred: np.ndarray) -> None:
        scores = np.where(barred, np.iinfo(np.int64).min, scores)
        worth = (scores >= self.kth(rows)[:, None]) & ~barred
        some = worth.any(axis=1)
        if not some.any():
            return
        rows, scores = rows[some], np.where(worth[some], scores[some], np.iinfo(np.int64).min)
        k = min(self.k, scores.shape[1])
        # ids rise along the columns, so a stable sort leaves ties with the smaller id first.
        if np.abs(scores[scores > np.iinfo(np.int64).min]).max(initial=0) < _FITS and scores.shape[1] < 1 << 20:
            merged = np.where(scores == np.iinfo(np.int64).min, scores, scores * (1 << 20) - np.arange(scores.shape[1]))
            at = np.argpartition(-merged.clip(min=-(1 << 62)), k - 1, axis=1)[:, :k]
        else:
            at = np.argsort(-scores.clip(min=-(1 << 62)), axis=1, kind="stable")[:, :k]
        new = np.take_along_axis(scores, at, axis=1)
        new_id = np.where(new == np.iinfo(np.int64).min, np.iinfo(np.int64).max, ids[at])
        score, id_ = np.concatenate((self.score[rows], new), axis=1), np.concatenate((self.id[rows], new_id), axis=1)
        order = np.lexsort((id_, -score.clip(min=-(1 << 62))), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, axis=1), np.take_along_axis(id_, order, axis=1)


class Page:
    """A node: leaves with radius and parent distance, entries with the distance to their leaf's pivot."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, parent: np.ndarray, norm2: float) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        spot = placed(self.x, norm2)
        n = max(1, int(len(ids) ** 0.5) // 2)
        self.pivots = spot[np.unique(np.linspace(0, len(ids) - 1, n).astype(int))]
        far = distances(spot, self.pivots)
        leaf = far.argmin(axis=1)
        by = np.argsort(leaf, kind="stable")
        ends = np.cumsum(np.bincount(leaf, minlength=len(self.pivots)))
        self.rows = np.split(by, ends[:-1])
        self.entry = [far[r, k] for k, r in enumerate(self.rows)]
        self.radius = np.array([e.max(initial=0.0) for e in self.entry])
        self.to_parent = distances(self.pivots, parent[None, :])[:, 0]

    def search(self, ids: np.ndarray, q: np.ndarray, parent_distance: np.ndarray, best: Best, norm2: float) -> None:
        spots = asked(q)
        square = (spots * spots).sum(axis=1)
        slack = SLACK * (1 + np.sqrt(norm2) + np.sqrt(square))
        reach = lambda rows: np.sqrt(np.maximum(0.0, square[rows] + norm2 - 2.0 * best.kth(rows).clip(min=-(1 << 60)))) + slack[rows]
        full = np.array([len(r) > 0 for r in self.rows])
        # From stored distances alone; then, for leaves that stay, from the distance to the leaf's pivot.
        bound = np.abs(parent_distance[:, None] - self.to_parent[None, :]) - self.radius[None, :]
        bound[:, ~full] = np.inf
        near = np.full(bound.shape, np.nan)
        every = np.arange(len(q))
        todo = bound <= reach(every)[:, None]
        for leaf in np.flatnonzero(todo.any(axis=0)):
            rows = np.flatnonzero(todo[:, leaf])
            near[rows, leaf] = distances(spots[rows], self.pivots[leaf][None, :])[:, 0]
            bound[rows, leaf] = np.maximum(bound[rows, leaf], near[rows, leaf] - self.radius[leaf])
        bound[~todo] = np.inf
        turn = np.argsort(bound, axis=1, kind="stable")
        alive = every
        for wave in range(bound.shape[1]):
            leaf = turn[alive, wave]
            alive = alive[bound[alive, leaf] <= reach(alive)]
            if not len(alive):
                break
            leaf = turn[alive, wave]
            for k in np.unique(leaf):
                rows = alive[leaf == k]
                own = self.rows[k]
                # |d(q, pivot) - d(x, pivot)| bounds an entry without its distance.
                gap = np.abs(near[rows, k][:, None] - self.entry[k][None, :]) <= reach(rows)[:, None]
                use = gap.any(axis=0)
                if use.any():
                    kept = own[use]
                    found = products(q[rows], self.x[kept])
                    best.add(rows, found, self.ids[kept], self.ids[kept][None, :] == ids[rows][:, None])


def _search_group(k: int, width: int, norm2: float, pivots: np.ndarray):
    """Searches one page for one block of queries; rows of both come in one group, pages first."""

    def work(page: pa.Table, block: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not page.num_rows or not block.num_rows:
            return empty
        page, block = page.combine_chunks(), block.combine_chunks()
        one = lambda t, c: t.column(c).chunk(0)
        pivot = pivots[int(one(page, "pivot")[0].as_py())]
        node = Page(one(page, "vec_id").to_numpy(), matrix(one(page, "v"), width), pivot, norm2)
        q, ids = matrix(one(block, "v"), width), one(block, "vec_id").to_numpy()
        best = Best(len(q), k, one(block, "floor").to_numpy())
        node.search(ids, q, distances(asked(q), pivot[None, :])[:, 0], best, norm2)
        row, column = np.nonzero(best.id != np.iinfo(np.int64).max)
        return pa.table({"query_id": ids[row], "vec_id": best.id[row, column], "score": best.score[row, column]})

    return work


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k greatest products with other rows of ``vectors``.

    Both have vec_id and v, an array of longs.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = vectors.agg(F.max(F.size("v")), F.max(norm), F.count(F.lit(1))).first()
    if not facts[2]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, norm2 = int(facts[0]), float(facts[1])
    picked = vectors.sort(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").toArrow()  # a bounded sample routes; every row is indexed
    pivots = np.unique(placed(matrix(picked.column("v").combine_chunks(), width), norm2), axis=0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(placed(matrix(batch.column(1), width), norm2), pivots)
            own = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], ["vec_id", "v", "pivot", "far"])

    routed = stored(vectors.select("vec_id", "v").mapInArrow(route, "vec_id long, v array<long>, pivot int, far double"), "nearest-entries")
    nodes = {r.pivot: r for r in routed.groupBy("pivot").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # at most PIVOTS rows
    radius = np.array([nodes[p].radius if p in nodes else -np.inf for p in range(len(pivots))])
    pages = np.array([-(-nodes[p].n // PAGE_ROWS) if p in nodes else 0 for p in range(len(pivots))])
    first_page = np.concatenate(([0], np.cumsum(pages)))
    array = lambda values: F.array(*[F.lit(int(v)) for v in values])
    page = F.get(array(first_page), F.col("pivot")) + F.pmod(F.xxhash64("vec_id"), F.get(array(np.maximum(pages, 1)), F.col("pivot"))).cast("int")
    entries = routed.select("vec_id", "v", "pivot", page.alias("page"))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    asked_for = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def choose(only_first: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = matrix(batch.column(batch.schema.get_field_index("v")), width)
                far = distances(asked(q), pivots)
                if only_first:
                    own = np.where(pages[None, :] > 0, far, np.inf).argmin(axis=1)
                    row, target = np.arange(len(q)), first_page[own]
                    floor = np.full(len(q), np.iinfo(np.int64).min)
                else:
                    floor = batch.column(batch.schema.get_field_index("floor")).to_numpy()
                    square = (q.astype(np.float64) ** 2).sum(axis=1)
                    reach = np.sqrt(np.maximum(0.0, square + norm2 - 2.0 * floor.clip(min=-(1 << 60)))) + SLACK * (1 + np.sqrt(norm2) + np.sqrt(square))
                    row, pivot = np.nonzero((far - radius[None, :] <= reach[:, None]) & (pages > 0)[None, :])
                    times = pages[pivot]
                    target = np.repeat(first_page[pivot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row = np.repeat(row, times)
                out = batch.select(["vec_id", "v", "block"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(target.astype(np.int32)), pa.array(floor[row])], ["vec_id", "v", "block", "page", "floor"])

        return work

    sent = "vec_id long, v array<long>, block int, page int, floor long"

    def searched(sent_queries: DataFrame) -> DataFrame:
        wanted = sent_queries.select(F.col("page").alias("_page"), F.col("block").alias("_block")).distinct()
        left = entries.join(wanted, F.col("page") == F.col("_page")).select("vec_id", "v", "pivot", F.col("_page").alias("page"), F.col("_block").alias("block"))
        return left.groupBy("page", "block").cogroup(sent_queries.groupBy("page", "block")).applyInArrow(_search_group(k, width, norm2, pivots), schema)

    seeds = searched(stored(asked_for.mapInArrow(choose(True), sent), "nearest-seeds"))
    floors = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    floored = asked_for.join(floors.select(F.col("query_id").alias("vec_id"), "low"), "vec_id", "left")
    floored = floored.select("vec_id", "v", "block", F.coalesce("low", F.lit(-(1 << 63)).cast("long")).alias("floor"))
    routes = stored(floored.mapInArrow(choose(False), sent), "nearest-routes")
    return _top(searched(routes), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integer_vectors(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component; one row for each id that takes part."""
    whole = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return rows.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 greatest integer inner products of every twentieth vector with all others."""
    small_batches(spark)
    vectors = stored(integer_vectors(table(spark, sf_dir, "embeddings")), "nearest-vectors")
    return top_inner_products(vectors, vectors.where("vec_id % 20 = 0"))
