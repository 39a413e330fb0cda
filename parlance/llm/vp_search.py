"""Nearest neighbours by cosine with a vantage-point tree in each shard of the vectors.

On unit vectors the largest cosine is the smallest chord, which is a metric. A shard's tree splits its vectors by their
distance to a vantage point. A query that has found its k-th nearest at distance r needs the far side of a split at
distance m only if |d - m| <= r; this bound is relaxed to factor * |d - m| <= r, so 1 is exact search and larger factors
visit less. A task takes one shard, builds its tree once, and moves queries through it a batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import shared

#: Vectors of a shard, at most about, and of a leaf.
SHARD, LEAF = 8_192, 128
#: Two ways to add up a cosine differ by less.
ROOM = 1e-12
#: Queries that a tree takes at once.
ASKED = 1_024


def usable(column: str = "embedding"):
    """Whether a vector takes part: not null, empty or zero, and all its components are finite numbers."""
    c = F.col(column)
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))


class Tree:
    """A vantage-point tree over unit vectors; nodes are numbered, and a leaf holds rows."""

    def __init__(self, unit: np.ndarray, seed: int = 0):
        self.unit = unit
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(unit)), np.random.default_rng(seed))

    def _grow(self, rows: np.ndarray, rng) -> int:
        k = len(self.nodes)
        self.nodes.append(())
        if len(rows) > LEAF:
            point = int(rows[rng.integers(len(rows))])
            d = chord(self.unit[rows] @ self.unit[point])
            middle = float(np.median(d))
            near, far = rows[d <= middle], rows[d > middle]
            if len(near) and len(far):
                self.nodes[k] = (point, middle, self._grow(near, rng), self._grow(far, rng))
                return k
        self.nodes[k] = (rows,)
        return k

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(q, row, cosine) of every row that can be among the k nearest of a query, a row whose id is the query's own left out.

        The cosines are products of matrices, whose last bits depend on where a row stands. So all rows within ROOM of a
        query's k-th are given, ties with it included; the caller scores them exactly and then cuts. A leaf's rows are
        weighed against the k-th known so far, and once more against the final one.
        """
        best, found = np.full((len(queries), k), -np.inf), []

        def visit(node: int, active: np.ndarray):
            if not len(active):
                return
            if len(self.nodes[node]) == 1:
                rows = self.nodes[node][0]
                for r in range(0, len(rows), 1024):
                    some = rows[r : r + 1024]
                    for s in range(0, len(active), 1024):
                        a = active[s : s + 1024]
                        cos = queries[a] @ self.unit[some].T
                        cos[own[a][:, None] == ids[some][None, :]] = -np.inf
                        every = np.concatenate([best[a], cos], axis=1)
                        best[a] = -np.partition(-every, k - 1, axis=1)[:, :k]
                        best[a] = -np.sort(-best[a], axis=1)
                        q, j = np.nonzero((cos >= best[a, -1][:, None] - ROOM) & (cos > -np.inf))
                        found.append((a[q], some[j], cos[q, j]))
                return
            point, middle, near, far = self.nodes[node]
            d = chord(queries[active] @ self.unit[point])
            inside = d <= middle
            visit(near, active[inside])
            visit(far, active[~inside])
            # A little room, so that rounding never turns a tie away.
            cross = factor * np.abs(d - middle) <= chord(best[active, -1]) + 1e-7
            visit(far, active[inside & cross])
            visit(near, active[~inside & cross])

        visit(0, np.arange(len(queries)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, row, cos = (np.concatenate(x) for x in zip(*found, strict=True))
        stay = cos >= best[q, -1] - ROOM
        return q[stay], row[stay], cos[stay]


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _vectors(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All components of a batch's vectors, one after the other, and where each begins (n + 1 cuts)."""
    col = batch.column(column)
    cuts = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]], cuts - cuts[0]


def _by_length(flat: np.ndarray, cuts: np.ndarray):
    """(rows, matrix) of the vectors of each length."""
    n = np.diff(cuts)
    for length in np.unique(n):
        rows = np.flatnonzero(n == length)
        yield rows, flat[cuts[rows][:, None] + np.arange(length)]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose squares stay within the range of doubles: only very large or small ones change, by a power of two."""
    most = np.frexp(np.abs(vectors).max(axis=1))[1]
    return np.ldexp(vectors, np.where(np.abs(most) > 400, -most, 0)[:, None])


def _norm(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(vectors * vectors, axis=1)[:, -1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of rows of two matrices; products are added up from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1] / (_norm(a) * _norm(b))


def _search(k: int, factor: float):
    """A shard's rows, its vectors before the queries, to each query's k nearest of them: a tree for each length of vector, through which queries go a batch at a time."""

    def run(batches):
        held: dict[int, list] = {}
        trees: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            asks = np.asarray(batch.column("is_query").to_numpy(zero_copy_only=False), bool)
            vec, vectors = batch.column("vec_id").to_numpy(), list(_by_length(*_vectors(batch, "embedding")))
            for rows, matrix in vectors:
                own = ~asks[rows]
                if own.any():
                    held.setdefault(matrix.shape[1], []).append((vec[rows[own]], matrix[own]))
            if not asks.any():
                continue
            for length, parts in held.items():
                ids, every = (np.concatenate(x) for x in zip(*parts, strict=True))
                # Of equal vectors no query needs more than the k smallest ids and, as one may be its own, one more.
                _, same = np.unique(every, axis=0, return_inverse=True)
                order = np.lexsort((ids, same.ravel()))
                same = same.ravel()[order]
                order = order[np.arange(len(same)) - np.searchsorted(same, same) <= k]
                every = _scaled(every[order])
                trees[length] = ids[order], every, Tree(every / _norm(every)[:, None])
            held = {}
            for rows, matrix in vectors:
                asked, matrix = rows[asks[rows]], _scaled(matrix[asks[rows]])
                if not len(asked) or matrix.shape[1] not in trees:
                    continue
                ids, every, tree = trees[matrix.shape[1]]
                for s in range(0, len(asked), ASKED):
                    yield _best(tree, matrix[s : s + ASKED], vec[asked[s : s + ASKED]], ids, every, k, factor)

    return run


def _best(tree: Tree, matrix: np.ndarray, vec: np.ndarray, ids: np.ndarray, every: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    """The k nearest of a shard's rows for each query, by exact scores; a repeated vec_id counts once, by its best row."""
    q, at, _ = tree.search(matrix / _norm(matrix)[:, None], vec, ids, k, factor)
    score = np.concatenate([cosine(matrix[q[s : s + 4096]], every[at[s : s + 4096]]) for s in range(0, max(1, len(q)), 4096)])
    order = np.lexsort((ids[at], -score, q))
    q, at, score = q[order], at[order], score[order]
    _, once = np.unique(np.stack([q, ids[at]]), axis=1, return_index=True)
    once.sort()
    q, at, score = q[once], at[once], score[once]
    stay = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.RecordBatch.from_arrays([pa.array(vec[q[stay]]), pa.array(ids[at[stay]]), pa.array(score[stay])], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors other than its own vec_id, ties to the smaller vec_id.

    Both have vec_id and embedding (numbers); rows with a null vec_id, and vectors that usable() excludes, take no part.
    Vectors of different lengths aren't compared. A repeated vec_id counts as one vector of that id for each different
    row. With factor 1 the result is exact. An empty table gives an empty result. Vectors are shuffled once, to their
    shards; queries go to every shard, which an exact search can't avoid. A shard of equal vectors is one leaf.
    """
    spark = vectors.sparkSession
    slim = lambda df: df.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors, queries = slim(vectors).distinct(), slim(queries).distinct()
    shards = max(1, -(-vectors.count() // SHARD))
    sides = vectors.withColumns({"shard": F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"), "is_query": F.lit(False)})
    asked = queries.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "is_query": F.lit(True)})
    dealt = sides.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("is_query")
    found = shared.table(dealt.select("is_query", "vec_id", "embedding").mapInArrow(shared.tidy(_search(k, factor)), "query_id long, vec_id long, score double"), "near")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vector_neighbours(embeddings: DataFrame, k: int = 5, factor: float = 1.0, every: int = 50) -> DataFrame:
    """nearest() with the rows whose vec_id is divisible by every as queries."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % every == 0), k, factor)
