"""Curation of recordings and their tables: quality rules, active rows, upserts, retention, sessions, diverse pools."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import columns as C


def active(rows: DataFrame, usable: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the usable ones."""
    return rows.join(usable.select(key), key, "left_semi")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest version of each key, by aggregation: a key's versions needn't be sorted."""
    every = old.unionByName(new)
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row__")).select(*keys, "row__.*")


def expired(rows: DataFrame, keys: list[str], newest: list[Column], keep: int, pinned: Column) -> DataFrame:
    """What retention deletes: all but the newest few of each group, and nothing that is pinned."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))
    return ranked.where((F.col("rank") > keep) & ~pinned)


def frame_range(rows: DataFrame, key: str, order: list[str], value: str, start: int, n: int) -> DataFrame:
    """n positions of every key's rows from start on; zero where there are none."""
    numbered = rows.withColumn("pos", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")).where(F.col("pos").between(start, start + n - 1))
    every = rows.select(key).distinct().withColumn("pos", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + n - 1).cast("long"))))
    return every.join(numbered.select(key, "pos", value), [key, "pos"], "left").select(key, "pos", F.coalesce(value, F.lit(0.0)).alias(value))


def sessions(rows: DataFrame, key: str, at: str, tie: str, gap: int) -> DataFrame:
    by = Window.partitionBy(key).orderBy(at, tie)
    opens = F.when((F.col(at) - F.lag(at).over(by) < gap), 0).otherwise(1)
    numbered = rows.withColumn("opens__", opens).withColumn("session", F.sum("opens__").over(by))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n"))


def document_quality(docs: DataFrame, labels: DataFrame, short: int = 100, brief: int = 500) -> DataFrame:
    """Documents with score, class and reason codes: hard rules reject, others lower the score, 50 and 80 part the classes."""
    rows = docs.join(labels, "doc_id", "left").select("doc_id", "source", "n_chars", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    n, poor = F.col("n_chars"), F.col("quality") == 0
    hard = (n < short) | (F.col("toxic") == 1)
    score = F.greatest(F.lit(0.0), 100 - C.penalty(n, brief, short, 40.0) - F.when(poor, 30.0).otherwise(0.0))
    codes = C.reasons([(n < short, "reject.short"), (F.col("toxic") == 1, "reject.toxic"), ((n >= short) & (n < brief), "warn.short"), (poor, "warn.quality"), (~hard & (score < 50), "reject.quality")])
    named = F.when(hard | (score < 50), "rejected").when(score >= 80, "good").otherwise("usable")
    return rows.select("doc_id", "source", "n_chars", F.round(score, 6).alias("score"), named.alias("class"), codes.alias("codes"))


def reject_reasons(rows: DataFrame) -> DataFrame:
    code = rows.where(F.col("class") == "rejected").select(F.explode("codes").alias("code")).where(~F.col("code").startswith("warn."))
    return code.groupBy("code").agg(F.count("*").alias("n"))


def within_spread(rows: DataFrame, keys: list[str], value: str, limit: float, population: DataFrame) -> DataFrame:
    """Rows at most so many deviations from their group's mean; the statistics are of the whole population."""
    stats = population.groupBy(*keys).agg(F.avg(value).alias("mean__"), F.stddev_pop(value).alias("sd__"))
    return rows.join(stats, keys).where((F.col("sd__") > 0) & (F.abs(F.col(value) - F.col("mean__")) / F.col("sd__") <= limit)).drop("mean__", "sd__")


#: Weights of the squared differences of seven features; a different language adds one.
FEATURE_WEIGHTS = [1.0, 0.5, 0.5, 0.5, 0.25, 0.25, 0.25]


#: Rows of a block, and query rows that are compared with a block at once.
BLOCK, STEP = 8192, 64


def _parted(ql: np.ndarray, bl: np.ndarray) -> np.ndarray:
    """Whether both have a language, and not the same one."""
    return (ql != bl) & (ql >= 0) & (bl >= 0)


def _exact(qx: np.ndarray, ql: np.ndarray, bx: np.ndarray, bl: np.ndarray, weights: list[float]) -> np.ndarray:
    """Distances of features in the last place, term by term."""
    d = np.zeros(np.broadcast_shapes(ql.shape, bl.shape))
    for c, w in enumerate(weights):
        d += (qx[..., c] - bx[..., c]) ** 2 * w
    return np.sqrt(d) + _parted(ql, bl)


def _squares(qx: np.ndarray, bx: np.ndarray, weights: list[float]) -> tuple[np.ndarray, float]:
    """All squared distances without the language by one product of matrices, and a bound of the squares' size: they are off by less than 1e-14 of it."""
    q, b = qx * np.sqrt(weights), bx * np.sqrt(weights)
    nq, nb = (q * q).sum(1), (b * b).sum(1)
    left = np.column_stack((-2 * q, nq, np.ones(len(q))))
    return left @ np.column_stack((b, np.ones(len(b)), nb)).T, float(nq.max() + nb.max())


def _by_blocks(vectors: DataFrame, weights: list[float], reduced, kind: str, asking: Column | None = None) -> DataFrame:
    """What reduced makes of every pair of blocks, given queries and others (ids, features, languages, -1 for none; others in order of language); asking: which rows are queries.

    Vectors that hold values which aren't finite have no distances.
    """
    k = max(4, -(-vectors.count() // BLOCK))
    rows = vectors.select("vec_id", "label", F.transform(F.slice("embedding", 1, len(weights)), lambda x: x.cast("double")).alias("e"), F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = (rows if asking is None else rows.where(asking)).select("vec_id", "label", "e", F.lit(True).alias("asks"), F.col("block").alias("i"), every.alias("j"))
    other = rows.select("vec_id", "label", "e", F.lit(False).alias("asks"), every.alias("i"), F.col("block").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, labels = np.stack(pdf["e"].to_numpy()).astype(np.float64), pd.factorize(pdf["label"])[0]
        fine, asks, ids = np.isfinite(x).all(1), pdf["asks"].to_numpy(bool), pdf["vec_id"].to_numpy()
        q, b = np.flatnonzero(asks & fine), np.flatnonzero(~asks & fine)
        b = b[np.argsort(labels[b], kind="stable")]
        out = [reduced((ids[own], x[own], labels[own]), (ids[b], x[b], labels[b])) for at in range(0, len(q) if len(b) else 0, STEP) for own in (q[at : at + STEP],)]
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in kind.split(", ")])

    # As many tasks as pairs of blocks: by their size alone, which is small, they would be put together in a few.
    return asked.unionByName(other).repartition(k * k, "i", "j").groupBy("i", "j").applyInPandas(run, kind)


def query_distances(vectors: DataFrame, every: int = 100, weights: list[float] = FEATURE_WEIGHTS) -> DataFrame:
    """a, b, distance of each speaker whose number is divisible by every, to all other speakers, by blocks; language is label."""

    def given(q: tuple, b: tuple) -> pd.DataFrame:
        d = _exact(q[1][:, None], q[2][:, None], b[1][None], b[2][None], weights)
        i, j = np.nonzero(q[0][:, None] != b[0])
        return pd.DataFrame({"a": q[0][i], "b": b[0][j], "distance": d[i, j]})

    return _by_blocks(vectors, weights, given, "a long, b long, distance double", F.col("vec_id") % every == 0)


def nearest(vectors: DataFrame, weights: list[float] = FEATURE_WEIGHTS) -> DataFrame:
    """a, b, distance: the nearest other speaker of each (the smallest number on ties of 6 digits), by blocks.

    Products of matrices say which can be nearest, within their error and the digits; only these are worked out term by term.
    """

    def least(q: tuple, b: tuple) -> pd.DataFrame:
        (qi, qx, ql), (bi, bx, bl) = q, b
        d, size = _squares(qx, bx, weights)
        if np.isin(qi, bi).any():
            d[qi[:, None] == bi] = np.inf
        error, cuts = 1e-14 * size, [0, *(np.flatnonzero(np.diff(bl)) + 1), len(bl)]
        parts = [(slice(x, y), _parted(ql, bl[x]).astype(float)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        best = np.min([np.sqrt(np.maximum(d[:, s].min(1), 0) + error) + far for s, far in parts], axis=0)
        at, to = [], []
        for s, far in parts:
            reach = best + 2e-6 - far
            i, j = np.nonzero(d[:, s] <= np.where(reach >= 0, reach * reach + error, -np.inf)[:, None])
            at.append(i), to.append(j + s.start)
        i, j = np.concatenate(at), np.concatenate(to)
        i, j = i[np.isfinite(d[i, j])], j[np.isfinite(d[i, j])]
        rows = pd.DataFrame({"a": qi[i], "b": bi[j], "distance": np.round(_exact(qx[i], ql[i], bx[j], bl[j], weights), 6)})
        return rows.sort_values(["a", "distance", "b"]).drop_duplicates("a")

    found = _by_blocks(vectors, weights, least, "a long, b long, distance double")
    return found.groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"), F.min("distance").alias("distance"))


def distance_sums(vectors: DataFrame, weights: list[float] = FEATURE_WEIGHTS) -> DataFrame:
    """a, total: the distances of each speaker to all others added up, by blocks.

    Squares come from products of matrices; small ones, which would lose digits, are worked out term by term.
    """

    def added(q: tuple, b: tuple) -> pd.DataFrame:
        (qi, qx, ql), (bi, bx, bl) = q, b
        d, size = _squares(qx, bx, weights)
        i, j = np.nonzero(d <= 1e-6 * size)
        n = np.bincount(bl[bl >= 0], minlength=int(max(ql.max(), bl.max(), 0)) + 1)
        far, others = np.where(ql >= 0, n.sum() - n[np.maximum(ql, 0)], 0), np.full(len(qi), len(bi))
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        d[i, j] = _exact(qx[i], np.full(len(i), -1), bx[j], np.full(len(j), -1), weights)
        if np.isin(qi, bi).any():
            i, j = np.nonzero(qi[:, None] == bi)
            d[i, j] = 0.0
            np.subtract.at(far, i, _parted(ql[i], bl[j]).astype(far.dtype))
            np.subtract.at(others, i, 1)
        return pd.DataFrame({"a": qi, "distance": d.sum(1) + far})[others > 0]

    return _by_blocks(vectors, weights, added, "a long, distance double").groupBy("a").agg(F.round(F.sum("distance"), 6).alias("total"))


def medoid(distances: DataFrame) -> DataFrame:
    """The member whose distances add up to least, the smallest number on ties."""
    return least_total(distances.groupBy("a").agg(F.round(F.sum("distance"), 6).alias("total")))


def least_total(sums: DataFrame) -> DataFrame:
    return sums.agg(F.min_by("a", F.struct("total", "a")).alias("medoid"), F.min("total").alias("total"))


def nearest_to_medoid(vectors: DataFrame, n: int, weights: list[float] = FEATURE_WEIGHTS) -> DataFrame:
    """A pool of low diversity: the medoid and those nearest to it."""
    centre = vectors.join(F.broadcast(least_total(distance_sums(vectors, weights))), F.col("vec_id") == F.col("medoid")).select("medoid", F.col("embedding").alias("em"), F.col("label").alias("lm"))
    far = C.weighted_distance(F.col("em"), F.col("embedding"), weights) + F.when(F.col("lm") != F.col("label"), 1.0).otherwise(0.0)
    near = vectors.crossJoin(F.broadcast(centre)).select("vec_id", F.when(F.col("vec_id") == F.col("medoid"), 0.0).otherwise(far).alias("distance"))
    return near.orderBy(F.round("distance", 9), "vec_id").limit(n)
