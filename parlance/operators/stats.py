"""Aggregates: weighted ones, four kinds of quantile, histograms, gated means, covariance and its axes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import selecting, spread


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def steady_mean(value: str) -> Column:
    """The mean of doubles from their exact sum to 12 places: equal values have equal means, in whatever order they are added up.

    Where one isn't finite or is too large for that (10^26), it is the plain mean.
    """
    exact = F.col(value).try_cast("decimal(38,12)")
    return F.when(F.count(exact) == F.count(value), F.try_sum(exact).cast("double") / F.count(value)).otherwise(F.avg(value))


def mean_in_order(df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "mean") -> DataFrame:
    """keys and the mean of doubles that are added one after another in an order, as one reader of the table does: the same to the last bit, however rows are dealt.

    Such a sum can't be cut, so a key's rows are gone through in one task, which spills those it can't hold.
    """
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.select(*keys, F.struct(*order).alias("at__"), F.avg(value).over(by).alias("mean__"))
    return run.groupBy(*keys).agg(F.max_by("mean__", "at__").alias(name))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """The smallest value at which the running weight reaches half of all (the lower one)."""
    return selecting.values_at(df, keys, value, tie, {"weighted_median": lambda n: 0.5 * n}, weight).drop("all__")


def ranked(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """keys, value, rank__ (from 1) and size__ within keys."""
    return spread.ranked(df.select(*dict.fromkeys([*keys, value, tie])), keys, [value, tie])


def quantiles(df: DataFrame, keys: list[str], value: str, tie: str, wanted: dict[str, float]) -> DataFrame:
    """Quantiles by name, interpolated between the two values around (n - 1) q. Nulls are left out."""
    at = lambda q, size: (size - 1) * F.lit(q)
    ends = {f"{n}{e}__": lambda size, q=q, f=f: f(at(q, size)) + 1 for n, q in wanted.items() for e, f in (("lo", F.floor), ("hi", F.ceil))}
    out = selecting.values_at(df, keys, value, tie, ends)
    part = lambda q: at(q, F.col("all__")) - F.floor(at(q, F.col("all__")))
    between = lambda n, q: F.col(f"{n}lo__") + part(q) * (F.col(f"{n}hi__") - F.col(f"{n}lo__"))
    return out.select(*keys, *(between(n, q).alias(n) for n, q in wanted.items()))


def quartiles(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """keys, value, tie and quartile (0 to 3) of every row."""
    rows = ranked(df, keys, value, tie)
    return rows.withColumn("quartile", F.floor(4 * (F.col("rank__") - 1) / F.col("size__"))).drop("rank__", "size__")


def upper_median(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Element n / 2 (from 0) of the sorted values without nulls."""
    return selecting.values_at(df, keys, value, tie, {"upper_median": lambda n: F.floor(n / 2) + 1}).drop("all__")


def floor_percentile(df: DataFrame, keys: list[str], value: str, tie: str, q: float) -> DataFrame:
    """Element floor(q n) (from 0) of the sorted values without nulls; the last for q = 1."""
    return selecting.values_at(df, keys, value, tie, {"floor_percentile": lambda n: F.floor(F.lit(q) * n) + 1}).drop("all__")


def bin_of(value: Column, edges: list[float]) -> Column:
    """The last edge at or under the value, from 0; null under the first."""
    return reduce(lambda out, k: F.when(value >= edges[k], k).otherwise(out), range(len(edges)), F.lit(None).cast("int"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, n for every bin, also those without values."""
    counts = df.select(bin_of(F.col(value), edges).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_percentile(bins: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The first bin at which the running count reaches q of all."""
    by = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = bins.withColumns({"run__": F.sum("n").over(by), "all__": F.sum("n").over(Window.partitionBy(*keys))})
    return run.groupBy(*keys).agg(F.min(F.when(F.col("run__") >= q * F.col("all__"), F.col("bin"))).alias("bin"))


def gated_mean(df: DataFrame, keys: list[str], power: str, absolute_db: float, relative_db: float) -> DataFrame:
    """The level of the mean power of rows above a gate that hangs on the level of those above an absolute one."""
    rows = df.withColumn("level__", 10 * F.log10(F.greatest(F.col(power), F.lit(1e-20)))).where(F.col("level__") > absolute_db)
    gate = rows.groupBy(*keys).agg((10 * F.log10(F.avg(power)) + relative_db).alias("gate"))
    kept = rows.join(gate, keys).where("level__ > gate")
    return kept.groupBy(*keys).agg((10 * F.log10(F.avg(power))).alias("gated_db"), F.count("*").alias("n"))


def zscores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with z: standardised by the population mean and deviation of the keys; 0 where there is no spread."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("mean__"), F.stddev_pop(value).alias("sd__"))
    z = F.when(F.col("sd__") > 1e-12, (F.col(value) - F.col("mean__")) / F.col("sd__")).otherwise(0.0)
    return df.join(moments, keys).withColumn("z", z).drop("mean__", "sd__")


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, cov (sample) of all pairs i <= j, in one pass."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs))
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs))
    return row.select(F.explode(cells).alias("x")).select("x.*")


def principal_axes(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """axis, eigenvalue, weights: the first k axes, each signed so that its largest weight is positive.

    The covariance matrix, a few columns square, is all that leaves the executors.
    """
    import numpy as np

    cells = covariances(df, columns).collect()
    matrix = np.zeros((len(columns), len(columns)))
    for i, j, cov in cells:
        matrix[i, j] = matrix[j, i] = cov or 0.0
    values, vectors = np.linalg.eigh(matrix)
    rows = []
    for axis, at in enumerate(np.argsort(-values)[:k]):
        v = vectors[:, at]
        v = v * np.sign(v[np.abs(v).argmax()])
        rows.append((axis, float(values[at]), v.tolist()))
    return df.sparkSession.createDataFrame(rows, "axis int, eigenvalue double, weights array<double>")


def shape_deviation(rows: DataFrame, target: DataFrame, keys: list[str], band: str, value: str, weight: str) -> DataFrame:
    """Band levels against a target's, after taking off the target-weighted mean difference: their RMS and largest."""
    both = rows.join(target, band).withColumn("d__", 10 * F.log10(value) - 10 * F.log10(weight))
    offset = both.groupBy(*keys).agg((F.sum(F.col(weight) * F.col("d__")) / F.sum(weight)).alias("mean__"))
    off = F.col("d__") - F.col("mean__")
    return both.join(offset, keys).groupBy(*keys).agg(F.round(F.sqrt(F.avg(off * off)), 6).alias("rms_dev"), F.round(F.max(F.abs(off)), 6).alias("max_dev"))


def never_rises(rows: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(step)
    falls = rows.withColumn("falls__", F.col(value) <= F.lag(value).over(by))
    return falls.groupBy(*keys).agg(F.coalesce(F.bool_and("falls__"), F.lit(True)).alias("ok"))
