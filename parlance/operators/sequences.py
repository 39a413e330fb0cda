"""Operators over rows in order: runs, rolling statistics, peaks, first-wins duplicates, ids, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from parlance.operators import recurrence
from parlance.operators.kept import kept


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """keys, run, n, first, last, closed: stretches of rows in a row for which the flag holds; closed: another row follows."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"flag__": F.coalesce(flag, F.lit(False)), "row__": F.row_number().over(by)})
    rows = rows.withColumn("last__", F.max("row__").over(Window.partitionBy(*keys)))
    same = Window.partitionBy(*keys, "flag__").orderBy("row__")
    rows = rows.where("flag__").withColumn("run", F.col("row__") - F.row_number().over(same))
    out = rows.groupBy(*keys, "run", "last__").agg(F.count("*").alias("n"), F.min("row__").alias("first"), F.max("row__").alias("last"))
    return out.withColumn("closed", F.col("last") < F.col("last__")).drop("last__")


def trailing(keys: list[str], order: list[str], n: int) -> WindowSpec:
    """The last n rows up to this one; fewer at the start."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)


def centred(keys: list[str], order: list[str], half: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)


def upper_median_over(value: str, window: WindowSpec) -> Column:
    """Element n / 2 of the sorted values of a short frame."""
    values = F.array_sort(F.collect_list(value).over(window))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def is_peak(value: str, keys: list[str], order: list[str]) -> Column:
    """Over the value before and at or over the one after; neither end is a peak."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return (F.col(value) > F.lag(value).over(by)) & (F.col(value) >= F.lead(value).over(by))


def later_copies(df: DataFrame, content: Column, order: list[str]) -> DataFrame:
    """Rows whose content an earlier row has already. The first of each is found by aggregation, so a common content isn't sorted in one task."""
    keyed = df.withColumn("content__", content)
    first = keyed.groupBy("content__").agg(F.min(F.struct(*order)).alias("first__"))
    return keyed.join(first, "content__").where(F.struct(*order) != F.col("first__")).drop("content__", "first__")


def dense_ids(known: DataFrame, fresh: DataFrame, name: str, number: str) -> DataFrame:
    """known and new names with ids: new ones, in order, go on after the largest that is known.

    Ranges of names are numbered by themselves and moved up by what the ranges before them hold, so no task sorts all.
    """
    new = fresh.select(name).distinct().join(known.select(name), name, "left_anti")
    # Ranges come from samples, so they are drawn once and kept.
    dealt = kept(new.repartitionByRange(name).withColumn("part__", F.spark_partition_id()))
    sizes = dealt.groupBy("part__").agg(F.count("*").alias("n__"))
    before = sizes.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    top = known.agg(F.coalesce(F.max(number), F.lit(0)).alias("top__"))
    within = F.row_number().over(Window.partitionBy("part__").orderBy(name))
    numbered = dealt.withColumn("within__", within).join(F.broadcast(before), "part__").crossJoin(F.broadcast(top))
    return known.select(name, number).unionByName(numbered.select(name, (F.col("top__") + F.col("before__") + F.col("within__")).cast("long").alias(number)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def exponential_average(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, at: Column, width: int) -> DataFrame:
    """df's keys and order with ema: s += alpha * (x - s), begun with the first value; see recurrence.scan()."""
    return recurrence.scan(df, keys, order, value, recurrence.exponential(alpha), at, width, "ema")
