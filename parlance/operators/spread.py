"""Running values over long series whose keys may be few or uneven: rows are dealt by key and stretch of time, not by key.

A window by key puts all rows of a key into one task. Here a key spans many stretches: running values are taken within
each, and what the stretches before add comes from one row for each stretch and key. A stretch is a fixed width of the
clock, so a row's stretch doesn't depend on samples or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.kept import kept


def dealt(df: DataFrame, at: Column, width: int) -> DataFrame:
    """df with range__, the stretch of the clock that a row falls into; the order of rows must begin with that clock."""
    return df.withColumn("range__", F.floor(at / F.lit(width)))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of which nulls are equal; the right side's other columns follow the left ones."""
    right = right.select(*(F.col(c).alias(f"{c}right__") for c in on), *(c for c in right.columns if c not in on))
    both = left.join(right, [left[c].eqNullSafe(right[f"{c}right__"]) for c in on], how)
    return both.drop(*(f"{c}right__" for c in on))


def _combined(how: str, a: Column, b: Column) -> Column:
    return F.greatest(a, b) if how == "max" else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, how: str = "sum", before: bool = False) -> DataFrame:
    """dealt() rows with the running sum or maximum of a value by key and order; before: without the row itself.

    The order must not tie within a key. A maximum of nothing is null, a sum of nothing 0.
    """
    function = {"sum": F.sum, "max": F.max}[how]
    earlier = Window.partitionBy(*keys).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "range__").agg(function(value).alias("total__"))
    totals = totals.withColumn("earlier__", function("total__").over(earlier)).drop("total__")
    within = Window.partitionBy(*keys, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = joined(rows.withColumn("within__", function(value).over(within)), totals, [*keys, "range__"])
    return out.withColumn(name, _combined(how, F.col("within__"), F.col("earlier__"))).drop("within__", "earlier__")


def following(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """dealt() rows with the value of the next row by key and order; null after the last."""
    firsts = rows.groupBy(*keys, "range__").agg(F.min_by(value, F.struct(*order)).alias("first__"))
    firsts = firsts.withColumn("later__", F.lead("first__").over(Window.partitionBy(*keys).orderBy("range__"))).drop("first__")
    here = Window.partitionBy(*keys, "range__").orderBy(*order)
    out = rows.withColumns({"next__": F.lead(value).over(here), "last__": F.lead(F.lit(1)).over(here).isNull()}).join(firsts, [*keys, "range__"])
    return out.withColumn(name, F.when(F.col("last__"), F.col("later__")).otherwise(F.col("next__"))).drop("next__", "last__", "later__")


def concurrency(df: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """intervals.concurrency() for few or uneven keys."""
    deltas = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("x"))
    merged = dealt(deltas.groupBy(*keys, F.col("x.t").alias("t__")).agg(F.sum("x.d").alias("d__")), F.col("t__"), width)
    steps = following(running(merged, keys, ["t__"], "d__", "on__"), keys, ["t__"], "t__", "until__").where("until__ is not null")
    steps = steps.withColumn("span__", F.col("until__") - F.col("t__"))
    return steps.groupBy(*keys).agg(F.max("on__").alias("max_active"), F.min("on__").alias("min_active"), (F.sum(F.col("on__") * F.col("span__")) / F.sum("span__")).alias("mean_active"))


def by_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with range__: ranges of rows in order, which cut a frequent key into several; for running() over values that aren't a clock.

    Ranges come from samples, so they are drawn once and kept.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("range__", F.spark_partition_id())
    return kept(dealt)


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with rank__ (from 1, in an order without ties) and size__ within keys; no task has a whole key."""
    rows = running(by_order(df.withColumn("one__", F.lit(1).cast("long")), keys, order), keys, order, "one__", "rank__")
    sizes = rows.groupBy(*keys).agg(F.max("rank__").alias("size__"))
    return rows.drop("one__", "range__").join(sizes, keys)


def numbered(df: DataFrame, keys: list[str], order: list[str], at: Column, width: int, name: str) -> DataFrame:
    """df with each row's place (from 1) by key and order."""
    rows = dealt(df.withColumn("one__", F.lit(1).cast("long")), at, width)
    return running(rows, keys, order, "one__", name).drop("one__", "range__")


def runs(df: DataFrame, keys: list[str], order: list[str], at: Column, width: int, flag: Column) -> DataFrame:
    """sequences.runs() for few or uneven keys: keys, run, n, first, last, closed of stretches of rows for which the flag holds.

    A run is named by how many rows without the flag came before it, which is one for all of its rows.
    """
    placed = numbered(df.withColumn("flag__", F.coalesce(flag, F.lit(False))), keys, order, at, width, "row__")
    rows = running(dealt(placed.withColumn("off__", (~F.col("flag__")).cast("long")), at, width), keys, order, "off__", "run")
    sizes = rows.groupBy(*keys).agg(F.max("row__").alias("last__"))
    out = rows.where("flag__").groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min("row__").alias("first"), F.max("row__").alias("last"))
    return out.join(sizes, keys).withColumn("closed", F.col("last") < F.col("last__")).drop("last__")


def over_last(df: DataFrame, keys: list[str], order: list[str], at: Column, width: int, n: int, values: dict, block: int = 1 << 16) -> DataFrame:
    """df with aggregates of the last n rows of a key up to each row (fewer at its start).

    Rows are numbered and cut into blocks; a block also gets the n - 1 rows before it, so no task sorts a whole key.
    values: name to a function of a window that gives a column.
    """
    block = max(block, 8 * n)
    rows = numbered(df, keys, order, at, width, "place__").withColumn("block__", F.floor((F.col("place__") - 1) / block))
    ahead = (F.col("place__") - 1) % block >= block - (n - 1)
    copies = F.array_compact(F.array(F.col("block__"), F.when(ahead, F.col("block__") + 1)))
    rows = rows.withColumn("in__", F.explode(copies))
    by = Window.partitionBy(*keys, "in__").orderBy("place__").rowsBetween(1 - n, 0)
    out = rows.withColumns({name: value(by) for name, value in values.items()})
    return out.where("in__ = block__").drop("place__", "block__", "in__")


def even(rows: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """rows dealt by a key to tasks of about so many: for work that is long by the row, where a file of few bytes would be one task."""
    return rows.repartition(max(1, -(-rows.count() // most)), key)
