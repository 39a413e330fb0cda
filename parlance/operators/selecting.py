"""Exact values at given places of the order of a key, without ranking the key's rows.

Rows are counted by fixed buckets of their values, a 64th of an octave wide; only the cells of a key that hold a wanted
place are looked at again. While one of them has more than LIMIT rows it is cut at values from a mergeable sketch, whose
parts are counted exactly, so a poor cut costs time and not the result; then its distinct values are ordered. All counting
is combined before it is shuffled. Up to SHORT cells are sent to all tasks, so rows aren't shuffled at all; where more of
them meet their rows, a frequent key is dealt over SALTS tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.kept import kept
from parlance.operators.spread import joined

LIMIT = 1 << 20  # rows of a cell that one task may order
SALTS = 16
SHORT = 10_000  # cells that may be broadcast, each with its key and four numbers
ACCURACY = 10_000  # of the sketch: its values are off by about a ten thousandth of a cell's rows
GRID = [k / 32 for k in range(1, 32)]


def _bucket(value: Column) -> Column:
    """A number that never falls as the value rises; at most 300,000 different ones."""
    x = value.cast("double")
    size = 100_000 + F.floor(F.ln(F.abs(x)) * 92)
    return F.when(F.isnan(x) | (x == float("inf")), 200_000).when(x == float("-inf"), -200_000).when(x > 0, size).when(x < 0, -size).otherwise(0)


def _part(value: Column, cuts: Column) -> Column:
    """The place of a value among cuts: odd for those equal to one, even between two."""
    return F.size(F.filter(cuts, lambda c: c <= value)) + F.size(F.filter(cuts, lambda c: c < value))


def _salted(cells: DataFrame) -> DataFrame:
    return cells.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _counted(rows: DataFrame, cell: list[str], part: Column) -> DataFrame:
    """The parts of each cell: from__ and to__ (smallest and largest value), rows__, weight__."""
    counts = (F.min("value__").alias("from__"), F.max("value__").alias("to__"), F.count("*").alias("rows__"), F.sum("weight__").alias("weight__"))
    return rows.groupBy(*cell, part.alias("part__")).agg(*counts)


def _passed(parts: DataFrame, cell: list[str], before: Column) -> DataFrame:
    """parts with before__ and through__, the key's weight before each and up to its end."""
    run = F.coalesce(F.sum("weight__").over(Window.partitionBy(*cell).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("before__", before + run).withColumn("through__", F.col("before__") + F.col("weight__"))


def _held(parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, all__, cells__ (by place of name): the first part that reaches what is wanted of it (at__, an array)."""
    cell = F.struct("from__", "to__", "rows__", "before__")
    first = [F.min_by(cell, F.when(F.col("through__") >= F.col("at__")[k], F.col("part__"))) for k in range(len(names))]
    return kept(parts.groupBy(*keys, "all__", "at__").agg(F.array(*first).alias("cells__")))


def _open(held: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of more than one value, once each."""
    cells = F.array_distinct(F.filter("cells__", lambda c: c["from__"] < c["to__"]))
    return held.select(*keys, F.explode(cells).alias("c__")).select(*keys, F.col("c__.from__").alias("cell__"), F.col("c__.to__").alias("end__"), F.col("c__.rows__").alias("in__"), F.col("c__.before__").alias("past__"))


def _inside(rows: DataFrame, cells: DataFrame, keys: list[str], short: bool) -> DataFrame:
    """The rows of each cell."""
    cells = cells.drop("in__")
    both = joined(rows, F.broadcast(cells), keys) if short else joined(rows, _salted(cells), [*keys, "salt__"])
    return both.where("value__ >= cell__ and value__ <= end__")


def _finer(rows: DataFrame, held: DataFrame, keys: list[str], short: bool) -> DataFrame:
    """held after its open cells are cut once more."""
    cell = [*keys, "cell__", "past__"]
    inside = _inside(rows, _open(held, keys), keys, short)
    cuts = inside.groupBy(*cell).agg(F.array_distinct(F.percentile_approx("value__", GRID, ACCURACY)).alias("cuts__"))
    dealt = joined(inside, F.broadcast(cuts), cell) if short else joined(inside, _salted(cuts), [*cell, "salt__"])
    parts = _counted(dealt, cell, _part(F.col("value__"), F.col("cuts__")))
    parts = _passed(parts, cell, F.col("past__")).select(*keys, "cell__", "from__", "to__", "rows__", "before__", "through__", "part__")
    places = held.select(*keys, "all__", "at__", F.posexplode("cells__").alias("name__", "c__")).withColumn("cell__", F.col("c__.from__"))
    reached = joined(places, parts, [*keys, "cell__"], "left")
    at = F.element_at("at__", F.col("name__") + 1)
    # A cell of one value has no parts; and a sum of doubles may end just under what its cell was found to reach.
    part = F.struct("from__", "to__", "rows__", "before__")
    best = reached.groupBy(*keys, "all__", "at__", "name__", "c__").agg(F.min_by(part, F.when(F.col("through__") >= at, F.col("part__"))).alias("found__"), F.max_by(part, "part__").alias("last__"))
    best = best.withColumn("now__", F.coalesce("found__", F.when(F.col("last__.from__").isNotNull(), F.col("last__")), "c__"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("name__", "now__"))), lambda x: x["now__"])
    return kept(best.groupBy(*keys, "all__", "at__").agg(cells.alias("cells__")))


def values_at(df: DataFrame, keys: list[str], value: str, tie: str, wanted: dict[str, Callable[[Column], Column]], weight: str | None = None, limit: int = LIMIT, short: int = SHORT) -> DataFrame:
    """keys, all__ and, by name, the smallest value of the key up to which the weights come to what is wanted.

    wanted: name to a function of the key's weight in all (its number of rows, without weights); more than all gives the
    largest value, 0 or less the smallest. tie: a column that tells equal values apart, by which frequent keys are dealt.
    Rows without a value are left out, and so are keys that have none; null keys are a key; a null weight is 0, and weights
    aren't negative. NaN is the largest value.
    """
    names = list(wanted)
    mass = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight), F.lit(0))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value__"), mass.alias("weight__"), F.pmod(F.xxhash64(tie), F.lit(SALTS)).cast("int").alias("salt__"))
    parts = _passed(_counted(rows, keys, _bucket(F.col("value__"))).repartition(*keys), keys, F.lit(0)).withColumn("all__", F.sum("weight__").over(Window.partitionBy(*keys)))
    at = F.array(*(F.least(f(F.col("all__")).cast("double"), F.col("all__").cast("double")) for f in wanted.values()))
    held = _held(parts.withColumn("at__", at), keys, names)
    while True:
        largest, cells = _open(held, keys).agg(F.max("in__"), F.count("*")).first()
        if not cells or largest <= limit:
            break
        held = _finer(rows, held, keys, cells <= short)
    counts = _inside(rows, _open(held, keys), keys, cells <= short).groupBy(*keys, "cell__", "past__", "value__").agg(F.sum("weight__").alias("weight__"))
    by = Window.partitionBy(*keys, "cell__").orderBy("value__").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.repartition(*keys).select(*keys, "cell__", "value__", (F.col("past__") + F.sum("weight__").over(by)).alias("through__"))
    found = joined(held, counts, keys, "left")

    def pick(k: int) -> Column:
        here = (F.col("cell__") == F.col("cells__")[k]["from__"]) & (F.col("through__") >= F.col("at__")[k])
        return F.coalesce(F.min(F.when(here, F.col("value__"))), F.max(F.col("cells__")[k]["to__"]))

    return found.groupBy(*keys, "all__").agg(*(pick(k).alias(n) for k, n in enumerate(names)))
