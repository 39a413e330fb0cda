"""Joins beyond the built-in ones: nesting, overrides, priority lookups, migration, near pairs, tolerance checks, products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(parents: DataFrame, children: DataFrame, key: str, item: Column, name: str) -> DataFrame:
    """Parents with a sorted array of their children; without any, an empty one."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def overridden(derived: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A stored value, where there is one, instead of the derived one."""
    return derived.join(stored.select(*keys, F.col(value).alias("stored__")), keys, "left").withColumn(value, F.coalesce("stored__", value)).drop("stored__")


def looked_up(rows: DataFrame, sources: list[tuple[DataFrame, str, Column]], fallback: Column, name: str) -> DataFrame:
    """The first answer of several lookup tables (table, its key, the row's key), else the fallback."""
    for k, (table, key, by) in enumerate(sources):
        rows = rows.join(table.select(F.col(key).alias(f"key{k}__"), F.col("answer").alias(f"answer{k}__")), by == F.col(f"key{k}__"), "left")
    found = F.coalesce(*(F.col(f"answer{k}__") for k in range(len(sources))), fallback)
    return rows.withColumn(name, found).drop(*(f"{p}{k}__" for k in range(len(sources)) for p in ("key", "answer")))


def migrated(old: DataFrame, new: DataFrame, keys: list[str], number: str) -> DataFrame:
    """old's numbers with new's for the same identity; null where the content behind a key has changed."""
    return old.join(new.select(*keys, F.col(number).alias("new_number")), keys, "left")


def near_pairs(rows: DataFrame, keys: list[str], number: str, value: str, width: float, test) -> DataFrame:
    """x < y pairs of a group whose values lie within width and pass a test: neighbouring cells instead of all pairs."""
    cell = F.floor(F.col(value) / F.lit(width)).cast("long")
    x = rows.select(*keys, F.col(number).alias("x"), F.col(value).alias("vx"), cell.alias("cell__"))
    y = rows.select(*keys, F.col(number).alias("y"), F.col(value).alias("vy"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell__"))
    return x.join(y, [*keys, "cell__"]).where((F.col("x") < F.col("y")) & (F.abs(F.col("vx") - F.col("vy")) <= width) & test(F.col("vx"), F.col("vy"))).drop("cell__")


def compared(a: DataFrame, b: DataFrame, name: str, tolerances: DataFrame) -> DataFrame:
    """Metrics of two implementations by name, and whether they agree within the metric's tolerance; nulls are left out."""
    both = a.select(name, F.col("value").alias("a")).join(b.select(name, F.col("value").alias("b")), name).where("a is not null and b is not null")
    return both.join(tolerances, name, "left").withColumn("ok", F.abs(F.col("a") - F.col("b")) <= F.coalesce("tolerance", F.lit(0.0)))


def product(axes: list[tuple[str, DataFrame]]) -> DataFrame:
    """All combinations of short axes (name, one-column table in order of position) with their cell number; the last axis runs fastest."""
    tables = [axis.select(F.col(axis.columns[0]).alias(name), F.col(axis.columns[1]).alias(f"{name}__at")) for name, axis in axes]
    sizes = [t.agg(F.count("*").alias(f"{name}__n")) for (name, _), t in zip(axes, tables, strict=True)]
    every = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), [*tables, *sizes])
    cell = reduce(lambda acc, name: acc * F.col(f"{name}__n") + F.col(f"{name}__at"), [name for name, _ in axes], F.lit(0))
    return every.select(cell.cast("long").alias("cell"), *(name for name, _ in axes))
