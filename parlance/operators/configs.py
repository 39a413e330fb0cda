"""Layered settings, clamps with an audit, tuning proposals, lookups with a formula to fall back on, degrading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import columns as C


def composed(rows: DataFrame, layers: list[str], name: str, low: float, high: float) -> DataFrame:
    """The first layer that is set, clamped, with what it was before and whether that changed it."""
    value = C.first_set(*(F.col(c) for c in layers))
    return rows.withColumn("asked", value).withColumn(name, C.clamp(F.col("asked"), low, high)).withColumn("adjusted", F.col("asked") != F.col(name))


def adjustments(rows: DataFrame, key: str, limits: list[tuple[str, float, float]]) -> DataFrame:
    """key, path, asked, got: a row for every value that a limit changes."""
    each = F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("double").alias("asked"), C.clamp(F.col(c).cast("double"), low, high).alias("got")) for c, low, high in limits))
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.*").where("asked <> got")


def ordered_limits(low: Column, mean: Column, high: Column, pool: Column) -> tuple[Column, Column, Column]:
    """low <= mean <= high <= pool, moving the inner ones."""
    high = F.least(high, pool)
    mean = F.least(mean, high)
    return F.least(low, mean), mean, high


def proposals(observed: DataFrame, rules: DataFrame, current: float, low: float, high: float, digits: int) -> DataFrame:
    """metric, reason, proposal: current moved towards the target by a gain, within limits; inside the deadband nothing."""
    rows = observed.join(rules, "metric", "left")
    off = F.col("target") - F.col("observed")
    reason = F.when(F.col("target").isNull(), "no rule").when(F.abs(off) <= F.col("deadband"), "deadband").otherwise("changed")
    moved = F.round(C.clamp(F.lit(current) + F.col("gain") * off, low, high), digits)
    return rows.select("metric", reason.alias("reason"), F.when(F.abs(off) > F.col("deadband"), moved).alias("proposal"))


def counts_for(rows: DataFrame, table: DataFrame, key: str, formula: Column, name: str) -> DataFrame:
    """A table's value for the key, else a formula."""
    return rows.join(table.select(key, F.col("value").alias("value__")), key, "left").withColumn(name, F.coalesce("value__", formula)).drop("value__")


def degraded(rows: DataFrame, available: str, wanted: str, policy: str) -> DataFrame:
    """What is left of a plan when fewer speakers are there than it wants.

    strict refuses; safe keeps stationary masking only; continuous goes on with the share (available - 1) / wanted and
    adds stationary masking for half of what is missing, 0.6 at most.
    """
    short = F.col(available) < F.col(wanted)
    ratio = C.clamp((F.col(available) - 1) / F.col(wanted), 0.0, 1.0)
    mode = F.when(~short, "as planned").when(F.col(policy) == "strict", "error").when((F.col(policy) == "safe") | (F.col(available) < 2), "stationary").otherwise("reduced")
    share = F.when(~short, 1.0).when(mode == "reduced", ratio).otherwise(0.0)
    extra = F.when(mode == "reduced", F.least(F.lit(0.6), 0.5 * (1 - ratio))).otherwise(0.0)
    return rows.withColumns({"mode": mode, "share": F.round(share, 6), "stationary": F.round(extra, 6)})
