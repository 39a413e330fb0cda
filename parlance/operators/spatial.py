"""Outputs and zones: gains of placed talkers, expected power of channels, trims, counts by zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import columns as C


def placement_gains(position: Column, channels: int, width: float = 1.0) -> Column:
    """Gains of a talker at a position (0 to channels - 1) over channels in a row: nearer ones get more, their squares add up to one."""
    near = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda k: F.exp(-F.pow((k - position) / width, F.lit(2.0))))
    return C.unit_power(near)


def expected_power(talkers: DataFrame, keys: list[str], activity: str, gains: str) -> DataFrame:
    """keys, channel, power: activity times squared gain, added up over talkers."""
    rows = talkers.select(*keys, activity, F.posexplode(gains).alias("channel", "gain__"))
    return rows.groupBy(*keys, "channel").agg(F.sum(F.col(activity) * F.col("gain__") * F.col("gain__")).alias("power"))


def trims(powers: DataFrame, keys: list[str], most_db: float = 3.0, measured: str | None = None, share: float = 0.25) -> DataFrame:
    """keys, channel, trim_db towards the mean power of the channels: feed-forward from the expected power, and a share of what is still measured."""
    mean = powers.groupBy(*keys).agg(F.avg("power").alias("mean__"))
    off = C.db(F.col("mean__")) - C.db(F.col("power"))
    if measured:
        off = off + share * (C.db(F.col("mean__")) - C.db(F.col(measured)) - off)
    return powers.join(mean, keys).select(*keys, "channel", C.clamp(off, -most_db, most_db).alias("trim_db"))


def zone_counts(zones: DataFrame, key: str, area: str, total: int, least: int = 1) -> DataFrame:
    """key, talkers: a total shared among zones by area, rounded, at least so many in each."""
    whole = zones.agg(F.sum(area).alias("whole__"))
    return zones.crossJoin(F.broadcast(whole)).select(key, F.greatest(F.round(total * F.col(area) / F.col("whole__")), F.lit(least)).cast("int").alias("talkers"))


def least_loaded(loads: DataFrame, keys: list[str], output: str, energy: str) -> DataFrame:
    """keys and the output with the least recent energy, the smallest number on ties."""
    return loads.groupBy(*keys).agg(F.min_by(output, F.struct(energy, output)).alias(output))
