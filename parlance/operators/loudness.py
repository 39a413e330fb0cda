"""Loudness: K-weighting as two biquads in a row, momentary and short-term levels of blocks, and the integrated level by two gates."""

from __future__ import annotations

from math import pi, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import recurrence, spread
from parlance.operators.kept import kept

#: Fixed values of the standard: both stages' frequency, gain in dB and quality, the offset of a level, both gates, and
#: how many blocks of 100 ms momentary and short-term levels have.
SHELF_HZ, SHELF_DB, SHELF_Q, SHELF_POWER = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416
PASS_HZ, PASS_Q = 38.13547087602444, 0.5003270373238773
OFFSET, ABSOLUTE, RELATIVE = -0.691, -70.0, -10.0
MOMENTARY, SHORT_TERM = 4, 30


def stages(rate: float) -> list[tuple[tuple[float, float, float], tuple[float, float]]]:
    """(b, a) of the high shelf and the high pass at a rate."""
    k, high = tan(pi * SHELF_HZ / rate), 10 ** (SHELF_DB / 20)
    middle, a0 = high**SHELF_POWER, 1 + k / SHELF_Q + k * k
    shelf = ((high + middle * k / SHELF_Q + k * k) / a0, 2 * (k * k - high) / a0, (high - middle * k / SHELF_Q + k * k) / a0)
    poles = lambda k, q: (2 * (k * k - 1) / (1 + k / q + k * k), (1 - k / q + k * k) / (1 + k / q + k * k))
    return [(shelf, poles(k, SHELF_Q)), ((1.0, -2.0, 1.0), poles(tan(pi * PASS_HZ / rate), PASS_Q))]


def k_weighting(rate: float) -> recurrence.Linear:
    shelf, high_pass = stages(rate)
    return recurrence.biquad(*shelf).then(recurrence.biquad(*high_pass))


def lufs(power: Column) -> Column:
    """The level of a mean square; null stays null (greatest() alone would pass over it)."""
    return F.when(power.isNotNull(), OFFSET + 10 * F.log10(F.greatest(power, F.lit(1e-30))))


def blocks(df: DataFrame, keys: list[str], order: list[str], value: str, rate: float, size: int, at: Column, width: int) -> DataFrame:
    """keys, block (from 0), power: the mean square of the K-weighted values of each whole block of so many rows; see recurrence.scan()."""
    weighted = recurrence.scan(df, keys, order, value, k_weighting(rate), at, width, "k__", "n__")
    sums = weighted.groupBy(*keys, F.floor((F.col("n__") - 1) / size).alias("block")).agg(F.avg(F.col("k__") * F.col("k__")).alias("power"), F.count("*").alias("rows__"))
    return sums.where(F.col("rows__") == size).drop("rows__")


def levels(powers: DataFrame, keys: list[str], width: int = 1 << 16) -> DataFrame:
    """blocks() with momentary and short_term: levels of the last blocks up to each, null until there are enough; mean4 is the momentary power."""
    last = lambda n: lambda w: F.when(F.count("power").over(w) == n, F.avg("power").over(w))
    out = spread.over_last(kept(powers), keys, ["block"], F.col("block"), width, MOMENTARY, {"mean4": last(MOMENTARY)})
    out = spread.over_last(kept(out), keys, ["block"], F.col("block"), width, SHORT_TERM, {"mean30": last(SHORT_TERM)})
    return out.select(*keys, "block", "power", "mean4", lufs(F.col("mean4")).alias("momentary"), lufs(F.col("mean30")).alias("short_term"))


def integrated(leveled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gated, integrated: the level of all momentary powers over both gates (how many), null where none is.

    The first gate is absolute; the second lies under the level of what passed the first.
    """
    over = leveled.where(F.col("momentary") > ABSOLUTE)
    gates = over.groupBy(*keys).agg((lufs(F.avg("mean4")) + RELATIVE).alias("gate__"))
    passed = spread.joined(over, gates, keys).where(F.col("momentary") > F.col("gate__"))
    return passed.groupBy(*keys).agg(F.count("*").alias("gated"), lufs(F.avg("mean4")).alias("integrated"))
