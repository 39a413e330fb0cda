"""Feature kernels over framed series: each key's values in order of time are cut into frames, and frames into features.

A frame is one row with its few values, so everything after that is array expressions, joins on (key, frame) and grouping:
a key with a third of all rows is spread over as many tasks as it has frames.
"""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import spread, stats

#: Values of a frame, frames of a modulation window and from one such window to the next.
FRAME, WINDOW, HOP = 8, 4, 2


def framed(rows: DataFrame, key: str, order: list[str], at: Column, value: str, width: int, size: int = FRAME) -> DataFrame:
    """key, frame, x: whole frames of so many values; what is left at a key's end is none."""
    placed = spread.numbered(rows.select(key, *order, F.col(value).cast("double").alias("x")), [key], order, at, width, "place")
    cell = placed.select(key, F.floor((F.col("place") - 1) / size).cast("long").alias("frame"), F.pmod(F.col("place") - 1, F.lit(size)).alias("pos"), "x")
    frames = cell.groupBy(key, "frame").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("x")).where(F.size("x") == size)
    return frames.select(key, "frame", F.col("x.x").alias("x"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_power(x: Column = None) -> Column:
    x = F.col("x") if x is None else x
    return _sum(F.transform(x, lambda v: v * v)) / F.size(x)


def level(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(1e-12)))


def activity(frames: DataFrame, key: str, margin: float = 3.0) -> DataFrame:
    """frames with level, floor (the key's tenth percentile of levels) and active: over the floor by a margin."""
    rows = frames.withColumn("level", level(mean_power()))
    floors = stats.quantiles(rows, [key], "level", "frame", {"floor": 0.1})
    return rows.join(floors, key).withColumn("active", F.col("level") > F.col("floor") + margin)


def band_powers(x: Column, size: int = FRAME) -> list[Column]:
    """The power of each harmonic of a frame, by its discrete Fourier transform."""
    out = []
    for k in range(1, size // 2 + 1):
        part = lambda f, k=k: _sum(F.zip_with(x, F.array(*(F.lit(f(2 * pi * k * j / size)) for j in range(size))), lambda v, c: v * c))
        out.append(part(cos) * part(cos) + part(sin) * part(sin))
    return out


def differences(x: Column, size: int = FRAME) -> list[Column]:
    """The mean squared difference of a frame and itself, moved by 1, 2, ... half a frame."""
    out = []
    for lag in range(1, size // 2 + 1):
        pairs = F.zip_with(F.slice(x, 1, size - lag), F.slice(x, lag + 1, size - lag), lambda a, b: (a - b) * (a - b))
        out.append(_sum(pairs) / (size - lag))
    return out


def periods(frames: DataFrame) -> DataFrame:
    """frames with lag (of the smallest difference, the shorter on ties) and depth (that difference by the mean of all)."""
    d = F.array(*differences(F.col("x")))
    rows = frames.withColumn("d", d)
    rows = rows.withColumn("least", F.array_min("d"))
    return rows.withColumns({"lag": F.array_position("d", F.col("least")), "depth": F.col("least") / F.greatest(_sum(F.col("d")) / F.size("d"), F.lit(1e-12))}).drop("d", "least")


def before(frames: DataFrame, key: str, names: list[str], by: int = 1) -> DataFrame:
    """frames with the values of the frame so many places earlier (after, where by is negative); null where there is none."""
    shifted = frames.select(key, (F.col("frame") + by).alias("frame"), *(F.col(n).alias(f"{n}_{'before' if by > 0 else 'after'}") for n in names))
    return frames.join(shifted, [key, "frame"], "left")


def active_level(rows: DataFrame, key: str, value: str, top: int = 9, margin: float = 15.9) -> DataFrame:
    """key, level_db, share: the level of the time at or over the first threshold, halved again and again from 2 ** top, that lies the margin under it."""
    x = F.abs(F.col(value).cast("double"))
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(x * x).alias("energy"), *(F.sum((x >= 2.0 ** (top - k)).cast("long")).alias(f"c{k}") for k in range(16)))
    out = F.lit(None).cast("struct<level_db double, share double>")
    for k in reversed(range(16)):
        share = F.col(f"c{k}") / F.col("n")
        at = 10 * F.log10(F.greatest(F.col("energy"), F.lit(1e-20)) / (share * F.col("n")))
        fit = (F.col(f"c{k}") > 0) & (at - 20 * F.log10(F.lit(2.0 ** (top - k))) >= margin)
        out = F.when(fit, F.struct(at.alias("level_db"), share.alias("share"))).otherwise(out)
    return sums.select(key, out.alias("a")).select(key, "a.level_db", "a.share")


def modulation(frames: DataFrame, key: str, name: str, window: int = WINDOW, hop: int = HOP) -> DataFrame:
    """key, window, depths: of the levels of whole windows of frames, how deep each harmonic modulates them.

    A frame goes to the few windows that it is in; a window is one row.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - window + 1) / hop)).cast("long")
    dealt = frames.select(key, "frame", name, F.explode(F.sequence(first, F.floor(F.col("frame") / hop).cast("long"))).alias("window"))
    rows = dealt.groupBy(key, "window").agg(F.array_sort(F.collect_list(F.struct("frame", name))).alias("x")).where(F.size("x") == window)
    x = F.col(f"x.{name}")
    total = F.greatest(_sum(x), F.lit(1e-12))
    return rows.select(key, "window", F.array(*(F.sqrt(p) / total for p in band_powers(x, window))).alias("depths"))
