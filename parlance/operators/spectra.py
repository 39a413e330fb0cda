"""Spectra of long series: overlapping frames as rows, their Fourier transform, and third-octave bands by fractional bins.

A series is cut into hops, a row each; a frame is a few hops in a row, which it gets by joins on (key, hop). So frames reach
over every border between stretches and tasks, and no task has a whole key. The transform is one matrix operation over the
frames of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import recurrence, spread
from parlance.operators.kept import kept

#: Third-octave bands around 10^(k / 10) Hz: 50 Hz to 16 kHz.
BANDS = range(17, 43)


def edges(band: int) -> tuple[float, float]:
    """Where the band around 10^(band / 10) Hz begins and ends."""
    return 10 ** ((band - 0.5) / 10), 10 ** ((band + 0.5) / 10)


def hops(df: DataFrame, keys: list[str], order: list[str], value: str, hop: int, at: Column, width: int, rest: bool = False) -> DataFrame:
    """keys, hop (from 0), x: whole hops of so many values by key and order (rest: also the shorter one at a key's end);
    null values count as 0. See spread.numbered()."""
    rows = spread.numbered(df.select(*keys, *order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x__")), keys, order, at, width, "n__")
    cell = rows.select(*keys, F.floor((F.col("n__") - 1) / hop).cast("long").alias("hop"), F.struct("n__", "x__").alias("v__"))
    cut = cell.groupBy(*keys, "hop").agg(F.array_sort(F.collect_list("v__")).alias("v__"))
    cut = cut if rest else cut.where(F.size("v__") == hop)
    return cut.select(*keys, "hop", F.col("v__.x__").alias("x"))


def frames(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, hop: int, at: Column, width: int) -> DataFrame:
    """keys, frame (from 0), x: every whole frame of size values, one beginning every hop values; hop divides size."""
    if size % hop:
        raise ValueError(f"{hop} doesn't divide {size}")
    cut = hops(df, keys, order, value, hop, at, width)
    out = cut
    for k in range(1, size // hop):
        later = cut.select(*keys, (F.col("hop") - k).alias("hop"), F.col("x").alias("more__"))
        out = spread.joined(out, later, [*keys, "hop"]).withColumn("x", F.concat("x", "more__")).drop("more__")
    return out.withColumnRenamed("hop", "frame")


def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def band_weights(size: int, rate: float, bands=BANDS) -> np.ndarray:
    """How much of each bin (a row), half a bin to both sides of its frequency, lies in each band."""
    step = rate / size
    centre = np.arange(size // 2 + 1)[:, None] * step
    low, high = (np.array(x)[None, :] for x in zip(*map(edges, bands), strict=True))
    return np.maximum(np.minimum(np.minimum(high, rate / 2), centre + step / 2) - np.maximum(low, centre - step / 2), 0) / step


def power(frame_rows: DataFrame, size: int, out: str = "power", weights: np.ndarray | None = None) -> DataFrame:
    """frames() with the mean square of each bin of a frame under a Hann window, one-sided, or summed by weights (bins by bands), instead of x."""
    window = hann(size)
    scale = 2 / (size * np.sum(window * window))

    def add(batch):
        column = batch.column("x")
        cuts = column.offsets.to_numpy()
        x = column.values.to_numpy()[cuts[0] : cuts[-1]].reshape(-1, size)
        bins = scale * np.abs(np.fft.rfft(x * window, axis=1)) ** 2
        return [pa.array(list(bins if weights is None else bins @ weights), pa.list_(pa.float64()))]

    return recurrence.mapped(frame_rows, add, f"{out} array<double>", ("x",))


def block_spectra(df: DataFrame, keys: list[str], order: list[str], value: str, rate: float, size: int, block: int, alpha: float, at: Column, width: int) -> DataFrame:
    """keys, band, block, power, smooth: third-octave powers of half-overlapping frames, their mean over each whole block of
    frames, and its exponential average over a key's blocks."""
    rows = power(frames(df, keys, order, value, size, size // 2, at, width), size, weights=band_weights(size, rate))
    bands = rows.select(*keys, F.floor(F.col("frame") / block).alias("block"), F.posexplode("power").alias("band", "p__"))
    means = bands.groupBy(*keys, "band", "block").agg(F.avg("p__").alias("power"), F.count("*").alias("n__")).where(F.col("n__") == block).drop("n__")
    means = kept(means)
    smooth = recurrence.scan(means, [*keys, "band"], ["block"], "power", recurrence.exponential(alpha), F.col("block"), 1 << 16, "smooth")
    return spread.joined(means, smooth, [*keys, "band", "block"])


def long_term(powers: DataFrame, keys: list[str], size: int, rate: float) -> DataFrame:
    """keys, frames, bands, centroid, bandwidth of frames' powers by bin: the mean spectrum's share of each third-octave
    band, its centre of gravity from 50 Hz on, and the highest frequency whose third octave is within 30 dB of the highest
    (both from 100 Hz on). A key without power has nulls.

    Sums by bin are a row each, so a key's frames are added up wherever they are; a key's spectrum then is one row.
    """
    step, bins = rate / size, size // 2 + 1
    weights = band_weights(size, rate)
    sums = powers.select(*keys, "frame", F.posexplode("power").alias("bin__", "p__")).groupBy(*keys, "bin__").agg(F.avg("p__").alias("p__"), F.count("*").alias("frames"))
    rows = sums.groupBy(*keys).agg(F.max("frames").alias("frames"), F.array_sort(F.collect_list(F.struct("bin__", "p__"))).alias("v__")).withColumn("x", F.col("v__.p__")).drop("v__")
    hz = np.arange(bins) * step
    # Bins of a third octave around each one.
    low = np.maximum(1, np.floor(hz / 2 ** (1 / 6) / step)).astype(int)
    high = np.maximum(low, np.minimum(bins - 1, np.ceil(hz * 2 ** (1 / 6) / step)).astype(int))

    def add(batch):
        x = batch.column("x").values.to_numpy()[: batch.num_rows * bins].reshape(-1, bins) if batch.num_rows else np.zeros((0, bins))
        share = x @ weights
        total = share.sum(axis=1)
        from_50 = hz >= 50
        weight = x[:, from_50].sum(axis=1)
        before = np.c_[np.zeros(len(x)), np.cumsum(x, axis=1)]
        level = (before[:, high + 1] - before[:, low]) / (high - low + 1) * hz
        level[:, hz < 100] = 0
        loud = (level >= 1e-3 * level.max(axis=1, keepdims=True)) & (level > 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            bands = share / total[:, None]
            centroid = (x[:, from_50] @ hz[from_50]) / weight
        top = np.where(loud, hz, 0).max(axis=1)
        none = total <= 0
        return [
            pa.array([None if n else b for n, b in zip(none.tolist(), bands.tolist(), strict=True)], pa.list_(pa.float64())),
            pa.array(centroid, mask=none | (weight <= 0)), pa.array(top, mask=none),
        ]

    return recurrence.mapped(rows, add, "bands array<double>, centroid double, bandwidth double", ("x",))


def flatness(power_column: Column, first: int, last: int) -> Column:
    """The geometric mean of some bins' powers by their arithmetic mean: 1 for white noise, near 0 for a tone."""
    own = F.transform(F.slice(power_column, first + 1, last - first + 1), lambda p: p + 1e-20)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.exp(add(F.transform(own, lambda p: F.log(p))) / F.size(own)) / (add(own) / F.size(own))
