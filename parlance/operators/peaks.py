"""Peaks between the values of a series: an interpolating filter whose taps reach over the borders of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import recurrence, spectra, spread

#: Taps of a phase, and the Kaiser window's parameter.
TAPS, BETA = 12, 8.0


def oversampling(rate: float) -> int:
    return 4 if rate <= 50_000 else 2 if rate <= 100_000 else 1


def phases(factor: int) -> np.ndarray:
    """The filter's taps for each phase (a row), for values from the oldest to the newest: a sinc under a Kaiser window."""
    centre = TAPS // 2 * factor
    at = np.arange(TAPS * factor) - centre
    taps = np.sinc(at / factor) * np.i0(BETA * np.sqrt(np.maximum(0, 1 - (at / centre) ** 2))) / np.i0(BETA)
    return taps.reshape(TAPS, factor)[::-1].T


def true_peaks(df: DataFrame, keys: list[str], order: list[str], value: str, block: int, factor: int, at: Column, width: int) -> DataFrame:
    """keys, block, sample_peak, true_peak of each block of so many values (the last may be shorter): the largest magnitude
    of the values, and of these and all phases between them. Before a key's first value there are zeros; a block gets the
    TAPS - 1 values before it from the block before. Null values count as 0. See spread.numbered()."""
    if block < TAPS:
        raise ValueError(f"a block has at least {TAPS} values")
    rows = spectra.hops(df, keys, order, value, block, at, width, rest=True)
    tails = rows.select(*keys, (F.col("hop") + 1).alias("hop"), F.slice("x", F.lit(block - TAPS + 2), F.lit(TAPS - 1)).alias("tail__"))
    both = spread.joined(rows, tails, [*keys, "hop"], "left")
    both = both.withColumn("tail__", F.coalesce("tail__", F.array_repeat(F.lit(0.0), TAPS - 1)))
    taps = phases(factor)

    def add(batch):
        peak, between = [], []
        for x, tail in zip(batch.column("x"), batch.column("tail__"), strict=True):
            own = x.values.to_numpy()
            every = np.lib.stride_tricks.sliding_window_view(np.r_[tail.values.to_numpy(), own], TAPS) @ taps.T
            peak.append(float(np.abs(own).max()))
            between.append(max(peak[-1], float(np.abs(every).max())))
        return [pa.array(peak, pa.float64()), pa.array(between, pa.float64())]

    return recurrence.mapped(both, add, "sample_peak double, true_peak double", ("x", "tail__")).withColumnRenamed("hop", "block")
