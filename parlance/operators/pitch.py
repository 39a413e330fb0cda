"""Pitch of framed series: the normalised difference of a frame and itself, moved, by way of its spectrum; tracks and their statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import recurrence, spread, stats
from parlance.operators.kept import kept

#: Bins of a histogram of tracks: SEMITONES wide, the first one's end so many semitones under REFERENCE_HZ.
BINS, SEMITONES, BELOW, REFERENCE_HZ = 12, 2, 6, 100.0


def normalised_differences(x: np.ndarray, window: int) -> np.ndarray:
    """For each lag up to the rest of a frame behind its window: the sum of squared differences by the mean of those so far; lag 0 is 1."""
    longest = x.shape[1] - window
    size = 1 << (x.shape[1] + window - 1).bit_length()
    head = np.zeros_like(x)
    head[:, :window] = x[:, :window]
    products = np.fft.irfft(np.conj(np.fft.rfft(head, size, axis=1)) * np.fft.rfft(x, size, axis=1), size, axis=1)[:, : longest + 1]
    energy = np.c_[np.zeros(len(x)), np.cumsum(x * x, axis=1)]
    moved = energy[:, window : window + longest + 1] - energy[:, : longest + 1]
    d = np.maximum(0, energy[:, [window]] + moved - 2 * products)
    d[:, 0] = 0
    run = np.cumsum(d, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(run > 0, d * np.arange(longest + 1) / run, 1.0)
    out[:, 0] = 1
    return out


def periods(cm: np.ndarray, first: int, last: int, threshold: float) -> np.ndarray:
    """Of each row the lag from first to last where it first falls under the threshold and then no further, between its
    neighbours by a parabola; NaN where none is."""
    own = cm[:, first : last + 1]
    under = own < threshold
    begin = under.argmax(axis=1)
    stops = np.c_[own[:, 1:] >= own[:, :-1], np.ones(len(own), bool)] & (np.arange(own.shape[1]) >= begin[:, None])
    best = stops.argmax(axis=1) + first
    rows, inner = np.arange(len(cm)), (best > 1) & (best + 1 < cm.shape[1])
    left, here, right = (cm[rows, np.clip(best + k, 0, cm.shape[1] - 1)] for k in (-1, 0, 1))
    bend = left - 2 * here + right
    with np.errstate(invalid="ignore", divide="ignore"):
        shift = np.where(inner & (np.abs(bend) > 1e-12), 0.5 * (left - right) / bend, 0.0)
    return np.where(under.any(axis=1), best + shift, np.nan)


def track(frames: DataFrame, keys: list[str], rate: float, window: int, low: float, high: float, threshold: float = 0.15) -> DataFrame:
    """keys, frame, hz of framed rows (see spectra.frames(); a frame is the window and the longest lag): null without a clear
    period between low and high hertz, or (nearly) without energy; then the median of the voiced ones among five frames."""

    def add(batch):
        column = batch.column("x")
        cuts = column.offsets.to_numpy()
        size = int(cuts[1] - cuts[0]) if batch.num_rows else window + 1
        x = column.values.to_numpy()[cuts[0] : cuts[-1]].reshape(-1, size)
        lag = periods(normalised_differences(x, window), int(rate / high), min(int(rate / low), size - window), threshold)
        quiet = (x[:, :window] ** 2).sum(axis=1) < 1e-9
        return [pa.array(rate / lag, mask=np.isnan(lag) | quiet)]

    raw = kept(recurrence.mapped(frames.select(*keys, "frame", "x"), add, "raw__ double", ("x",)))
    near = raw.where("raw__ is not null").withColumn("frame", F.explode(F.sequence(F.col("frame") - 2, F.col("frame") + 2)))
    values = F.array_sort(F.collect_list("raw__"))
    median = near.groupBy(*keys, "frame").agg(values.alias("v__")).select(*keys, "frame", F.element_at("v__", F.floor(F.size("v__") / 2).cast("int") + 1).alias("hz__"))
    out = spread.joined(raw, median, [*keys, "frame"], "left")
    return out.select(*keys, "frame", F.when(F.col("raw__").isNotNull(), F.col("hz__")).alias("hz"))


def track_statistics(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frames, voiced (their share), mean, p5, median, p95, semitones (from p5 to p95) and histogram (BINS shares) of tracks."""
    rows = kept(tracks)
    # least() passes over null, so that a null pitch needs a case of its own.
    bin_of = F.when(F.col("hz").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((12 * F.log2(F.col("hz") / REFERENCE_HZ) + BELOW + SEMITONES) / SEMITONES))))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("frames"), (F.count("hz") / F.count("*")).alias("voiced"), F.avg("hz").alias("mean"), F.when(F.count("hz") > 0, F.array(*(F.try_divide(F.count_if(bin_of == k), F.count("hz")) for k in range(BINS)))).alias("histogram"))
    parts = stats.quantiles(rows, keys, "hz", "frame", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    return spread.joined(whole, parts, keys, "left").withColumn("semitones", 12 * F.log2(F.col("p95") / F.col("p5")))
