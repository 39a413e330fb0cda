"""Array kernels over audio: synthetic speech-like signals, frame levels, activity, spectra, pitch, rates and loudness.

A recording is one row with its samples; kernels take batches of rows and give a row of features for each. Samples are
float arrays at a fixed rate; no row holds more than one recording, and long ones are cut into parts before they come here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, FRAME = 16_000, 160


def synthetic(speaker: int, recording: int, seconds: float, seed: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Voiced stretches (log-normal, 1.8 s) between pauses (log-normal, 0.3 s, exact silence), and where they are."""
    from parlance.operators.planning import generator

    rng = generator(seed, "audio", speaker, recording)
    x, regions, at = np.zeros(int(seconds * RATE)), [], 0
    pitch = 100.0 + 15 * speaker
    while at < len(x):
        at += int(RATE * max(0.08, rng.lognormal(np.log(0.3), 0.6)))
        end = min(len(x), at + int(RATE * rng.lognormal(np.log(1.8), 0.5)))
        if end - at > FRAME:
            t = np.arange(end - at) / RATE
            voice = sum(np.sin(2 * np.pi * pitch * k * t) / k for k in range(1, 12))
            x[at:end] = 0.05 * voice * (0.6 + 0.4 * np.sin(2 * np.pi * 4 * t)) + 0.001 * rng.standard_normal(end - at)
            regions.append((at, end))
        at = end
    return x, regions


def synthetic_corpus(spark: SparkSession, speakers: int, recordings: int, seconds: float, seed: int) -> DataFrame:
    """speaker, recording, samples, n_regions, speech_seconds; a recording depends only on its numbers and the seed."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in pdf["id"]:
                x, regions = synthetic(int(k) // recordings, int(k) % recordings, seconds, seed)
                rows.append((int(k) // recordings, int(k) % recordings, x.astype(np.float32), len(regions), sum(e - s for s, e in regions) / RATE))
            yield pd.DataFrame(rows, columns=["speaker", "recording", "samples", "n_regions", "speech_seconds"])

    return spark.range(speakers * recordings).mapInPandas(make, "speaker int, recording int, samples array<float>, n_regions int, speech_seconds double")


def frames(x: np.ndarray, size: int = FRAME) -> np.ndarray:
    return x[: len(x) // size * size].reshape(-1, size)


def levels(x: np.ndarray) -> np.ndarray:
    """Decibels of 10 ms frames."""
    return 10 * np.log10(np.maximum((frames(x) ** 2).mean(axis=1), 1e-12))


def activity(x: np.ndarray) -> np.ndarray:
    """Frames well over the noise (the tenth percentile) and not flat in spectrum; gaps under 80 ms are filled."""
    level = levels(x)
    power = np.abs(np.fft.rfft(frames(x) * np.hanning(FRAME), axis=1)) ** 2 + 1e-12
    flat = np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)
    on = (level > max(np.percentile(level, 10) + 10, -60)) & (flat < 0.5)
    edges = np.flatnonzero(np.diff(np.r_[True, on, True].astype(int)))
    for s, e in zip(edges[::2], edges[1::2], strict=False):
        if 0 < s and e < len(on) and e - s < 8:
            on[s:e] = True
    return on


def active_level(x: np.ndarray, margin: float = 15.9) -> tuple[float, float]:
    """Active speech level in dB and the share of time it is active: the envelope's threshold lies a margin under the level."""
    k = np.exp(-1 / (0.03 * RATE / FRAME))
    env = pd.Series(np.abs(frames(x)).mean(axis=1)).ewm(alpha=1 - k, adjust=False).mean().to_numpy()
    energy, best = float((x**2).sum()), (-200.0, 0.0)
    for threshold in 2.0 ** -np.arange(1, 16):
        share = float((env >= threshold).mean())
        if share > 0:
            level = 10 * np.log10(max(energy / (share * len(x)), 1e-20))
            if level - 20 * np.log10(threshold) >= margin:
                return level, share
            best = (level, share)
    return best


#: Third-octave bands 50 Hz to 5 kHz, as exponents of 10 ** (k / 10).
BANDS = list(range(17, 38))


def band_powers(x: np.ndarray, size: int = 2048) -> np.ndarray:
    """Mean power in each third-octave band."""
    power = (np.abs(np.fft.rfft(frames(x, size) * np.hanning(size), axis=1)) ** 2).mean(axis=0)
    hz = np.fft.rfftfreq(size, 1 / RATE)
    edge = lambda k: np.searchsorted(hz, 10 ** (k / 10))
    return np.array([power[edge(k - 0.5) : max(edge(k + 0.5), edge(k - 0.5) + 1)].sum() for k in BANDS])


def pitches(x: np.ndarray, low: float = 60.0, high: float = 400.0, size: int = 640) -> np.ndarray:
    """Pitch of frames by the normalised difference function's first deep minimum; 0 where unvoiced."""
    out = np.zeros(max(0, len(x) // size - 1))
    short, long = int(RATE / high), int(RATE / low)
    for k in range(len(out)):
        part = x[k * size : k * size + size + long]
        if len(part) < size + long or (part**2).mean() < 1e-6:
            continue
        d = np.array([((part[:size] - part[lag : lag + size]) ** 2).sum() for lag in range(long)])
        norm = d * np.arange(long) / np.maximum(np.cumsum(d), 1e-12)
        deep = np.flatnonzero(norm[short:] < 0.15)
        if len(deep):
            at = short + deep[0]
            while at + 1 < long and norm[at + 1] < norm[at]:
                at += 1
            out[k] = RATE / at
    return out


def speaking_rate(x: np.ndarray) -> float:
    """Peaks of the smoothed level, at least 100 ms apart, for each second of activity."""
    on, level = activity(x), pd.Series(levels(x)).rolling(9, center=True, min_periods=1).mean().to_numpy()
    peak = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] >= level[2:]) & on[1:-1]) + 1
    kept: list[int] = []
    for p in peak:
        if not kept or p - kept[-1] >= 10:
            kept.append(p)
    return len(kept) / max(on.sum() * FRAME / RATE, 1e-9)


def fingerprint(x: np.ndarray) -> np.ndarray:
    """32-bit words: the signs of the change over time of differences between neighbouring bands."""
    size, hop = 1024, 512
    n = max(0, (len(x) - size) // hop + 1)
    windows = np.lib.stride_tricks.sliding_window_view(x, size)[:: hop][:n] * np.hanning(size) if n else np.zeros((0, size))
    power = np.abs(np.fft.rfft(windows, axis=1)) ** 2
    cuts = np.geomspace(20, 256, 34).astype(int)
    bands = np.stack([power[:, a : max(b, a + 1)].sum(axis=1) for a, b in zip(cuts, cuts[1:], strict=False)], axis=1)
    change = np.diff(np.diff(bands, axis=1), axis=0)
    return ((change > 0) @ (1 << np.arange(change.shape[1], dtype=np.int64))).astype(np.int64)


def modulation(level: np.ndarray, rate: float = 100.0, bands: int = 16) -> np.ndarray:
    """Depths of an envelope's modulation in bands from 0.5 to 16 Hz."""
    env = 10 ** (level / 20)
    spectrum = np.abs(np.fft.rfft((env - env.mean()) * np.hanning(len(env)))) / max(env.mean() * len(env) / 4, 1e-12)
    hz, cuts = np.fft.rfftfreq(len(env), 1 / rate), np.geomspace(0.5, 16, bands + 1)
    return np.array([spectrum[(hz >= a) & (hz < b)].max(initial=0.0) for a, b in zip(cuts, cuts[1:], strict=False)])


def features(corpus: DataFrame, kernel: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """A kernel's values for each recording."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [kernel(np.asarray(x, float)) for x in pdf["samples"]]
            yield pd.concat([pdf[["speaker", "recording"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return corpus.select("speaker", "recording", "samples").mapInPandas(run, f"speaker int, recording int, {schema}")


def loudness_blocks(corpus: DataFrame) -> DataFrame:
    """speaker, recording, block, power, momentary: 100 ms blocks and the level of four in a row, undefined until there are four."""
    from pyspark.sql import Window

    blocks = features(corpus, lambda x: ([float(v) for v in (frames(x, RATE // 10) ** 2).mean(axis=1)],), "powers array<double>")
    rows = blocks.select("speaker", "recording", F.posexplode("powers").alias("block", "power"))
    by = Window.partitionBy("speaker", "recording").orderBy("block").rowsBetween(-3, 0)
    level = F.when(F.count("*").over(by) == 4, F.round(10 * F.log10(F.greatest(F.avg("power").over(by), F.lit(1e-12))), 4))
    return rows.select("speaker", "recording", "block", F.round("power", 9).alias("power"), level.alias("momentary"))
