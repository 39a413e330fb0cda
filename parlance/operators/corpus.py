"""The corpus job: scanned recordings to features, quality classes, exact copies, speaker aggregates and a version."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.functions import signal

FEATURES = "seconds double, level_db double, share double, snr_db double, pitch_hz double, voiced long, clipped double, pcm string"


def measure(x: np.ndarray, rate: int) -> tuple:
    """A recording's features; pcm is a hash of its 16-bit samples."""
    import hashlib

    level, on = signal.levels(x), signal.activity(x)
    active, share = signal.active_level(x)
    pitch = signal.pitches(x)
    voiced = pitch[pitch > 0]
    snr = float(level[on].mean() - np.percentile(level, 10)) if on.any() else 0.0
    peak = np.abs(x).max(initial=0.0)
    clipped = float((np.abs(x) >= peak - 1e-7).mean()) if peak > 0.99 else 0.0
    pcm = hashlib.sha256(np.clip(np.round(x * 32767), -32768, 32767).astype("<i2").tobytes()).hexdigest()
    return len(x) / rate, active, share, snr, float(np.median(voiced)) if len(voiced) else 0.0, len(voiced), clipped, pcm


def analysed(recordings: DataFrame) -> DataFrame:
    """(path, rate, samples) to features, one row for each recording that has samples."""
    import pandas as pd

    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [measure(np.asarray(x, float), int(r)) for x, r in zip(pdf["samples"], pdf["rate"], strict=True)]
            yield pd.concat([pdf[["path", "rate"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return recordings.select("path", "rate", "samples").mapInPandas(run, f"path string, rate int, {FEATURES}")


def classified(rows: DataFrame, least_rate: int = 32_000, least_seconds: float = 10.0) -> DataFrame:
    """Hard rules reject; signal-to-noise ratio, activity and clipping lower a score of 100; under 50 rejects, from 80 is good."""
    hard = [(F.col("rate") < least_rate, "reject.rate"), (F.col("clipped") > 1e-4, "reject.clipping"), (F.col("snr_db") < 25, "reject.snr"), (F.col("share") < 0.3, "reject.activity"), (F.col("seconds") < least_seconds, "reject.short")]
    soft = [(F.col("snr_db") < 35, "warn.snr"), (F.col("share") < 0.6, "warn.activity"), (F.col("seconds") < 30, "warn.short")]
    score = C.clamp(100 - C.total([C.penalty(F.col("snr_db"), 35, 25, 40.0), C.penalty(F.col("share"), 0.6, 0.3, 20.0), C.penalty(F.col("clipped"), 1e-5, 1e-4, 20.0)]), 0.0, 100.0)
    refused = C.reasons(hard)
    low = (F.size(refused) == 0) & (score < 50)
    codes = F.concat(refused, C.reasons(soft), F.when(low, F.array(F.lit("reject.quality"))).otherwise(F.array().cast("array<string>")))
    named = F.when((F.size(refused) > 0) | low, "rejected").when(score >= 80, "good").otherwise("usable")
    return rows.withColumns({"score": F.round(score, 3), "class": named, "codes": codes})


def without_copies(rows: DataFrame) -> DataFrame:
    """Later recordings with the samples of an earlier one are rejected, also where the first was rejected itself."""
    first = F.min("path").over(Window.partitionBy("pcm"))
    copy = F.col("path") != first
    return rows.withColumns({"class": F.when(copy, "rejected").otherwise(F.col("class")), "codes": F.when(copy, F.array_append("codes", F.lit("reject.duplicate"))).otherwise(F.col("codes"))})


def speakers(rows: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Speaker aggregates of usable recordings, weighted by active seconds."""
    used = rows.where(F.col("class") != "rejected").withColumn("w", F.greatest(F.col("seconds") * F.col("share"), F.lit(1e-3)))
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c)
    return used.groupBy(speaker).agg(F.count("*").alias("recordings"), F.sum("w").alias("speech_seconds"), mean("level_db"), mean("snr_db"), mean("score"), mean("pitch_hz"))


def speaker_of(rows: DataFrame, table: DataFrame) -> DataFrame:
    """A recording's speaker: by its path in the table, by its file name there, or its folder."""
    path = F.regexp_replace("path", "^file:/*", "/")
    name, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    by_path = table.select(F.col("file").alias("f1__"), F.col("speaker").alias("s1__"))
    by_name = table.select(F.col("file").alias("f2__"), F.col("speaker").alias("s2__"))
    both = rows.join(by_path, path == F.col("f1__"), "left").join(by_name, name == F.col("f2__"), "left")
    return both.withColumn("speaker", F.coalesce("s1__", "s2__", folder)).drop("f1__", "f2__", "s1__", "s2__")
