"""Recurrences, loudness and spectra against plain loops and signals whose answers are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import loudness, peaks, pitch, recurrence, spectra

RATE = 48_000


def walked(system, x):
    state, out = system.first * x[0], []
    for v in x:
        out.append(float(system.c @ state + system.d * v))
        state = system.a @ state + system.b * v
    return out


@pytest.mark.parametrize("system", [recurrence.exponential(0.2), loudness.k_weighting(RATE), recurrence.exponential(0.5).then(recurrence.exponential(0.1))])
def test_scan_is_the_recurrence(spark, monkeypatch, system):
    """Keys of many groups of stretches, of one stretch, null and empty ones; null values are 0, extra columns are left out."""
    monkeypatch.setattr(recurrence, "STRETCH", 16)
    monkeypatch.setattr(recurrence, "GROUP", 4)
    rng = np.random.default_rng(0)
    rows = [(k, t, float(rng.standard_normal()), 1) for k, n in (("a", 700), ("b", 15), (None, 33), ("c", 1)) for t in range(n)]
    rows = [(k, t, None if t % 50 == 7 else x, n) for k, t, x, n in rows]
    df = spark.createDataFrame(rows, "k string, t long, x double, n__ int").repartition(5)
    got = recurrence.scan(df, ["k"], ["t"], "x", system, F.col("t"), 50, place="at").collect()
    assert len(got) == len(rows)
    for key in ("a", "b", "c", None):
        own = sorted((r["t"], r.y, r["at"]) for r in got if r.k == key)
        want = walked(system, [x or 0.0 for k, _, x, _ in rows if k == key])
        assert [p for _, _, p in own] == list(range(1, len(want) + 1))
        assert np.allclose([y for _, y, _ in own], want, rtol=1e-11, atol=1e-11)
    assert recurrence.scan(df.limit(0), ["k"], ["t"], "x", system, F.col("t"), 50).count() == 0


def test_nothing_is_too_far_back(spark):
    df = spark.createDataFrame([("a", t, 1e30 if t == 0 else 0.0) for t in range(401)], "k string, t long, x double")
    last = recurrence.scan(df, ["k"], ["t"], "x", recurrence.exponential(0.2), F.col("t"), 50).orderBy(F.desc("t")).first()
    assert math.isclose(last.y, 1e30 * 0.8**400, rel_tol=1e-9)


def test_k_weighting_is_the_standard_one():
    (b, a), (c, d) = loudness.stages(RATE)
    assert np.allclose([*b, *a], [1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585], atol=1e-6)
    assert np.allclose([*c, *d], [1.0, -2.0, 1.0, -1.99004745483398, 0.99007225036621], atol=1e-6)


def sine(spark, parts, hz=1_000.0):
    """ch, t, x: a sine on two channels; parts: (level of its peak in dB, seconds)."""
    ends = np.cumsum([round(s * RATE) for _, s in parts]).tolist()
    t = F.col("t")
    gain = F.coalesce(*(F.when(t < e, F.lit(10 ** (level / 20))) for (level, _), e in zip(parts, ends, strict=True)))
    rows = spark.range(ends[-1]).withColumnRenamed("id", "t").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("ch"), "t")
    return rows.withColumn("x", gain * F.sin(2 * math.pi * hz / RATE * t))


def test_loudness_of_sines(spark):
    """A full-scale sine of 1 kHz on two channels reads its peak level; one channel is 3.01 less; quiet parts don't count."""
    for parts, want, channels in (([(-23.0, 4.0)], -23.0, 2), ([(-23.0, 4.0)], -26.01, 1), ([(-72.0, 1.0), (-36.0, 1.0), (-23.0, 20.0), (-36.0, 1.0)], -26.01, 1)):
        df = sine(spark, parts).where(F.col("ch") < channels)
        powers = loudness.blocks(df, ["ch"], ["t"], "x", RATE, RATE // 10, F.col("t"), RATE)
        summed = powers.groupBy("block").agg(F.sum("power").alias("power")).withColumn("k", F.lit(0))
        leveled = loudness.levels(summed, ["k"])
        rows = leveled.orderBy("block").collect()
        assert [r.momentary is None for r in rows[:5]] == [True] * 3 + [False] * 2
        assert [r.short_term is None for r in rows[28:31]] == [True, False, False]
        assert abs(loudness.integrated(leveled, ["k"]).first().integrated - want) < 0.1
        if len(parts) == 1:
            assert abs(rows[-1].momentary - want) < 0.1 and abs(rows[-1].short_term - want) < 0.1


def test_silence_has_no_integrated_level(spark):
    df = spark.range(RATE).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.lit(0.0).alias("x"))
    leveled = loudness.levels(loudness.blocks(df, ["k"], ["t"], "x", RATE, RATE // 10, F.col("t"), RATE), ["k"])
    assert loudness.integrated(leveled, ["k"]).count() == 0


def test_frames_reach_over_borders(spark):
    rows = [(k, t, float(t)) for k, n in (("a", 203), (None, 20), ("b", 7)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(4)
    got = {(r.k, r.frame): r.x for r in spectra.frames(df, ["k"], ["t"], "x", 16, 4, F.col("t"), 10).collect()}
    want = {(k, f): [float(x) for x in range(4 * f, 4 * f + 16)] for k, n in (("a", 203), (None, 20)) for f in range((n - 16) // 4 + 1)}
    assert got == want
    with pytest.raises(ValueError, match="divide"):
        spectra.frames(df, ["k"], ["t"], "x", 16, 5, F.col("t"), 10)


def test_calibration(spark):
    """A sine of 0.5 at 1 kHz has 0.125 in its band and in all; white noise has power in proportion to a band's width."""
    size, t = 8_192, F.col("id")
    df = spark.range(4 * RATE).select(F.lit("sine").alias("k"), t.alias("t"), (0.5 * F.sin(2 * math.pi * 1_000 / RATE * t)).alias("x"))
    noise = np.random.default_rng(3).standard_normal(20 * RATE) * 0.2
    files = [("noise", i * 4_096, noise[i * 4_096 : (i + 1) * 4_096].tolist()) for i in range(len(noise) // 4_096)]
    more = spark.createDataFrame(files, "k string, at long, v array<double>").select("k", F.posexplode("v").alias("p", "x"), "at").select("k", (F.col("at") + F.col("p")).alias("t"), "x")
    rows = spectra.power(spectra.frames(df.unionByName(more), ["k"], ["t"], "x", size, size // 2, F.col("t"), RATE), size, weights=spectra.band_weights(size, RATE))
    bands = rows.select("k", F.posexplode("power").alias("band", "p")).groupBy("k", "band").agg(F.avg("p").alias("p")).collect()
    found = {(r.k, r.band): r.p for r in bands}
    db = lambda p: 10 * math.log10(p)
    assert abs(db(found["sine", 13]) - db(0.125)) < 0.05
    assert abs(db(sum(found["sine", b] for b in range(26))) - db(0.125)) < 0.05
    for band in range(6, 24):
        low, high = spectra.edges(17 + band)
        assert abs(db(found["noise", band]) - db(0.04 * (high - low) / (RATE / 2))) < 0.35


def test_long_term_spectrum_and_flatness(spark):
    size, t = 512, F.col("id")
    tone = spark.range(size * 20).select(F.lit("tone").alias("k"), t.alias("t"), F.sin(2 * math.pi * 3_000 / RATE * t).alias("x"))
    noise = np.random.default_rng(4).standard_normal(size * 20)
    white = spark.createDataFrame([("white", k, float(x)) for k, x in enumerate(noise)], "k string, t long, x double")
    none = spark.range(size * 2).select(F.lit("none").alias("k"), t.alias("t"), F.lit(0.0).alias("x"))
    rows = spectra.power(spectra.frames(tone.unionByName(white).unionByName(none), ["k"], ["t"], "x", size, size // 2, F.col("t"), 1_000), size).cache()
    long = {r.k: r for r in spectra.long_term(rows, ["k"], size, RATE).collect()}
    assert long["none"].bands is None and long["none"].centroid is None
    assert abs(long["tone"].centroid - 3_000) < 20 and np.argmax(long["tone"].bands) == 18 and abs(sum(long["tone"].bands) - 1) < 1e-9
    assert abs(long["white"].centroid - RATE / 4) < 500 and long["white"].bandwidth > 23_000 and long["tone"].bandwidth < 5_000
    flat = {r.k: r.f for r in rows.groupBy("k").agg(F.avg(spectra.flatness(F.col("power"), 3, 42)).alias("f")).collect()}
    assert flat["tone"] < 0.1 < 0.45 < flat["white"]


def test_peaks_between_values(spark, monkeypatch):
    """A sine of a quarter of the rate, whose values are all 1, has peaks of the root of 2; taps reach over blocks and keys begin at rest."""
    n, t = 2_003, F.col("id")
    wave = spark.range(n).select(F.lit("sine").alias("k"), t.alias("t"), (math.sqrt(2) * F.sin(math.pi / 2 * t + math.pi / 4)).alias("x"))
    odd = spark.createDataFrame([(None, 0, -3.0), ("one", 0, None)], "k string, t long, x double")
    for block in (12, 100, 5_000):
        got = {(r.k, r.block): r for r in peaks.true_peaks(wave.unionByName(odd), ["k"], ["t"], "x", block, 4, F.col("t"), 64).collect()}
        assert len(got) == -(-n // block) + 2
        inner = [r for (k, b), r in got.items() if k == "sine" and b * block >= 100 or block == 5_000 and k == "sine"]
        assert all(abs(20 * math.log10(max(r.true_peak for r in inner)) - 3.01) < 0.3 and abs(r.sample_peak - 1) < 1e-9 for r in inner)
        assert got[None, 0].true_peak >= 3.0 == got[None, 0].sample_peak and got["one", 0].true_peak == 0.0
    rng = np.random.default_rng(1)
    x = rng.standard_normal(250)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "k string, t long, x double")
    full = np.abs(np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(11), x], 12) @ peaks.phases(4).T).max(axis=1)
    got = peaks.true_peaks(df, ["k"], ["t"], "x", 20, 4, F.col("t"), 7).orderBy("block").collect()
    assert np.allclose([r.true_peak for r in got], [max(full[s : s + 20].max(), np.abs(x[s : s + 20]).max()) for s in range(0, 250, 20)])
    assert peaks.oversampling(48_000) == 4 and peaks.oversampling(96_000) == 2 and peaks.oversampling(192_000) == 1


def test_pitch_of_sines(spark):
    """Tones of known pitch at 16 kHz, noise and silence."""
    rate, seconds = 16_000, 0.5
    rng = np.random.default_rng(2)
    n = int(rate * seconds)
    series = {"a": 0.5 * np.sin(2 * np.pi * 110.0 / rate * np.arange(n)), "b": 0.1 * np.sin(2 * np.pi * 233.1 / rate * np.arange(n)), "noise": rng.standard_normal(n), "none": np.zeros(n)}
    rows = [(k, s // 500, x[s : s + 500].tolist()) for k, x in series.items() for s in range(0, n, 500)]
    df = spark.createDataFrame(rows, "k string, part long, v array<double>").select("k", F.posexplode("v").alias("p", "x"), "part").select("k", (F.col("part") * 500 + F.col("p")).alias("t"), "x")
    framed = spectra.frames(df, ["k"], ["t"], "x", 960, 160, F.col("t"), rate)
    tracks = pitch.track(framed, ["k"], rate, 640, 60.0, 400.0)
    found = {r.k: r for r in pitch.track_statistics(tracks, ["k"]).collect()}
    assert found["a"].voiced == found["b"].voiced == 1.0 and found["none"].voiced == 0.0 and found["none"].histogram is None and found["noise"].voiced < 0.2
    for k, hz in (("a", 110.0), ("b", 233.1)):
        assert abs(found[k].mean - hz) < 0.2 and abs(found[k].p5 - hz) < 0.5 and abs(found[k].semitones) < 0.1
        assert abs(sum(found[k].histogram) - 1) < 1e-12 and found[k].histogram[int((12 * math.log2(hz / 100) + 8) // 2)] == 1.0


def test_differences_by_definition():
    x = np.random.default_rng(3).standard_normal((5, 64))
    cm = pitch.normalised_differences(x, 40)
    for row, own in zip(x, cm, strict=True):
        d = [sum((row[:40] - row[k : k + 40]) ** 2) for k in range(25)]
        assert np.allclose(own[1:], [d[k] * k / sum(d[1 : k + 1]) for k in range(1, 25)])
