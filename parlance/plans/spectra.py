"""Loudness and spectra of the series of each kind of event: few long keys, so that everything runs over stretches."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import loudness, peaks, pitch, series, spectra, spread, stats
from parlance.operators.intervals import micros
from parlance.operators.kept import kept
from parlance.plans.registry import DAY, Tables, query

#: Values of a block that stands for 100 ms, and the rate whose filters are used.
BLOCK, RATE = 8, 48_000.0
#: Values of a frame (half of it is a hop), frames of a block, and the share of a new block in the average.
SIZE, FRAMES, ALPHA = 64, 4, 0.1
_KEYS, _ORDER = ["event_type"], ["ts", "event_id"]

_NUMBERED = "n AS MATERIALIZED (SELECT event_type, value::DOUBLE AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)"


def _k_sql() -> str:
    """The two biquads a row after the other, and the power of whole blocks."""
    ((b0, b1, b2), (a1, a2)), ((c0, c1, c2), (d1, d2)) = loudness.stages(RATE)
    return f"""{_NUMBERED},
f(event_type, n, k, z1, z2, z3, z4) AS (
  SELECT DISTINCT event_type, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM n
  UNION ALL
  SELECT event_type, n, y, {b1!r} * x - {a1!r} * u + z2, {b2!r} * x - {a2!r} * u, {c1!r} * u - {d1!r} * y + z4, {c2!r} * u - {d2!r} * y
  FROM (SELECT *, {c0!r} * u + z3 AS y FROM (SELECT f.event_type, n.n, n.x, {b0!r} * n.x + f.z1 AS u, f.z2, f.z3, f.z4 FROM f JOIN n ON n.event_type = f.event_type AND n.n = f.n + 1) a) b),
b AS (SELECT event_type, (n - 1) // {BLOCK} AS block, avg(k * k) AS power FROM f WHERE n > 0 GROUP BY 1, 2 HAVING count(*) = {BLOCK}),
l AS (
  SELECT event_type, block, power, CASE WHEN count(*) OVER m = {loudness.MOMENTARY} THEN avg(power) OVER m END AS mean4, CASE WHEN count(*) OVER s = {loudness.SHORT_TERM} THEN avg(power) OVER s END AS mean30
  FROM b WINDOW m AS (PARTITION BY event_type ORDER BY block ROWS {loudness.MOMENTARY - 1} PRECEDING), s AS (PARTITION BY event_type ORDER BY block ROWS {loudness.SHORT_TERM - 1} PRECEDING))"""


def _lufs(power: str) -> str:
    return f"CASE WHEN {power} IS NOT NULL THEN {loudness.OFFSET} + 10 * log10(greatest({power}, 1e-30)) END"


def _levels(t: Tables):
    return loudness.levels(loudness.blocks(t.events, _KEYS, _ORDER, "value", RATE, BLOCK, micros("ts"), DAY), _KEYS)


@query(f"WITH RECURSIVE {_k_sql()} SELECT event_type, block, round({_lufs('power')}, 6) AS level, round({_lufs('mean4')}, 6) AS momentary, round({_lufs('mean30')}, 6) AS short_term FROM l")
def stream_meters(t: Tables):
    """K-weighted levels of blocks, of the last four, and of the last thirty; undefined until there are so many."""
    return _levels(t).select("event_type", "block", F.round(loudness.lufs(F.col("power")), 6).alias("level"), F.round("momentary", 6).alias("momentary"), F.round("short_term", 6).alias("short_term"))


@query(f"""
WITH RECURSIVE {_k_sql()}, m AS (SELECT event_type, mean4, {_lufs('mean4')} AS level FROM l WHERE mean4 IS NOT NULL),
g AS (SELECT event_type, {_lufs('avg(mean4)')} + {loudness.RELATIVE} AS gate FROM m WHERE level > {loudness.ABSOLUTE} GROUP BY 1)
SELECT event_type, count(*) AS gated, round({_lufs('avg(mean4)')}, 6) AS integrated FROM m JOIN g USING (event_type) WHERE level > {loudness.ABSOLUTE} AND level > gate GROUP BY 1
""")
def integrated_loudness(t: Tables):
    """The level of all momentary powers over an absolute and a relative gate."""
    return loudness.integrated(_levels(t), _KEYS).select("event_type", "gated", F.round("integrated", 6).alias("integrated"))


#: Frames under a Hann window, one-sided powers of their bins by the direct transform, and the bins' shares in bands.
_BINS = f"""{_NUMBERED},
c AS (SELECT event_type, (n - 1) // {SIZE // 2} - d AS frame, (n - 1) % {SIZE // 2} + d * {SIZE // 2} AS pos, x FROM n, (SELECT unnest([0, 1]) AS d) s WHERE (n - 1) // {SIZE // 2} >= d),
w AS (SELECT event_type, frame, pos, x FROM c QUALIFY count(*) OVER (PARTITION BY event_type, frame) = {SIZE}),
p AS MATERIALIZED (SELECT event_type, frame, k, 2 / ({SIZE} * {SIZE * 3 / 8}) * (pow(sum(h * x * cos(2 * pi() * k * pos / {SIZE})), 2) + pow(sum(h * x * sin(2 * pi() * k * pos / {SIZE})), 2)) AS p
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * pos / {SIZE}) AS h FROM w) a, (SELECT unnest(range({SIZE // 2 + 1})) AS k) g GROUP BY 1, 2, 3)"""
_STEP = RATE / SIZE
_WEIGHTS = f"""e AS (SELECT band, pow(10, (band + {spectra.BANDS[0]} - 0.5) / 10) AS lo, least(pow(10, (band + {spectra.BANDS[0]} + 0.5) / 10), {RATE / 2}) AS hi FROM (SELECT unnest(range({len(spectra.BANDS)})) AS band)),
s AS (SELECT band, k, (least(hi, (k + 0.5) * {_STEP}) - greatest(lo, (k - 0.5) * {_STEP})) / {_STEP} AS share FROM e, (SELECT unnest(range({SIZE // 2 + 1})) AS k) g WHERE (k + 0.5) * {_STEP} > lo AND (k - 0.5) * {_STEP} < hi)"""


def _powers(t: Tables):
    return spectra.power(spectra.frames(t.events, _KEYS, _ORDER, "value", SIZE, SIZE // 2, micros("ts"), DAY), SIZE)


@query(f"""
WITH {_BINS}, {_WEIGHTS}, f AS (SELECT event_type, frame, band, sum(p * share) AS p FROM p JOIN s USING (k) GROUP BY 1, 2, 3),
b AS (SELECT event_type, band, frame // {FRAMES} AS block, avg(p) AS power FROM f GROUP BY 1, 2, 3 HAVING count(*) = {FRAMES})
SELECT a.event_type, a.band, a.block, round(10 * log10(greatest(a.power, 1e-30)), 6) AS level_db,
  round(10 * log10(greatest(sum(c.power * pow({1 - ALPHA}, a.block - c.block) * CASE WHEN c.block = 0 THEN 1.0 ELSE {ALPHA} END), 1e-30)), 6) AS smooth_db
FROM b a JOIN b c ON c.event_type = a.event_type AND c.band = a.band AND c.block <= a.block GROUP BY a.event_type, a.band, a.block, a.power
""")
def spec_blocks(t: Tables):
    """Third-octave levels of blocks of frames, and their slow average."""
    rows = spectra.block_spectra(t.events, _KEYS, _ORDER, "value", RATE, SIZE, FRAMES, ALPHA, micros("ts"), DAY)
    db = lambda c: F.round(10 * F.log10(F.greatest(F.col(c), F.lit(1e-30))), 6)
    return rows.select("event_type", F.col("band").cast("long").alias("band"), "block", db("power").alias("level_db"), db("smooth").alias("smooth_db"))


@query(f"""
WITH {_BINS}, {_WEIGHTS}, m AS (SELECT event_type, k, avg(p) AS p, count(*) AS frames FROM p GROUP BY 1, 2),
b AS (SELECT event_type, band, sum(p * share) AS p FROM m JOIN s USING (k) GROUP BY 1, 2),
o AS (SELECT event_type, list(round(10 * log10(greatest(p / total, 1e-12)), 6) ORDER BY band) AS levels FROM (SELECT *, sum(p) OVER (PARTITION BY event_type) AS total FROM b) GROUP BY 1),
z AS (SELECT event_type, max(frames) AS frames, sum(k * {_STEP} * p) FILTER (WHERE k * {_STEP} >= 50) / sum(p) FILTER (WHERE k * {_STEP} >= 50) AS centroid FROM m GROUP BY 1),
v AS (SELECT a.event_type, a.k, avg(x.p) * a.k * {_STEP} AS level FROM m a JOIN m x ON x.event_type = a.event_type
  AND x.k >= greatest(1, floor(a.k / pow(2, 1 / 6))) AND x.k <= ceil(a.k * pow(2, 1 / 6)) WHERE a.k * {_STEP} >= 100 GROUP BY 1, 2),
y AS (SELECT event_type, max(k) FILTER (WHERE level >= 1e-3 * top) * {_STEP} AS bandwidth FROM (SELECT *, max(level) OVER (PARTITION BY event_type) AS top FROM v) GROUP BY 1)
SELECT event_type, frames, array_to_string(levels, ' ') AS levels, round(centroid, 4) AS centroid, round(bandwidth, 4) AS bandwidth FROM o JOIN z USING (event_type) JOIN y USING (event_type)
""")
def feat_ltass(t: Tables):
    """The long-term average spectrum: 26 levels in dB of its sum, its centroid, and its bandwidth."""
    rows = spectra.long_term(_powers(t), _KEYS, SIZE, RATE)
    levels = F.transform("bands", lambda p: F.round(10 * F.log10(F.greatest(p, F.lit(1e-12))), 6))
    return rows.select("event_type", "frames", F.array_join(levels, " ").alias("levels"), F.round("centroid", 4).alias("centroid"), F.round("bandwidth", 4).alias("bandwidth"))


@query(f"""
WITH {_BINS}, l AS (SELECT event_type, frame, 10 * log10(greatest(sum(p), 1e-12)) AS level, exp(avg(ln(p + 1e-20)) FILTER (WHERE k BETWEEN 1 AND 5)) / avg(p + 1e-20) FILTER (WHERE k BETWEEN 1 AND 5) AS flat FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY level, frame) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM l),
q AS (SELECT event_type, min(level) FILTER (WHERE place = floor(0.1 * n) + 1) AS floor_db FROM r GROUP BY 1)
SELECT event_type, count(*) AS frames, count(*) FILTER (WHERE level > floor_db + 1.0 AND flat < 0.5) AS active, round(any_value(floor_db), 6) AS floor_db FROM l JOIN q USING (event_type) GROUP BY 1
""")
def feat_vad(t: Tables):
    """Frames that are over the level with a tenth of all under it, and whose spectrum isn't flat from 200 Hz to 4 kHz."""
    total = F.aggregate("power", F.lit(0.0), lambda s, p: s + p)
    first, last = -(-200 * SIZE // int(RATE)), 4000 * SIZE // int(RATE)
    rows = kept(_powers(t).select("event_type", "frame", series.level(total).alias("level"), spectra.flatness(F.col("power"), first, last).alias("flat")))
    floors = stats.floor_percentile(rows, _KEYS, "level", "frame", 0.1).withColumnRenamed("floor_percentile", "floor_db")
    active = (F.col("level") > F.col("floor_db") + 1.0) & (F.col("flat") < 0.5)
    return spread.joined(rows, floors, _KEYS).groupBy("event_type").agg(F.count("*").alias("frames"), F.count_if(active).alias("active"), F.round(F.first("floor_db"), 6).alias("floor_db"))


def _taps_sql() -> str:
    taps = peaks.phases(4)
    return ", ".join(f"({j}, {peaks.TAPS - 1 - i}, {float(c)!r})" for j, row in enumerate(taps) for i, c in enumerate(row))


@query(f"""
WITH {_NUMBERED}, c(phase, back, tap) AS (VALUES {_taps_sql()}),
y AS (SELECT a.event_type, a.n, phase, sum(tap * b.x) AS y FROM n a JOIN c ON true JOIN n b ON b.event_type = a.event_type AND b.n = a.n - back GROUP BY 1, 2, 3)
SELECT a.event_type, (a.n - 1) // 100 AS block, round(max(abs(a.x)), 6) AS sample_peak, round(greatest(max(abs(a.x)), max(abs(y))), 6) AS true_peak FROM n a JOIN y ON y.event_type = a.event_type AND y.n = a.n GROUP BY 1, 2
""")
def true_peak(t: Tables):
    """The peaks of blocks of 100 values, also between them, at four times their rate."""
    rows = peaks.true_peaks(t.events, _KEYS, _ORDER, "value", 100, 4, micros("ts"), DAY)
    return rows.select("event_type", "block", F.round("sample_peak", 6).alias("sample_peak"), F.round("true_peak", 6).alias("true_peak"))


#: Frames of 64 values at 1,000 a second: a window of 40 and lags up to 24, a frame every 16 values.
_WINDOW, _PITCH_RATE, _LOW, _HIGH, _CLEAR = 40, 1_000.0, 42.0, 400.0, 0.7


def _tracks(t: Tables):
    framed = spectra.frames(t.events, _KEYS, _ORDER, "value", SIZE, 16, micros("ts"), DAY)
    return pitch.track(framed, _KEYS, _PITCH_RATE, _WINDOW, _LOW, _HIGH, _CLEAR)


_FIRST, _LAST = int(_PITCH_RATE / _HIGH), int(_PITCH_RATE / _LOW)
_TRACK = f"""{_NUMBERED},
c AS (SELECT event_type, (n - 1) // 16 - d AS frame, (n - 1) % 16 + d * 16 AS pos, x FROM n, (SELECT unnest([0, 1, 2, 3]) AS d) s WHERE (n - 1) // 16 >= d),
w AS MATERIALIZED (SELECT event_type, frame, pos, x FROM c QUALIFY count(*) OVER (PARTITION BY event_type, frame) = {SIZE}),
d AS (SELECT a.event_type, a.frame, lag, sum((a.x - b.x) * (a.x - b.x)) AS d FROM w a, (SELECT unnest(range(1, {SIZE - _WINDOW + 1})) AS lag) g, w b
  WHERE a.pos < {_WINDOW} AND b.event_type = a.event_type AND b.frame = a.frame AND b.pos = a.pos + lag GROUP BY 1, 2, 3),
m AS MATERIALIZED (SELECT event_type, frame, lag, d * lag / sum(d) OVER (PARTITION BY event_type, frame ORDER BY lag) AS cm FROM d),
b AS (SELECT event_type, frame, min(lag) AS begin FROM m WHERE cm < {_CLEAR} AND lag BETWEEN {_FIRST} AND {_LAST} GROUP BY 1, 2),
s AS (SELECT *, lead(cm) OVER v AS after, lag(cm) OVER v AS before FROM m WINDOW v AS (PARTITION BY event_type, frame ORDER BY lag)),
p AS (SELECT event_type, frame, min(lag) AS best FROM s JOIN b USING (event_type, frame) WHERE lag >= begin AND (lag = {_LAST} OR lag <= {_LAST} AND after >= cm) GROUP BY 1, 2),
r AS (SELECT event_type, frame, {_PITCH_RATE} / (best + CASE WHEN after IS NOT NULL AND best > 1 AND abs(before - 2 * cm + after) > 1e-12 THEN 0.5 * (before - after) / (before - 2 * cm + after) ELSE 0 END) AS raw
  FROM p JOIN s USING (event_type, frame) WHERE lag = best),
h AS (SELECT a.event_type, a.frame, list_sort(list(b.raw)) AS v FROM r a JOIN r b ON b.event_type = a.event_type AND b.frame BETWEEN a.frame - 2 AND a.frame + 2 GROUP BY 1, 2),
t AS (SELECT w.event_type, w.frame, v[len(v) // 2 + 1] AS hz FROM (SELECT DISTINCT event_type, frame FROM w) w LEFT JOIN h USING (event_type, frame))"""


@query(f"WITH {_TRACK} SELECT event_type, frame, round(hz, 4) AS hz FROM t")
def pitch_track(t: Tables):
    """The pitch of each frame, null where there is none."""
    return _tracks(t).select("event_type", "frame", F.round("hz", 4).alias("hz"))


@query(f"""
WITH {_TRACK}, k AS (SELECT event_type, greatest(0, least({pitch.BINS - 1}, floor((12 * log2(hz / {pitch.REFERENCE_HZ}) + {pitch.BELOW + pitch.SEMITONES}) / {pitch.SEMITONES}))) AS bin, count(*) AS n FROM t WHERE hz IS NOT NULL GROUP BY 1, 2),
f AS (SELECT e.event_type, string_agg((round(1000 * coalesce(n, 0) / total))::BIGINT, ' ' ORDER BY g) AS histogram FROM (SELECT event_type, sum(n) AS total FROM k GROUP BY 1) e
  CROSS JOIN (SELECT unnest(range({pitch.BINS})) AS g) LEFT JOIN k ON k.event_type = e.event_type AND k.bin = g GROUP BY 1)
SELECT event_type, count(*) AS frames, round(count(hz) / count(*), 6) AS voiced, round(avg(hz), 4) AS mean, round(quantile_cont(hz, 0.05), 4) AS p5, round(quantile_cont(hz, 0.5), 4) AS median,
  round(quantile_cont(hz, 0.95), 4) AS p95, round(12 * log2(quantile_cont(hz, 0.95) / quantile_cont(hz, 0.05)), 4) AS semitones, any_value(histogram) AS histogram FROM t LEFT JOIN f USING (event_type) GROUP BY 1
""")
def feat_f0(t: Tables):
    """Statistics and histogram (in thousandths) of the pitch of each kind of event."""
    rows = pitch.track_statistics(_tracks(t), _KEYS)
    bins = F.array_join(F.transform("histogram", lambda p: F.round(1000 * p).cast("long")), " ")
    return rows.select("event_type", "frames", F.round("voiced", 6).alias("voiced"), *(F.round(c, 4).alias(c) for c in ("mean", "p5", "median", "p95", "semitones")), bins.alias("histogram"))
