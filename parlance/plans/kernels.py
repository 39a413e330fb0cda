"""Feature kernels over the series of events of each user; the tests hold those over audio against signals whose answers are known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from parlance.operators import series as S
from parlance.plans.registry import DAY, Tables, query, spans

_F = """s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
f AS (SELECT user_id, i // 8 AS frame, i % 8 AS pos, value::DOUBLE AS x FROM s QUALIFY count(*) OVER (PARTITION BY user_id, i // 8) = 8)"""
_L = f"""{_F}, l AS (SELECT user_id, frame, 10 * log10(greatest(avg(x * x), 1e-12)) AS level, max(abs(x)) AS peak FROM f GROUP BY 1, 2),
a AS (SELECT *, level > floor + 3.0 AS active FROM l JOIN (SELECT user_id, quantile_cont(level, 0.1) AS floor FROM l GROUP BY 1) q USING (user_id))"""
_P = f"""{_F}, k AS (SELECT unnest(range(1, 5)) AS k),
p AS (SELECT user_id, frame, k, pow(sum(x * cos(2 * pi() * k * pos / 8)), 2) + pow(sum(x * sin(2 * pi() * k * pos / 8)), 2) AS p FROM f, k GROUP BY 1, 2, 3)"""
_D = f"""{_L}, d AS (SELECT u.user_id, u.frame, lag, avg((u.x - v.x) * (u.x - v.x)) AS d FROM f u, (SELECT unnest(range(1, 5)) AS lag) g, f v
  WHERE v.user_id = u.user_id AND v.frame = u.frame AND v.pos = u.pos + lag GROUP BY 1, 2, 3),
v AS (SELECT user_id, frame, arg_min(lag, [d, lag]) AS lag, min(d) / greatest(avg(d), 1e-12) AS depth FROM d GROUP BY 1, 2)"""


def _frames(t: Tables):
    return S.framed(spans(t), "user_id", ["t0", "event_id"], F.col("t0"), "value", DAY)


def _powers(t: Tables):
    """user_id, frame, k, p: the power of each harmonic of each frame."""
    return _frames(t).select("user_id", "frame", F.posexplode(F.array(*S.band_powers(F.col("x")))).alias("k", "p")).withColumn("k", (F.col("k") + 1).cast("long"))


@query("""
WITH t AS (SELECT user_id, k, count(*) AS n, sum(value * value) AS energy, count(*) FILTER (WHERE abs(value) >= pow(2.0, 9 - k)) AS c FROM events, (SELECT unnest(range(0, 16)) AS k) x GROUP BY 1, 2),
l AS (SELECT user_id, k, c / n AS share, 10 * log10(greatest(energy, 1e-20) / c) AS level FROM t WHERE c > 0)
SELECT user_id, round(arg_min(level, k), 6) AS level_db, round(arg_min(share, k), 6) AS share FROM l WHERE level - 20 * log10(pow(2.0, 9 - k)) >= 15.9 GROUP BY 1
""")
def feat_p56(t: Tables):
    return S.active_level(t.events, "user_id", "value").where("share is not null").select("user_id", F.round("level_db", 6).alias("level_db"), F.round("share", 6).alias("share"))


@query(f"WITH {_L} SELECT user_id, round(avg(level) FILTER (WHERE active) - min(floor), 6) AS snr_db FROM a GROUP BY 1")
def feat_snr(t: Tables):
    rows = S.activity(_frames(t), "user_id").groupBy("user_id").agg(F.avg(F.when(F.col("active"), F.col("level"))).alias("on"), F.min("floor").alias("floor"))
    return rows.select("user_id", F.round(F.col("on") - F.col("floor"), 6).alias("snr_db"))


_R = """r AS (SELECT user_id, level > lag(level) OVER w AND level >= lead(level) OVER w AS peak, active FROM a WINDOW w AS (PARTITION BY user_id ORDER BY frame))"""


@query(f"WITH {_L}, {_R} SELECT user_id, round(count(*) FILTER (WHERE peak) / count(*) FILTER (WHERE active), 6) AS rate FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE active) > 0")
def feat_rate(t: Tables):
    """Peaks of the level for each active frame."""
    return _rate(t).select("user_id", F.round("rate", 6).alias("rate"))


def _rate(t: Tables):
    rows = S.activity(_frames(t), "user_id").select("user_id", "frame", "level", "active")
    rows = S.before(S.before(rows, "user_id", ["level"]), "user_id", ["level"], -1)
    peak = (F.col("level") > F.col("level_before")) & (F.col("level") >= F.col("level_after"))
    out = rows.groupBy("user_id").agg(F.count_if(F.coalesce(peak, F.lit(False))).alias("peaks"), F.count_if("active").alias("on"))
    return out.where(F.col("on") > 0).select("user_id", (F.col("peaks") / F.col("on")).alias("rate"))


@query(f"WITH {_D} SELECT user_id, round(count(*) FILTER (WHERE depth >= 0.5) / count(*), 6) AS share FROM a JOIN v USING (user_id, frame) WHERE active GROUP BY 1")
def feat_nonspeech(t: Tables):
    """The share of active frames without a clear period."""
    rows = S.periods(S.activity(_frames(t), "user_id").where("active"))
    return rows.groupBy("user_id").agg(F.round(F.count_if(F.col("depth") >= 0.5) / F.count("*"), 6).alias("share"))


@query(f"""
WITH {_P}, e AS (SELECT user_id, frame, k, p - lead(p) OVER (PARTITION BY user_id, frame ORDER BY k) AS e FROM p),
c AS (SELECT user_id, frame, k, e - lag(e) OVER (PARTITION BY user_id, k ORDER BY frame) AS c FROM e WHERE e IS NOT NULL)
SELECT user_id, frame, sum(CASE WHEN c > 0 THEN 1 << (k - 1) ELSE 0 END)::BIGINT AS word FROM c WHERE c IS NOT NULL GROUP BY 1, 2
""")
def feat_fingerprint(t: Tables):
    """A bit for each pair of neighbouring bands: whether their difference rises from the frame before."""
    p = S.band_powers(F.col("x"))
    steps = F.array(*(a - b for a, b in zip(p, p[1:], strict=False)))
    rows = S.before(_frames(t).select("user_id", "frame", steps.alias("e")), "user_id", ["e"]).where("e_before is not null")
    bits = [F.when(F.element_at("e", k + 1) - F.element_at("e_before", k + 1) > 0, 1 << k).otherwise(0) for k in range(len(p) - 1)]
    return rows.select("user_id", "frame", reduce(lambda a, b: a + b, bits).cast("long").alias("word"))


@query(f"""
WITH {_D}, {_R}, c AS (SELECT user_id, count(*) AS n, sum(value * value) AS energy, count(*) FILTER (WHERE abs(value) >= 64.0) AS busy FROM events GROUP BY 1),
x AS (SELECT user_id, count(*) AS frames, max(peak) AS peak, avg(level) AS level, stddev_pop(level) AS spread FROM l GROUP BY 1)
SELECT x.user_id, frames, round(x.peak, 6) AS peak, round(level, 6) AS level_db, round(spread, 6) AS spread_db, round(busy / n, 6) AS busy, round(x.peak / sqrt(energy / n), 6) AS crest,
  round(depth, 6) AS depth, round(rate, 6) AS rate
FROM x JOIN c USING (user_id) JOIN (SELECT user_id, avg(depth) AS depth FROM v GROUP BY 1) w USING (user_id)
LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE peak) / count(*) FILTER (WHERE active) AS rate FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE active) > 0) r USING (user_id)
""")
def feat_all(t: Tables):
    frames = S.periods(_frames(t)).withColumns({"level": S.level(S.mean_power()), "top": F.array_max(F.transform("x", lambda v: F.abs(v)))})
    by_frame = frames.groupBy("user_id").agg(F.count("*").alias("frames"), F.max("top").alias("peak"), F.avg("level").alias("level_db"), F.stddev_pop("level").alias("spread_db"), F.avg("depth").alias("depth"))
    whole = t.events.groupBy("user_id").agg((F.count_if(F.abs("value") >= 64) / F.count("*")).alias("busy"), F.sqrt(F.sum(F.col("value") * F.col("value")) / F.count("*")).alias("rms"))
    rows = by_frame.join(whole, "user_id").join(_rate(t), "user_id", "left").withColumn("crest", F.col("peak") / F.col("rms"))
    return rows.select("user_id", "frames", *(F.round(c, 6).alias(c) for c in ("peak", "level_db", "spread_db", "busy", "crest", "depth", "rate")))


@query(f"""
WITH {_L}, e AS (SELECT w, user_id, frame - 2 * w AS j, pow(10.0, level / 20) AS x FROM l, (SELECT unnest(range(0, 100000)) AS w) g WHERE frame >= 2 * w AND frame < 2 * w + 4),
full_ AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY user_id, w) = 4)
SELECT user_id, w AS "window", k, round(sqrt(pow(sum(x * cos(2 * pi() * k * j / 4)), 2) + pow(sum(x * sin(2 * pi() * k * j / 4)), 2)) / greatest(sum(x), 1e-12), 6) AS depth
FROM full_, (SELECT unnest(range(1, 3)) AS k) g GROUP BY 1, 2, 3
""")
def mod_spectrum(t: Tables):
    rows = S.modulation(_frames(t).select("user_id", "frame", F.sqrt(F.greatest(S.mean_power(), F.lit(1e-12))).alias("env")), "user_id", "env")
    rows = rows.select("user_id", "window", F.posexplode("depths").alias("k", "depth"))
    return rows.select("user_id", "window", (F.col("k") + 1).cast("long").alias("k"), F.round("depth", 6).alias("depth"))


@query("""
WITH n AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT c.user_id, c.value AS c, v.value AS v FROM n c JOIN n v ON c.user_id = v.user_id AND c.i = v.i WHERE c.event_type = 'click' AND v.event_type = 'view')
SELECT user_id, count(*) AS n, round(corr(c, v), 6) AS correlation, CASE WHEN avg(v) / stddev_pop(v) > avg(c) / stddev_pop(c) THEN 'view' ELSE 'click' END AS channel FROM b GROUP BY 1 HAVING count(*) > 2
""")
def channel_pick(t: Tables):
    """Two channels of a user, value by value: their correlation, and the one with the larger mean for its spread."""
    from parlance.operators import spread

    placed = spread.numbered(spans(t).where("event_type in ('click', 'view')").select("user_id", "event_type", "event_id", "t0", "value"), ["user_id", "event_type"], ["t0", "event_id"], F.col("t0"), DAY, "i")
    side = lambda kind: placed.where(F.col("event_type") == kind).select("user_id", "i", F.col("value").alias(kind))
    ratio = lambda c: F.avg(c) / F.stddev_pop(c)
    rows = side("click").join(side("view"), ["user_id", "i"]).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.corr("click", "view"), 6).alias("correlation"), F.when(ratio("view") > ratio("click"), "view").otherwise("click").alias("channel"))
    return rows.where("n > 2")
