"""Streams, run over all that is there and read back as tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import stats
from parlance.operators.intervals import micros
from parlance.plans.registry import DAY, HOUR, Tables, query, spans
from parlance.streaming import stateful as S


def _events(t: Tables):
    return S.event_stream(t.spark, f"{t.folder}/events.parquet")


@query("SELECT event_type, epoch_us(date_trunc('day', ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables):
    rows = S.drained(S.windowed(_events(t), ["event_type"], "1 day"), "tumbling")
    return rows.select("event_type", F.unix_micros("window_start").alias("start"), "n", "total")


_SLIDING = f"""
SELECT event_type, w * {HOUR} AS start, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT event_type, value, unnest(range(epoch_us(ts) // {HOUR} - 3, epoch_us(ts) // {HOUR} + 1)) AS w FROM events) x GROUP BY 1, 2
"""


@query(_SLIDING)
def stream_sliding(t: Tables):
    rows = S.drained(S.windowed(_events(t), ["event_type"], "4 hours", "1 hour"), "sliding")
    return rows.select("event_type", F.unix_micros("window_start").alias("start"), "n", "total")


@query("""
WITH d AS (SELECT event_type, epoch_us(date_trunc('day', ts)) // 86400000000 AS day, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT a.event_type, a.day, round(sum(b.total) / 3, 4) AS mean FROM d a JOIN d b ON a.event_type = b.event_type AND b.day BETWEEN a.day - 2 AND a.day GROUP BY 1, 2 HAVING count(*) = 3
""")
def stream_trailing(t: Tables):
    """The trailing mean of three whole days; undefined until there are three."""
    daily = S.drained(S.windowed(_events(t), ["event_type"], "1 day"), "trailing").select("event_type", F.floor(F.unix_micros("window_start") / 86_400_000_000).alias("day"), "total")
    by = Window.partitionBy("event_type").orderBy("day").rangeBetween(-2, 0)
    rows = daily.withColumns({"k": F.count("*").over(by), "mean": F.round(F.sum("total").over(by) / 3, 4)})
    return rows.where("k = 3").select("event_type", "day", "mean")


@query(f"""
WITH g AS (SELECT user_id, epoch_us(ts) AS t, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT user_id, t, sum(CASE WHEN gap IS NULL OR gap >= {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
SELECT user_id, min(t) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_session(t: Tables):
    rows = S.drained(S.sessions(_events(t), ["user_id"], "6 hours"), "session")
    return rows.select("user_id", F.unix_micros("session_start").alias("start"), "n")


@query(f"SELECT event_type, epoch_us(ts) // {HOUR} AS hour, least(count(*), 10) AS passed, greatest(count(*) - 10, 0) AS suppressed FROM events GROUP BY 1, 2")
def rate_limit(t: Tables):
    rows = S.drained(S.rate_limited(_events(t), ["event_type"], "1 hour", 10), "limited")
    return rows.select("event_type", F.floor(F.unix_micros("window_start") / HOUR).alias("hour"), "passed", "suppressed")


@query("""
SELECT day, round(p99, 6) AS p99, CASE WHEN p99 < 400 THEN 'ok' WHEN p99 <= 485 THEN 'warn' ELSE 'critical' END AS load, CASE WHEN errors = 0 THEN 'ok' WHEN errors <= 60 THEN 'warn' ELSE 'critical' END AS faults
FROM (SELECT epoch_us(ts) // 86400000000 AS day, quantile_cont(value, 0.99) AS p99, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1) x
""")
def health(t: Tables):
    level = lambda c, ok, warn: F.when(ok, "ok").when(warn, "warn").otherwise("critical")
    rows = t.events.withColumn("day", F.floor(micros("ts") / 86_400_000_000))
    errors = rows.groupBy("day").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    days = stats.quantiles(rows, ["day"], "value", "event_id", {"p99": 0.99}).join(errors, "day")
    return days.select("day", F.round("p99", 6).alias("p99"), level("p99", F.col("p99") < 400, F.col("p99") <= 485).alias("load"), level("errors", F.col("errors") == 0, F.col("errors") <= 60).alias("faults"))


@query("""
WITH m AS (SELECT conv_id, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn) AS a, role AS b FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE NOT ((a = 'start' AND b IN ('system', 'user')) OR (a = 'system' AND b = 'user') OR (a = 'user' AND b = 'assistant') OR (a = 'assistant' AND b = 'user'))) AS illegal FROM m GROUP BY 1
""")
def state_machine(t: Tables):
    legal = {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
    stream = S.table_stream(t.spark, f"{t.folder}/conversations.parquet").select("conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"))
    rows = S.drained(S.stateful(stream, "conv_id", S.moves(legal), "conv_id long, illegal long", "was string", ("turn", "role")), "moves", "append")
    return rows.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))


@query(f"""
SELECT event_id, coalesce(t < max(t) OVER (PARTITION BY user_id ORDER BY event_id % 100, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {24 * HOUR}, FALSE) AS late FROM (SELECT event_id, user_id, epoch_us(ts) AS t FROM events) x
""")
def stream_late(t: Tables):
    """Events in another order of arrival: which of them a watermark of one day would drop."""
    stream = _events(t).select("user_id", "event_id", micros("ts").alias("t"), (F.col("event_id") % 100).alias("turn"))
    return S.drained(S.stateful(stream, "user_id", S.late(24 * HOUR), "event_id long, late boolean", "seen long", ("turn", "event_id")), "late", "append")


_SPAN = 36


@query(f"""
WITH ev AS (SELECT user_id, event_id, event_type = 'error' AS err, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
e AS (SELECT user_id, rn, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY rn) < {_SPAN * HOUR} THEN 0 ELSE 1 END AS opens FROM ev WHERE err),
c AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS chain FROM e),
n AS (SELECT a.user_id, a.chain, a.rn FROM c a JOIN c b ON a.user_id = b.user_id AND b.rn <= a.rn AND a.t - b.t < {_SPAN * HOUR} GROUP BY 1, 2, 3 HAVING count(*) >= 3),
f AS (SELECT user_id, chain, min(rn) AS rn FROM n GROUP BY 1, 2),
x AS (SELECT *, max(CASE WHEN err THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS last FROM ev),
s AS (SELECT x.user_id, x.event_id, x.rn, coalesce(f.rn <= x.rn AND x.t - c.t < {_SPAN * HOUR}, FALSE) AS active
  FROM x LEFT JOIN c ON c.user_id = x.user_id AND c.rn = x.last LEFT JOIN f ON f.user_id = x.user_id AND f.chain = c.chain)
SELECT user_id, event_id, CASE WHEN active THEN 'degraded' ELSE 'running' END AS state FROM (SELECT *, lag(active, 1, FALSE) OVER (PARTITION BY user_id ORDER BY rn) AS was FROM s) y WHERE active <> was
""")
def hysteresis(t: Tables):
    out = "user_id long, event_id long, state string"
    return S.drained(S.stateful(_events(t), "user_id", partial(S.hysteresis, hours=_SPAN), out, "active boolean, recent array<long>"), "hysteresis", "append")


@query("""
WITH RECURSIVE ev AS (SELECT user_id, event_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, 0.0::DOUBLE AS value, 0 AS sign, 0 AS swings FROM ev
  UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN far THEN least(60.0, greatest(-60.0, value + least(1.0, greatest(-1.0, 0.02 * off * CASE WHEN swings > 2 THEN 0.5 ELSE 1.0 END)))) ELSE value END, sign, swings FROM (
    SELECT user_id, rn, event_id, value, off, far, CASE WHEN far THEN sign(off)::INTEGER ELSE was END AS sign,
      CASE WHEN NOT far THEN swings WHEN was <> 0 AND sign(off) <> was THEN swings + 1 ELSE greatest(0, swings - 1) END AS swings FROM (
        SELECT e.user_id, e.rn, e.event_id, w.value, 250.0 - (e.x + w.value) AS off, abs(250.0 - (e.x + w.value)) > 10 AS far, w.sign AS was, w.swings FROM w JOIN ev e ON e.user_id = w.user_id AND e.rn = w.rn + 1) a) b)
SELECT user_id, event_id, round(value, 6) AS trim FROM w WHERE rn > 0
""")
def correction_loop(t: Tables):
    out = "user_id long, event_id long, trim double"
    return S.drained(S.stateful(_events(t), "user_id", S.correction, out, "value double, sign int, swings int"), "correction", "append")


_NOW = 1_706_745_600_000_000


@query(f"""
WITH u AS (SELECT user_id, count(*) AS n, {_NOW} - max(epoch_us(ts)) AS age FROM events GROUP BY 1)
SELECT user_id, n, user_id % 10 <> 0 AS accepted, CASE WHEN user_id % 10 <> 0 THEN 5000000000 - (2 * age * 48000 + 1000000) // 2000000 END AS last FROM u
""")
def state_roundtrip(t: Tables):
    """State exported as JSON of ages, and imported at another clock of another rate; documents of another major version aren't taken."""
    used = spans(t).groupBy("user_id").agg(F.count("*").alias("n"), F.max("t0").alias("last"))
    out = S.exported(used, "last", _NOW, "1.2").withColumn("document", F.when(F.col("user_id") % 10 == 0, F.replace("document", F.lit('"1.2"'), F.lit('"2.0"'))).otherwise(F.col("document")))
    return S.imported(out, "document", 5_000_000_000, 48_000, 1).select("user_id", "n", "accepted", "last")


_HOUR_MS = 3_600_000
#: Horizons and step of snapshots, in ms.
_HORIZONS, _STEP = [10 * _HOUR_MS, 60 * _HOUR_MS, 600 * _HOUR_MS], 12 * _HOUR_MS


@query(f"""
WITH e AS (SELECT user_id, epoch_ms(ts) AS t, value FROM events), w AS (SELECT max(epoch_ms(ts)) - 86400000 AS now FROM events),
a AS (SELECT user_id, unnest(range((min(t) + {_STEP - 1}) // {_STEP}, now // {_STEP} + 1)) * {_STEP} AS upto FROM e, w GROUP BY user_id, now)
SELECT a.user_id, a.upto, {", ".join(f"count(*) FILTER (WHERE t > a.upto - {h}) AS n{k}, round(10 * log10(avg(value * value + 1e-12) FILTER (WHERE t > a.upto - {h})), 6) AS level{k}" for k, h in enumerate(_HORIZONS))}
FROM a JOIN e ON e.user_id = a.user_id AND t > a.upto - {_HORIZONS[-1]} AND t <= a.upto GROUP BY 1, 2
""")
def horizon_snapshots(t: Tables):
    """A user's level over the last 10, 60 and 600 hours, every 12 hours; older rows leave the state."""
    from parlance.streaming import timers

    stream = S.event_stream(t.spark, f"{t.folder}/events.parquet").withColumn("t", F.unix_millis("at"))
    out = S.drained(timers.snapshots(stream, "user_id", _HORIZONS, _STEP, "1 day"), "horizons", "append")
    return out.select("user_id", F.col("at").alias("upto"), *(c for k in range(3) for c in (F.col(f"n{k}"), F.round(10 * F.log10(F.col(f"power{k}") + 1e-12), 6).alias(f"level{k}"))))


@query(f"""
WITH e AS (SELECT user_id, event_id, epoch_ms(ts) AS t, event_type FROM events), w AS (SELECT max(epoch_ms(ts)) - 86400000 AS now FROM events),
s AS (SELECT r.user_id, r.event_id, r.t, min(v.t) AS first FROM e r LEFT JOIN e v ON v.user_id = r.user_id AND v.event_type = 'view' AND v.t >= r.t - {10 * _HOUR_MS} WHERE r.event_type = 'click' GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN first IS NOT NULL THEN greatest(0, ceil((first - t) / {_HOUR_MS}))::INTEGER ELSE 99 END AS tries FROM s, w WHERE t + {10 * _HOUR_MS} <= now)
SELECT user_id, event_id AS number, CASE WHEN tries <= 10 THEN tries ELSE 10 END AS postponed, CASE WHEN tries <= 10 THEN 'started' ELSE 'starved' END AS outcome FROM p
""")
def postponed_starts(t: Tables):
    """Clicks wait for a view of their user, looked for every hour; after ten hours they starve."""
    from parlance.streaming import timers

    stream = S.event_stream(t.spark, f"{t.folder}/events.parquet")
    # Every event moves the clock; those that neither ask nor are a source have no flag.
    source = F.when(F.col("event_type").isin("click", "view"), F.col("event_type") == "view")
    rows = stream.select("user_id", "at", F.unix_millis("at").alias("t"), F.col("event_id").alias("number"), source.alias("is_source"))
    return S.drained(timers.postponed(rows, "user_id", _HOUR_MS, 10, "1 day"), "postponed", "append")
