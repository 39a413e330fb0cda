"""Pools, plans and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import planning, stats
from parlance.operators.kept import kept
from parlance.plans.registry import DAY, HOUR, SPANS, Tables, query, spans


@query("""
WITH q AS (SELECT doc_id, lang, n_chars, (4 * (row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1)) // count(*) OVER (PARTITION BY lang) AS quartile, md5('7/' || doc_id) AS draw FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang, quartile ORDER BY draw, doc_id) > 2 + CASE WHEN [3, 1, 2, 4][quartile + 1] <= 2 THEN 1 ELSE 0 END AS spare FROM q)
SELECT lang, doc_id, quartile::INTEGER AS quartile FROM p QUALIFY row_number() OVER (PARTITION BY lang ORDER BY spare, draw, doc_id) <= 10
""")
def pool_balanced(t: Tables):
    rows = planning.balanced_pool(t.documents.select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", "doc_id", 10, 7)
    return rows.select("lang", "doc_id", "quartile")


@query()
def pool_high(t: Tables):
    return planning.spread_pool(t.embeddings, ["label"], "vec_id", "embedding", 6, 7)


@query("""
WITH RECURSIVE m AS (SELECT event_type, user_id, avg(value) AS pitch FROM events GROUP BY 1, 2),
q AS (SELECT event_type, k, quantile_cont(pitch, 0.08333333333333333) AS q0, quantile_cont(pitch, 0.25) AS q1, quantile_cont(pitch, 0.4166666666666667) AS q2,
  quantile_cont(pitch, 0.5833333333333334) AS q3, quantile_cont(pitch, 0.75) AS q4, quantile_cont(pitch, 0.9166666666666666) AS q5 FROM m, (SELECT unnest(range(0, 6)) AS k) x GROUP BY 1, 2),
r AS (SELECT DISTINCT event_type, 0::BIGINT AS k, []::BIGINT[] AS taken FROM m
  UNION ALL
  SELECT r.event_type, r.k + 1, list_append(any_value(r.taken), arg_min(m.user_id, [abs(m.pitch - [q0, q1, q2, q3, q4, q5][r.k + 1]), m.pitch, m.user_id]))
  FROM r JOIN q ON q.event_type = r.event_type AND q.k = r.k JOIN m ON m.event_type = r.event_type AND NOT list_contains(r.taken, m.user_id) GROUP BY r.event_type, r.k)
SELECT event_type, k::INTEGER - 1 AS pick, taken[k] AS number FROM r WHERE k > 0
""")
def pool_matched(t: Tables):
    # Where two are equally near, the last bits of their means decide: events are added up in order, as in the SQL. Read several times: written once.
    pitches = kept(stats.mean_in_order(t.events, ["event_type", "user_id"], "value", ["event_id"], "pitch"))
    return planning.matched_pool(pitches, ["event_type"], "user_id", "pitch", 6)


@query("""
WITH d AS (SELECT s_nationkey, s_suppkey, cycle, row_number() OVER (PARTITION BY s_nationkey, cycle ORDER BY md5('7/' || cycle || '/' || s_suppkey), s_suppkey) AS place,
  count(*) OVER (PARTITION BY s_nationkey, cycle) AS n FROM supplier, (SELECT unnest(range(0, 4)) AS cycle) x),
m AS (SELECT d.*, p.s_suppkey IS NOT NULL AS tail FROM d LEFT JOIN d p ON p.s_nationkey = d.s_nationkey AND p.s_suppkey = d.s_suppkey AND p.cycle = d.cycle - 1 AND p.place > p.n - ceil(p.n / 5)),
o AS (SELECT *, CASE WHEN place = min(place) FILTER (WHERE NOT tail) OVER (PARTITION BY s_nationkey, cycle) THEN 0 ELSE place END AS turn FROM m)
SELECT s_nationkey, cycle::INTEGER AS cycle, row_number() OVER (PARTITION BY s_nationkey, cycle ORDER BY turn) - 1 AS position, s_suppkey FROM o
""")
def shuffle_cycle(t: Tables):
    return planning.shuffle_cycles(t.supplier.select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey", 4, 7)


_PHRASES = f"""{SPANS}, p AS (SELECT event_id, event_type, t0, greatest({planning.SHORTEST}, least(t1 - t0, {planning.LONGEST})) // {planning.GRID} * {planning.GRID} AS length FROM spans)"""
_PLAN = f"""{_PHRASES}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t0, event_id) AS n FROM p),
plan AS (SELECT event_id, event_type, length, (max(t0 - n * {planning.GUARD}) OVER (PARTITION BY event_type ORDER BY n) + n * {planning.GUARD})::BIGINT AS planned FROM n)"""


def _plan(t: Tables):
    rows = planning.phrases(spans(t), "t0", "t1").select("event_id", "event_type", "t0", "length")
    return planning.plan(rows, ["event_type"], "event_id", "t0", DAY).select("event_id", "event_type", "length", "planned")


@query(f"WITH {_PLAN} SELECT * FROM plan")
def plan_events(t: Tables):
    """Phrases of the right length, whose starts keep their distance."""
    return _plan(t)


@query(f"""
WITH {_PHRASES}, n AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY t0, event_id) - 1) % 3 AS slot FROM p),
s AS (SELECT *, coalesce(sum(length - 5000000) OVER (PARTITION BY event_type, slot ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT event_id, event_type, slot, length, (before + max(t0 - before) OVER (PARTITION BY event_type, slot ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS planned FROM s
""")
def plan_fixed(t: Tables):
    """A fixed number of slots, chained with an overlap."""
    rows = planning.phrases(spans(t), "t0", "t1").select("event_id", "event_type", "t0", "length")
    return planning.plan_slots(rows, ["event_type"], "event_id", "t0", 3, 5_000_000, DAY).select("event_id", "event_type", "slot", "length", "planned")


_AT = 1_704_067_200_000_000 + 10 * DAY


@query(f"""
WITH {_PLAN}
SELECT event_id, event_type, 0 AS epoch, planned, least(length, {_AT} + 500000 + event_id % 4 * 100000 - planned) AS length FROM plan WHERE planned < {_AT} + 500000
UNION ALL SELECT event_id, event_type, 1, planned + 90000000, length FROM plan WHERE planned + 90000000 >= {_AT} + 500000
""")
def replan(t: Tables):
    """At a time, the plan goes over to one that runs 90 seconds later."""
    old = _plan(t)
    fresh = old.withColumn("planned", F.col("planned") + 90_000_000)
    return planning.replan(old, fresh, "event_id", _AT, 500_000, 100_000).select("event_id", "event_type", "epoch", "planned", "length")


@query("""
SELECT conv_id, turn, least(length(text), 200) AS kept,
  coalesce(sum(length(text)) OVER w, 0)::BIGINT AS source_start, coalesce(sum(least(length(text), 200)) OVER w, 0)::BIGINT AS start
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def layout_shorten(t: Tables):
    rows = planning.shortened(t.conversations, ["conv_id"], "turn", F.length("text"), 200)
    return rows.select("conv_id", "turn", "kept", "source_start", "start")


@query(f"""
WITH {SPANS}, parts AS (SELECT event_type, bin, value, least(t1, (bin + 1) * {HOUR}) - greatest(t0, bin * {HOUR}) AS part FROM (
  SELECT *, unnest(range(t0 // {HOUR}, (t1 - 1) // {HOUR} + 1)) AS bin FROM spans WHERE t1 > t0) x)
SELECT event_type, bin, round(sum(value / 100 * (value / 100) * part) / {HOUR}, 6) AS power FROM parts GROUP BY 1, 2
""")
def bus_power(t: Tables):
    rows = planning.bus_power(spans(t), ["event_type"], "t0", "t1", F.col("value") / 100, HOUR)
    return rows.select("event_type", "bin", F.round("power", 6).alias("power"))
