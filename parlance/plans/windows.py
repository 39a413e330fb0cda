"""Window functions and operators over rows in order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import intervals, sequences, spread, stats
from parlance.operators.intervals import micros
from parlance.plans.joins import _ISLANDS, islands_of
from parlance.plans.registry import DAY, HOUR, SPANS, Tables, query, spans


@query(f"""
WITH {SPANS}, p AS (SELECT event_type, t0 AS t, 1 AS d FROM spans UNION ALL SELECT event_type, t1, -1 FROM spans),
g AS (SELECT event_type, t, sum(d) AS d FROM p GROUP BY 1, 2),
r AS (SELECT event_type, t, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS k, lead(t) OVER (PARTITION BY event_type ORDER BY t) - t AS span FROM g)
SELECT event_type, max(k)::BIGINT AS max_active, min(k)::BIGINT AS min_active, round(sum(k * span) / sum(span), 9) AS mean_active FROM r WHERE span IS NOT NULL GROUP BY 1
""")
def win_concurrency(t: Tables):
    return spread.concurrency(spans(t), ["event_type"], DAY, "t0", "t1").select("event_type", "max_active", "min_active", F.round("mean_active", 9).alias("mean_active"))


@query(f"WITH {_ISLANDS} SELECT user_id, island, a AS start, b AS \"end\", n FROM islands")
def win_islands(t: Tables):
    return islands_of(t)


_GAPS = f"""{_ISLANDS},
gaps AS (SELECT user_id, b AS gap_start, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS gap_end FROM islands)"""


@query(f"WITH {_GAPS} SELECT user_id, gap_start, gap_end, gap_end - gap_start >= {DAY} AS boundary FROM gaps WHERE gap_end IS NOT NULL")
def win_gaps(t: Tables):
    return intervals.gaps(islands_of(t), ["user_id"], DAY)


@query("""
WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, value >= 100 AS f FROM events),
g AS (SELECT user_id, rn, rn - row_number() OVER (PARTITION BY user_id, f ORDER BY rn) AS run FROM f WHERE f)
SELECT user_id, min(rn) AS first, max(rn) AS last, count(*) AS n FROM g GROUP BY user_id, run
""")
def win_runs(t: Tables):
    rows = sequences.runs(t.events, ["user_id"], ["ts", "event_id"], F.col("value") >= 100)
    return rows.select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


@query(f"""
WITH {_ISLANDS}, s AS (SELECT user_id, a, b, a - lag(b) OVER (PARTITION BY user_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY user_id ORDER BY a) - b AS after FROM islands)
SELECT user_id, a AS start, b AS "end" FROM s WHERE b - a < 600000000 AND (before IS NULL OR before >= {12 * HOUR}) AND (after IS NULL OR after >= {12 * HOUR})
""")
def win_isolated(t: Tables):
    return intervals.isolated(islands_of(t), ["user_id"], 600_000_000, 12 * HOUR)


@query(f"""
WITH {_ISLANDS}, f AS (SELECT user_id, min(t0) AS p FROM spans GROUP BY 1)
SELECT f.user_id, max(least(b, p + {10 * DAY}) - greatest(a, p))::BIGINT AS longest FROM f JOIN islands i ON i.user_id = f.user_id AND i.a < p + {10 * DAY} AND i.b > p GROUP BY 1
""")
def win_longest_run(t: Tables):
    anchors = spans(t).groupBy("user_id").agg(F.min("t0").alias("at"))
    return intervals.longest_run(anchors, islands_of(t), ["user_id"], "at", 10 * DAY)


@query("""
WITH d AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, min(gap) AS least, round(avg(gap), 3) AS mean, round(quantile_cont(gap::DOUBLE, 0.05), 3) AS p5 FROM d WHERE gap IS NOT NULL GROUP BY 1
""")
def win_spacing(t: Tables):
    gap = F.col("t0") - F.lag("t0").over(Window.partitionBy("user_id").orderBy("t0", "event_id"))
    rows = spans(t).withColumn("gap", gap).where("gap is not null")
    p5 = stats.quantiles(rows, ["user_id"], "gap", "event_id", {"p5": 0.05})
    return rows.groupBy("user_id").agg(F.min("gap").alias("least"), F.round(F.avg("gap"), 3).alias("mean")).join(p5, "user_id").withColumn("p5", F.round("p5", 3))


@query("""
WITH n AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT event_type, rn - lag(rn) OVER (PARTITION BY event_type, user_id ORDER BY rn) AS gap FROM n)
SELECT event_type, min(gap) AS least, round(quantile_cont(gap::DOUBLE, 0.05), 6) AS p5 FROM g WHERE gap IS NOT NULL GROUP BY 1
""")
def win_reuse_gap(t: Tables):
    rows = spread.numbered(t.events, ["event_type"], ["ts", "event_id"], micros("ts"), DAY, "rn")
    rows = rows.withColumn("gap", F.col("rn") - F.lag("rn").over(Window.partitionBy("event_type", "user_id").orderBy("rn"))).where("gap is not null")
    p5 = stats.quantiles(rows, ["event_type"], "gap", "event_id", {"p5": 0.05})
    return rows.groupBy("event_type").agg(F.min("gap").alias("least")).join(p5, "event_type").withColumn("p5", F.round("p5", 6))


@query("""
WITH g AS (SELECT user_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, event_type, count(gap) AS repeats, min(gap) AS shortest FROM g GROUP BY 1, 2
""")
def win_region_reuse(t: Tables):
    gap = F.col("t0") - F.lag("t0").over(Window.partitionBy("user_id", "event_type").orderBy("t0", "event_id"))
    return spans(t).withColumn("gap", gap).groupBy("user_id", "event_type").agg(F.count("gap").alias("repeats"), F.min("gap").alias("shortest"))


@query("""
SELECT source, quartile, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi FROM (
  SELECT source, n_chars, floor(4.0 * (row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) / count(*) OVER (PARTITION BY source))::BIGINT AS quartile FROM documents) x GROUP BY 1, 2
""")
def win_quartile(t: Tables):
    return stats.quartiles(t.documents, ["source"], "n_chars", "doc_id").groupBy("source", "quartile").agg(F.count("*").alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@query("SELECT event_id, sum(round(value * 100)::BIGINT) OVER w::DOUBLE / count(*) OVER w / 100 AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 999 PRECEDING)")
def win_trailing_mean(t: Tables):
    """In whole hundredths, so that the order of additions makes no difference."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = spread.over_last(t.events, ["event_type"], ["ts", "event_id"], micros("ts"), DAY, 1000, {"mean": lambda by: F.sum(cents).over(by).cast("double") / F.count("*").over(by) / 100})
    return rows.select("event_id", "mean")


@query("""
WITH m AS (SELECT event_type, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS tot,
  value < 0.063 * avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 999 PRECEDING) AS below FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
g AS (SELECT event_type, tot, rn, rn - row_number() OVER (PARTITION BY event_type ORDER BY rn) AS run FROM m WHERE below),
r AS (SELECT event_type, run, count(*) AS n FROM g GROUP BY event_type, run, tot HAVING max(rn) < tot)
SELECT event_type, n AS length, count(*) AS gaps FROM r GROUP BY 1, 2
""")
def win_gap_sessions(t: Tables):
    means = spread.over_last(t.events, ["event_type"], ["ts", "event_id"], micros("ts"), DAY, 1000, {"mean": lambda by: F.avg("value").over(by)})
    rows = spread.runs(means.withColumn("at", micros("ts")), ["event_type"], ["at", "event_id"], F.col("at"), DAY, F.col("value") < 0.063 * F.col("mean"))
    return rows.where("closed").groupBy("event_type", F.col("n").alias("length")).agg(F.count("*").alias("gaps"))


@query("""
SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[
  count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) // 2 + 1] AS median FROM events
""")
def win_roll_median(t: Tables):
    return t.events.select("event_id", sequences.upper_median_over("value", sequences.centred(["user_id"], ["ts", "event_id"], 2)).alias("median"))


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 9) AS detrended FROM events")
def win_centred_mean(t: Tables):
    return t.events.select("event_id", F.round(F.col("value") - F.avg("value").over(sequences.centred(["user_id"], ["ts", "event_id"], 25)), 9).alias("detrended"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS run FROM events")
def win_prefix(t: Tables):
    rows = spread.dealt(t.events, micros("ts"), DAY)
    return spread.running(rows, ["user_id"], ["ts", "event_id"], "value", "run").select("event_id", F.round("run", 4).alias("run"))


@query("""
SELECT event_type, user_id, rank FROM (
  SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY last NULLS FIRST, user_id) AS rank FROM (
    SELECT event_type, user_id, max(epoch_us(ts)) FILTER (WHERE value > 250) AS last FROM events GROUP BY 1, 2) x) y WHERE rank <= 5
""")
def win_lru(t: Tables):
    used = spans(t).groupBy("event_type", "user_id").agg(F.max(F.when(F.col("value") > 250, F.col("t0"))).alias("last"))
    rows = sequences.top_per_group(used, ["event_type"], [F.asc_nulls_first("last"), F.col("user_id")], 5)
    return rows.select("event_type", "user_id", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, value, lag(value) OVER w AS p, lead(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x WHERE value > p AND value >= n
""")
def win_peaks(t: Tables):
    return t.events.withColumn("peak", sequences.is_peak("value", ["user_id"], ["ts", "event_id"])).where("peak").select("user_id", "event_id")


@query("""
WITH f AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
g AS (SELECT l_suppkey, l_quantity, rn - row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY rn) AS run FROM f)
SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey, l_quantity, run FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 2) x GROUP BY 1
""")
def win_flat_runs(t: Tables):
    """Runs are counted where they begin: at a row like the next one and unlike the one before. So one order of the rows is enough."""
    rows = spread.even(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), "l_suppkey", 500_000)
    by = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    # In a struct, a row that isn't there differs from one without a value.
    own = F.struct("l_quantity")
    begins = F.lead(own).over(by).eqNullSafe(own) & ~F.lag(own).over(by).eqNullSafe(own)
    return rows.select("l_suppkey", begins.alias("begins")).where("begins").groupBy("l_suppkey").agg(F.count("*").alias("n"))


_BINS = f"""{SPANS}, parts AS (SELECT user_id, bin, least(t1, (bin + 1) * {HOUR}) - greatest(t0, bin * {HOUR}) AS part FROM (
  SELECT user_id, t0, t1, unnest(range(t0 // {HOUR}, (t1 - 1) // {HOUR} + 1)) AS bin FROM spans WHERE t1 > t0) x)"""


@query(f"WITH {_BINS} SELECT user_id, bin, sum(part)::BIGINT AS busy FROM parts GROUP BY 1, 2")
def bin_apportion(t: Tables):
    return intervals.apportioned(spans(t), "t0", "t1", HOUR).groupBy("user_id", "bin").agg(F.sum("part").alias("busy"))


@query(f"""
WITH {_BINS}, b AS (SELECT bin, sum(part)::BIGINT AS busy FROM parts GROUP BY 1)
SELECT bin, round((SELECT sum(busy) FROM b p WHERE p.bin > x.bin - 24 AND p.bin <= x.bin) / (24.0 * {HOUR}), 9) AS mean_active FROM b x
""")
def win_occupancy_bins(t: Tables):
    """The mean number of running events over the last day, at every hour that has any; hours are already few rows."""
    busy = intervals.apportioned(spans(t), "t0", "t1", HOUR).groupBy("bin").agg(F.sum("part").alias("busy"))
    day = busy.withColumn("later", F.explode(F.sequence(F.col("bin"), F.col("bin") + 23)))
    run = day.groupBy(F.col("later").alias("bin")).agg(F.sum("busy").alias("run"))
    return busy.select("bin").join(run, "bin").select("bin", F.round(F.col("run") / (24.0 * HOUR), 9).alias("mean_active"))


@query("SELECT name, id FROM (SELECT s_name AS name, s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_name, (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 2 = 0) + row_number() OVER (ORDER BY s_name) FROM supplier WHERE s_suppkey % 2 = 1) x")
def dense_ids(t: Tables):
    known = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return sequences.dense_ids(known, t.supplier.select(F.col("s_name").alias("name")), "name", "id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) x WHERE rn > 1")
def dedup_exact(t: Tables):
    return sequences.later_copies(t.documents.select("doc_id", "text"), F.sha2("text", 256), ["doc_id"]).select("doc_id")


@query("SELECT o_orderpriority, o_orderkey, rank FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) x WHERE rank <= 3")
def topn_group(t: Tables):
    rows = sequences.top_per_group(t.orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return rows.select("o_orderpriority", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_ISLANDS}, e AS (SELECT user_id, a, b, n, a - lag(b, 1, 0::BIGINT) OVER (PARTITION BY user_id ORDER BY a) AS lead_in, max(b) OVER (PARTITION BY user_id) - a AS remaining FROM islands),
s AS (SELECT e.user_id, e.a, sum(least(x.t1, e.a + {DAY}) - greatest(x.t0, e.a)) FILTER (WHERE x.t1 > x.t0) AS speech FROM e JOIN spans x ON x.user_id = e.user_id AND x.t0 < e.a + {DAY} AND x.t1 > e.a GROUP BY 1, 2)
SELECT user_id, a AS anchor, remaining, speech::BIGINT AS speech FROM e JOIN s USING (user_id, a) WHERE lead_in >= {8 * HOUR} AND remaining >= {2 * DAY} AND speech >= 100000000
""")
def anchors(t: Tables):
    return intervals.anchors(islands_of(t), spans(t), ["user_id"], lead_in=8 * HOUR, remaining=2 * DAY, window=DAY, speech=100_000_000)


@query("""
WITH n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.event_id, round(sum(b.value * pow(0.8, a.n - b.n) * CASE WHEN b.n = 1 THEN 1.0 ELSE 0.2 END), 6) AS ema FROM n a JOIN n b ON a.user_id = b.user_id AND b.n <= a.n GROUP BY 1
""")
def ema(t: Tables):
    return sequences.exponential_average(t.events, ["user_id"], ["ts", "event_id"], "value", 0.2, micros("ts"), DAY).select("event_id", F.round("ema", 6).alias("ema"))
