"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.operators import sequences, stats
from parlance.plans.registry import Tables, query

_EDGES = [0.0, 10.0, 50.0, 100.0, 200.0, 400.0]
_BIN = "CASE WHEN value >= 400 THEN 5 WHEN value >= 200 THEN 4 WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 1 WHEN value >= 0 THEN 0 END"


@query("SELECT source, round(sum(n_chars::DOUBLE * length(text)) / sum(length(text)), 6) AS mean FROM documents GROUP BY 1")
def agg_wmean(t: Tables):
    return t.documents.groupBy("source").agg(F.round(stats.weighted_mean(F.col("n_chars").cast("double"), F.length("text")), 6).alias("mean"))


@query("""
WITH x AS (SELECT source, n_chars AS v, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS acc, sum(n_chars) OVER (PARTITION BY source) AS tot FROM documents)
SELECT source, min(v) FILTER (WHERE acc >= 0.5 * tot) AS weighted_median FROM x GROUP BY 1
""")
def agg_wmedian(t: Tables):
    return stats.weighted_median(t.documents, ["source"], "n_chars", "n_chars", "doc_id")


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY 1")
def agg_distinct(t: Tables):
    return t.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_count_distinct(t: Tables):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def agg_percentile(t: Tables):
    rows = stats.quantiles(t.events, ["event_type"], "value", "event_id", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return rows.select("event_type", *(F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")))


@query("""
SELECT event_type, min(value) FILTER (WHERE rn = n // 2 + 1) AS upper_median FROM (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) x GROUP BY 1
""")
def agg_upper_median(t: Tables):
    return stats.upper_median(t.events, ["event_type"], "value", "event_id")


@query("""
SELECT event_type, min(value) FILTER (WHERE rn = floor(0.99 * n) + 1) AS floor_percentile FROM (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) x GROUP BY 1
""")
def agg_pct_floor(t: Tables):
    return stats.floor_percentile(t.events, ["event_type"], "value", "event_id", 0.99)


@query(f"SELECT b.bin, count(x.bin) AS n FROM (SELECT unnest(range(0, 6)) AS bin) b LEFT JOIN (SELECT {_BIN} AS bin FROM events) x ON x.bin = b.bin GROUP BY 1")
def agg_hist(t: Tables):
    return stats.histogram(t.events, "value", _EDGES).select(F.col("bin").cast("long").alias("bin"), "n")


@query(f"""
WITH h AS (SELECT event_type, {_BIN} AS bin, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS run, sum(n) OVER (PARTITION BY event_type) AS tot FROM h)
SELECT event_type, (min(bin) FILTER (WHERE run >= 0.9 * tot))::BIGINT AS bin FROM r GROUP BY 1
""")
def agg_pct_hist(t: Tables):
    bins = t.events.groupBy("event_type", stats.bin_of(F.col("value"), _EDGES).alias("bin")).agg(F.count("*").alias("n"))
    return stats.histogram_percentile(bins, ["event_type"], 0.9).select("event_type", F.col("bin").cast("long").alias("bin"))


@query("""
SELECT user_id, round(sum(CASE WHEN gap > 3600000000 THEN gap ELSE 0 END) / sum(gap), 6) AS long_share FROM (
  SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) x WHERE gap IS NOT NULL GROUP BY 1
""")
def agg_pause(t: Tables):
    from pyspark.sql import Window

    from parlance.operators.intervals import micros

    rows = t.events.select("user_id", "event_id", micros("ts").alias("t0"))
    gap = F.col("t0") - F.lag("t0").over(Window.partitionBy("user_id").orderBy("t0", "event_id"))
    rows = rows.withColumn("gap", gap).where("gap is not null")
    return rows.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("gap") > 3_600_000_000, F.col("gap")).otherwise(0)) / F.sum("gap"), 6).alias("long_share"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(corr(l_discount, l_tax), 6) AS r_rates FROM lineitem")
def agg_corr(t: Tables):
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.corr("l_discount", "l_tax"), 6).alias("r_rates"))


@query("""
SELECT l_returnflag, round(max(abs(r)), 6) AS max_abs FROM (
  SELECT l_returnflag, date_trunc('month', l_shipdate) AS month, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 10) x GROUP BY 1
""")
def agg_corr_win(t: Tables):
    months = t.lineitem.groupBy("l_returnflag", F.date_trunc("month", "l_shipdate").alias("month")).agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n")).where("n >= 10")
    return months.groupBy("l_returnflag").agg(F.round(F.max(F.abs("r")), 6).alias("max_abs"))


@query("""
SELECT event_type, round(10 * log10(greatest(avg(value * value), 1e-20)), 6) AS rms_db, round(max(abs(value)), 6) AS peak,
  round(20 * log10(max(abs(value))) - 10 * log10(avg(value * value)), 6) AS crest_db FROM events GROUP BY 1
""")
def agg_rms(t: Tables):
    level, top = F.avg(F.col("value") * F.col("value")), F.max(F.abs("value"))
    return t.events.groupBy("event_type").agg(F.round(C.db(level), 6).alias("rms_db"), F.round(top, 6).alias("peak"), F.round(20 * F.log10(top) - 10 * F.log10(level), 6).alias("crest_db"))


@query("""
WITH x AS (SELECT event_type, value AS p FROM events WHERE 10 * log10(greatest(value, 1e-20)) > 10),
g AS (SELECT event_type, 10 * log10(avg(p)) - 10 AS gate FROM x GROUP BY 1)
SELECT event_type, round(10 * log10(avg(p)), 6) AS gated_db, count(*) AS n FROM x JOIN g USING (event_type) WHERE 10 * log10(greatest(p, 1e-20)) > gate GROUP BY 1
""")
def agg_gated(t: Tables):
    rows = stats.gated_mean(t.events, ["event_type"], "value", 10.0, -10.0)
    return rows.select("event_type", F.round("gated_db", 6).alias("gated_db"), "n")


@query("""
WITH s AS (SELECT l_returnflag, p_brand, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
a AS (SELECT p_brand, sum(v) AS v FROM s GROUP BY 1),
l AS (SELECT l_returnflag, s.p_brand, 10 * log10(s.v) - 10 * log10(a.v) AS d, a.v AS w FROM s JOIN a ON s.p_brand = a.p_brand),
o AS (SELECT l_returnflag, sum(w * d) / sum(w) AS mean FROM l GROUP BY 1)
SELECT l_returnflag, round(sqrt(avg((d - mean) * (d - mean))), 6) AS rms_dev, round(max(abs(d - mean)), 6) AS max_dev FROM l JOIN o USING (l_returnflag) GROUP BY 1
""")
def agg_shape(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_returnflag", "p_brand").agg(F.sum("l_extendedprice").alias("v"))
    target = rows.groupBy("p_brand").agg(F.sum("v").alias("w"))
    return stats.shape_deviation(rows, target, ["l_returnflag"], "p_brand", "v", "w")


@query("SELECT p_brand, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def agg_slope(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"))


@query("SELECT p_size // 3 AS band, round(10 * log10(sum(pow(10, p_retailprice / 1000))), 6) AS level FROM part GROUP BY 1")
def agg_rollup_bands(t: Tables):
    return t.part.groupBy(F.floor(F.col("p_size") / 3).alias("band")).agg(F.round(C.db(F.sum(C.power(F.col("p_retailprice") / 100))), 6).alias("level"))


@query("SELECT user_id, round(quantile_cont(10 * log10(greatest(value, 1e-20)), 0.9) - quantile_cont(10 * log10(greatest(value, 1e-20)), 0.1), 6) AS spread FROM events GROUP BY 1")
def agg_l10l90(t: Tables):
    levels = t.events.select("user_id", "event_id", C.db(F.col("value")).alias("level"))
    ends = stats.quantiles(levels, ["user_id"], "level", "event_id", {"l10": 0.9, "l90": 0.1})
    return ends.select("user_id", F.round(F.col("l10") - F.col("l90"), 6).alias("spread"))


@query("SELECT event_type, arg_min(user_id, [epoch_us(ts), event_id]) AS first_user FROM events GROUP BY 1")
def agg_first(t: Tables):
    return t.events.groupBy("event_type").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first_user"))


@query("SELECT l_returnflag AS condition, l_linestatus AS metric, round(avg(l_quantity), 6) AS observed, round(avg(l_discount), 6) AS target, count(*) AS n FROM lineitem GROUP BY 1, 2")
def mean_by_cond(t: Tables):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("metric")).agg(F.round(F.avg("l_quantity"), 6).alias("observed"), F.round(F.avg("l_discount"), 6).alias("target"), F.count("*").alias("n"))


@query("SELECT s_nationkey, sha256(string_agg(s_suppkey::VARCHAR, '' ORDER BY s_suppkey::VARCHAR)) AS digest FROM supplier GROUP BY 1")
def agg_digest(t: Tables):
    return t.supplier.groupBy("s_nationkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("s_suppkey").cast("string"))), ""), 256).alias("digest"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_code_count(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT event_type, user_id % 4 AS step, avg(value) AS m FROM events GROUP BY 1, 2),
d AS (SELECT event_type, m <= lag(m) OVER (PARTITION BY event_type ORDER BY step) AS falls FROM m)
SELECT event_type, coalesce(bool_and(falls), TRUE) AS ok FROM d GROUP BY 1
""")
def trend_check(t: Tables):
    means = t.events.groupBy("event_type", (F.col("user_id") % 4).alias("step")).agg(F.avg("value").alias("m"))
    return stats.never_rises(means, ["event_type"], "step", "m")


@query("""
SELECT event_id, t0 FROM (SELECT event_id, epoch_us(ts) AS t0, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) x WHERE rn <= 3
""")
def topk(t: Tables):
    from parlance.operators.intervals import micros

    return sequences.top_per_group(t.events, ["event_type"], [F.desc("value"), F.col("event_id")], 3).select("event_id", micros("ts").alias("t0"))
