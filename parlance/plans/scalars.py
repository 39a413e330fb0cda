"""Scalar functions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.operators import configs
from parlance.plans.registry import Tables, query


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def str_join(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1")
def str_ext(t: Tables):
    return t.pages.groupBy(C.extension(F.col("url")).alias("ext")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(' ' || url || ' ')), '[\\/]+', '/', 'g'), '^/', '') AS path FROM pages")
def str_norm(t: Tables):
    return t.pages.select("page_id", C.normalise_path(F.concat(F.lit(" "), "url", F.lit(" "))).alias("path"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, nullif(regexp_extract(url, '/([0-9]+)', 1), '')::BIGINT AS number FROM pages")
def str_regex(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).cast("long").alias("number"))


@query("SELECT o_orderkey, regexp_replace(o_orderpriority, '[^0-9A-Za-z]', '', 'g') AS version FROM orders")
def str_sanitize(t: Tables):
    return t.orders.select("o_orderkey", C.sanitize(F.col("o_orderpriority")).alias("version"))


@query("""
SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's'
  WHEN s >= 60 THEN (s // 60) || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS duration
FROM (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS s FROM orders) x
""")
def fmt_hms(t: Tables):
    return t.orders.select("o_orderkey", C.hours_minutes_seconds(F.col("o_totalprice") / 10).alias("duration"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS stamp FROM events")
def fmt_iso(t: Tables):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stamp"))


@query("SELECT event_id, round(10 * log10(greatest(value / 1000, 1e-20)), 6) AS db FROM events")
def math_db(t: Tables):
    return t.events.select("event_id", F.round(C.db(F.col("value") / 1000), 6).alias("db"))


@query("SELECT event_id, round(12 * log2(value / 100), 6) AS semitones FROM events WHERE value > 0")
def math_semitone(t: Tables):
    return t.events.where("value > 0").select("event_id", F.round(C.semitones(F.col("value")), 6).alias("semitones"))


@query("SELECT event_id, least(greatest(value, 50.0), 250.0) AS clamped FROM events")
def math_clamp(t: Tables):
    return t.events.select("event_id", C.clamp(F.col("value"), 50.0, 250.0).alias("clamped"))


@query("SELECT o_orderkey, floor((2 * (o_orderkey - 700)::DOUBLE * 48000 + 44100) / 88200)::BIGINT AS samples FROM orders")
def math_ratecvt(t: Tables):
    return t.orders.select("o_orderkey", C.convert_rate(F.col("o_orderkey") - 700, 44_100, 48_000).alias("samples"))


@query("SELECT event_id, round(sqrt(least(value / 400, 1.0)), 6) AS a, round(sqrt(1 - least(value / 400, 1.0)), 6) AS b FROM events WHERE value >= 0")
def math_mix(t: Tables):
    a, b = C.power_mix(F.col("value") / 400)
    return t.events.where("value >= 0").select("event_id", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


@query("SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::BIGINT AS distance FROM orders")
def bit_ops(t: Tables):
    return t.orders.select("o_orderkey", F.bit_count(F.col("o_orderkey").bitwiseXOR(F.col("o_custkey"))).cast("long").alias("distance"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def hash_sha(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))


_ANCHORS = [(0.0, 1.0), (100_000.0, 2.0), (200_000.0, 8.0), (300_000.0, 4.0), (400_000.0, 16.0)]


@query("""
SELECT o_orderkey,
  round(CASE WHEN x >= 400000 THEN 16.0 WHEN x >= 300000 THEN 4 + (x - 300000) / 100000 * 12 WHEN x >= 200000 THEN 8 - (x - 200000) / 100000 * 4 WHEN x >= 100000 THEN 2 + (x - 100000) / 100000 * 6 ELSE 1 + x / 100000 END, 8) AS linear,
  round(CASE WHEN x >= 400000 THEN 16.0 WHEN x >= 300000 THEN 4 * pow(4.0, (x - 300000) / 100000) WHEN x >= 200000 THEN 8 * pow(0.5, (x - 200000) / 100000) WHEN x >= 100000 THEN 2 * pow(4.0, (x - 100000) / 100000) ELSE pow(2.0, x / 100000) END, 8) AS log,
  CASE WHEN x >= 400000 THEN 16.0::DOUBLE WHEN x >= 300000 THEN 4.0 WHEN x >= 200000 THEN 8.0 WHEN x >= 100000 THEN 2.0 ELSE 1.0 END AS step
FROM (SELECT o_orderkey, o_totalprice AS x FROM orders WHERE o_totalprice >= 0) y
""")
def interp_anchor(t: Tables):
    x = F.col("o_totalprice")
    return t.orders.where("o_totalprice >= 0").select("o_orderkey", F.round(C.interpolate(x, _ANCHORS), 8).alias("linear"), F.round(C.interpolate(x, _ANCHORS, "log"), 8).alias("log"), C.interpolate(x, _ANCHORS, "step").alias("step"))


@query("SELECT k::BIGINT AS band, round(pow(10.0, k / 10.0), 6) AS centre, round(pow(10.0, (k - 0.5) / 10.0), 6) AS low, round(pow(10.0, (k + 0.5) / 10.0), 6) AS high FROM (SELECT unnest(range(17, 43)) AS k) x")
def band_dim(t: Tables):
    k = F.col("id")
    return t.spark.range(17, 43).select(k.alias("band"), *(F.round(F.pow(F.lit(10.0), (k + d) / 10), 6).alias(name) for name, d in (("centre", 0.0), ("low", -0.5), ("high", 0.5))))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[i]::DOUBLE)), 6) AS dot FROM embeddings")
def array_dot(t: Tables):
    return t.embeddings.select("vec_id", F.round(C.dot(F.col("embedding"), F.col("embedding")), 6).alias("dot"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[i]::DOUBLE))), 6)) AS unit FROM embeddings")
def array_l2(t: Tables):
    return t.embeddings.select("vec_id", F.transform(C.unit_power(F.col("embedding")), lambda x: C.rounded(x, 6)).alias("unit"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_get(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
SELECT o_orderkey, version, CASE WHEN major > 2 THEN 'reject' WHEN major = 2 AND minor > 3 THEN 'warn' ELSE 'ok' END AS gate
FROM (SELECT o_orderkey, o_orderkey % 4 AS major, o_orderkey % 7 AS minor, (o_orderkey % 4) || '.' || (o_orderkey % 7) AS version FROM orders) x
""")
def json_version(t: Tables):
    rows = t.orders.select("o_orderkey", F.concat_ws(".", (F.col("o_orderkey") % 4).cast("string"), (F.col("o_orderkey") % 7).cast("string")).alias("version"))
    part = F.split("version", r"\.")
    major, minor = part[0].cast("int"), part[1].cast("int")
    return rows.select("o_orderkey", "version", F.when(major > 2, "reject").when((major == 2) & (minor > 3), "warn").otherwise("ok").alias("gate"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"gain\":' || (event_id % 5) || '}' AS doc FROM events")
def json_set(t: Tables):
    doc = F.from_json("props", "k long").withField("gain", F.col("event_id") % 5)
    return t.events.select("event_id", F.to_json(doc).alias("doc"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"text\":\"' || event_type || '\"}' ELSE props END AS label FROM events")
def json_wrap(t: Tables):
    """A label that is JSON stays; any other text becomes an object's text."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("props"))
    rows = t.events.select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")).otherwise(F.to_json(F.struct(F.col("raw").alias("text")))).alias("label"))


@query("""
WITH b AS (SELECT page_id, url, list_transform(range(0, octet_length(encode(url))), lambda i: ('0x' || substr(hex(encode(url)), 2 * i + 1, 2))::BIGINT) AS b FROM pages),
h AS (SELECT page_id, url, list_reduce(list_prepend(2166136261::BIGINT, b), lambda a, x: xor(a, x) * 16777619 % 4294967296) AS h FROM b)
SELECT page_id, '<path:' || printf('%08x', h) || '>' || regexp_extract(url, '(\\.[A-Za-z0-9]+)$', 1) AS logged FROM h
""")
def redact(t: Tables):
    return t.pages.select("page_id", C.redact_path(F.col("url")).alias("logged"))


@query("SELECT s_suppkey, s_nationkey, pos FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos FROM supplier) x")
def sort_stable(t: Tables):
    """Within equal keys the original order holds, by an explicit tie-break."""
    return t.supplier.select("s_suppkey", "s_nationkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long").alias("pos")).orderBy("s_nationkey", "pos")


@query("SELECT p_brand, row_number() OVER (ORDER BY regexp_replace(p_brand, '[0-9]+', ''), regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER) AS pos FROM (SELECT DISTINCT p_brand FROM part) x")
def sort_natural(t: Tables):
    """Brands by number, not by digits: Brand#9 before Brand#10. One row for each brand."""
    brands = t.part.select("p_brand").distinct()
    order = Window.orderBy(F.regexp_replace("p_brand", "[0-9]+", ""), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int"))
    return brands.select("p_brand", F.row_number().over(order).cast("long").alias("pos"))


@query("SELECT c_custkey AS key, 'customer' AS side FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_acctbal < 0")
def set_union(t: Tables):
    side = lambda df, key, name: df.select(F.col(key).alias("key"), F.lit(name).alias("side"))
    return side(t.customer.where("c_acctbal < 0"), "c_custkey", "customer").unionByName(side(t.supplier.where("s_acctbal < 0"), "s_suppkey", "supplier"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_except(t: Tables):
    return t.customer.select("c_custkey").subtract(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersect(t: Tables):
    keys = lambda status: t.orders.where(F.col("o_orderstatus") == status).select("o_custkey")
    return keys("F").intersect(keys("P"))


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, min(p) AS p FROM (
  SELECT c_nationkey, c_custkey, 0 AS p FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_nationkey, c_custkey, 2 FROM customer) x GROUP BY 1, 2)
SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS rank FROM c) y WHERE rank <= 5
""")
def set_priority_merge(t: Tables):
    every = t.customer.select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 7 == 0, 0).when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2).alias("p"))
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("p", "c_custkey"))
    return every.withColumn("rank", rank.cast("long")).where("rank <= 5").select("c_nationkey", "c_custkey", "rank")


@query("SELECT o_custkey, bit_or(f)::BIGINT AS reasons, (bit_or(f) & ~2)::BIGINT AS added FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 4 END AS f FROM orders) x GROUP BY 1")
def bit_setdiff(t: Tables):
    flag = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(4)
    rows = t.orders.groupBy("o_custkey").agg(F.bit_or(flag).alias("reasons"))
    return rows.select("o_custkey", F.col("reasons").cast("long").alias("reasons"), F.col("reasons").bitwiseAND(F.bitwise_not(F.lit(2))).cast("long").alias("added"))


@query("""
SELECT n_nationkey, coalesce(user_v, region_v, 10.0) AS asked, least(greatest(coalesce(user_v, region_v, 10.0), 5.0), 60.0) AS level, coalesce(user_v, region_v, 10.0) <> least(greatest(coalesce(user_v, region_v, 10.0), 5.0), 60.0) AS adjusted
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 4.0::DOUBLE END AS user_v, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 8.0::DOUBLE END AS region_v FROM nation JOIN region ON n_regionkey = r_regionkey) x
""")
def compose_cfg(t: Tables):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") * 4.0).alias("user"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey") * 8.0).alias("area"), F.lit(10.0).alias("default"))
    return configs.composed(rows, ["user", "area", "default"], "level", 5.0, 60.0).select("n_nationkey", "asked", "level", "adjusted")


@query("""
SELECT p_partkey, path, asked, got FROM (
  SELECT p_partkey, 'p_size' AS path, p_size::DOUBLE AS asked, least(greatest(p_size::DOUBLE, 5.0), 40.0) AS got FROM part
  UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice, least(greatest(p_retailprice, 950.0), 1800.0) FROM part) x WHERE asked <> got
""")
def clamp_audit(t: Tables):
    return configs.adjustments(t.part, "p_partkey", [("p_size", 5.0, 40.0), ("p_retailprice", 950.0, 1800.0)])


@query("""
SELECT event_type, user_id, coalesce(v, 4 + user_id % 7) AS talkers FROM (SELECT DISTINCT event_type, user_id FROM events) e
LEFT JOIN (VALUES ('click', 10), ('view', 24)) m(event_type, v) USING (event_type)
""")
def lookup_fallback(t: Tables):
    table = t.spark.createDataFrame([("click", 10), ("view", 24)], "event_type string, value long")
    return configs.counts_for(t.events.select("event_type", "user_id").distinct(), table, "event_type", 4 + F.col("user_id") % 7, "talkers")


@query("""
WITH x AS (SELECT s_suppkey, s_suppkey % 9 AS available, 2 + s_suppkey % 6 AS wanted, CASE s_suppkey % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'safe' ELSE 'continuous' END AS policy FROM supplier),
m AS (SELECT *, least(greatest((available - 1)::DOUBLE / wanted, 0.0), 1.0) AS ratio,
  CASE WHEN available >= wanted THEN 'as planned' WHEN policy = 'strict' THEN 'error' WHEN policy = 'safe' OR available < 2 THEN 'stationary' ELSE 'reduced' END AS mode FROM x)
SELECT s_suppkey, mode, round(CASE mode WHEN 'as planned' THEN 1.0 WHEN 'reduced' THEN ratio ELSE 0.0 END, 6) AS share, round(CASE mode WHEN 'reduced' THEN least(0.6, 0.5 * (1 - ratio)) ELSE 0.0 END, 6) AS stationary FROM m
""")
def degrade(t: Tables):
    policy = F.element_at(F.array(F.lit("strict"), F.lit("safe"), F.lit("continuous")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 9).alias("available"), (2 + F.col("s_suppkey") % 6).alias("wanted"), policy.alias("policy"))
    return configs.degraded(rows, "available", "wanted", "policy").select("s_suppkey", "mode", "share", "stationary")


@query("""
SELECT user_id, round(least(greatest(0.8 * sum(value) * 60 / greatest(count(*) / 30.0, 1e-3), 300.0), 2700.0), 6) AS cooldown_s FROM events GROUP BY 1
""")
def cooldown_len(t: Tables):
    """0.8 times the material for each active talker, between 300 and 2700 seconds."""
    return t.events.groupBy("user_id").agg(F.round(C.clamp(0.8 * F.sum("value") * 60 / F.greatest(F.count("*") / 30, F.lit(1e-3)), 300.0, 2700.0), 6).alias("cooldown_s"))


