"""What a selector asks of its material, and digests and checks of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.operators import documents, planning, selection, sequences, spatial, spread, stats
from parlance.operators import series as S
from parlance.operators.documents import Field
from parlance.plans.joins import _ISLANDS, islands_of
from parlance.plans.kernels import _F as _FRAMES
from parlance.plans.kernels import _frames
from parlance.plans.registry import DAY, HOUR, SPANS, Tables, query, spans
from parlance.plans.scans import _SCENARIOS, scenario_texts


@query(f"WITH {_ISLANDS} SELECT user_id, a AS start, b AS \"end\" FROM islands WHERE b - a >= {HOUR + HOUR // 2}")
def material_eligible(t: Tables):
    return selection.eligible_material(islands_of(t), "start", "end", HOUR, HOUR // 2).select("user_id", "start", "end")


@query(f"""
WITH {SPANS} SELECT event_id FROM spans s WHERE NOT EXISTS (
  SELECT 1 FROM spans c WHERE c.user_id = s.user_id AND c.event_type = 'error' AND s.t0 >= c.t1 AND s.t0 < c.t1 + {6 * HOUR})
""")
def cooldown_intervals(t: Tables):
    """Events outside the hours after any error of the same user."""
    cooled = spans(t).where("event_type = 'error'").select("user_id", F.col("t1").alias("start"), (F.col("t1") + 6 * HOUR).alias("end"))
    return selection.not_cooled(spans(t), cooled, ["user_id"], "t0", "event_id", 6 * HOUR).select("event_id")


_NOW = 1_704_067_200_000_000 + 31 * DAY
_WEIGHTS = f"""w AS (SELECT user_id, round(least(coalesce(1 + ({_NOW} - max(epoch_us(ts)) FILTER (WHERE event_type = 'click')) / {10 * DAY}, 3.0), 3.0)
  * ((count(*) FILTER (WHERE event_type = 'error')) * 0.25 + count(*) FILTER (WHERE event_type <> 'error')) / count(*) * (1 + user_id % 3), 9) AS weight FROM events GROUP BY user_id)"""


def _weights(t: Tables):
    rows = spans(t).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("t0"))).alias("last"), F.count_if(F.col("event_type") == "error").alias("solo"), F.count("*").alias("n"))
    return rows.select("user_id", F.round(selection.weight(1 + F.col("user_id") % 3, (F.lit(_NOW) - F.col("last")) / (10 * DAY), F.col("solo"), F.col("n"), 0.25), 9).alias("weight"))


@query(f"WITH {_WEIGHTS} SELECT * FROM w")
def pick_weight(t: Tables):
    return _weights(t)


_RECENT = """r AS (SELECT event_type, list(user_id ORDER BY k DESC) AS recent FROM (
  SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k <= 40 GROUP BY 1)"""


def _recent(t: Tables):
    return selection.recent(t.events, ["event_type"], ["ts", "event_id"], "user_id", 40)


@query(f"WITH {_RECENT} SELECT event_type, array_to_string(recent, ',') AS recent FROM r")
def recent_list(t: Tables):
    return _recent(t).select("event_type", F.array_join(F.col("recent").cast("array<string>"), ",").alias("recent"))


@query(f"""
WITH {_WEIGHTS}, {_RECENT}, c AS (SELECT DISTINCT event_type, user_id FROM events WHERE value > 300),
s AS (SELECT event_type, user_id, CASE WHEN NOT list_contains(recent, user_id) THEN 0 WHEN len(recent) - list_position(recent, user_id) >= 20 THEN 1 ELSE 2 END AS stage,
  -ln((('0x' || left(md5('7/' || event_type || '/' || user_id), 8))::BIGINT + 0.5) / 4294967296.0) / weight AS draw FROM c JOIN w USING (user_id) LEFT JOIN r USING (event_type))
SELECT event_type, arg_min(stage, [stage, draw, user_id]) AS stage, arg_min(user_id, [stage, draw, user_id]) AS user_id FROM s GROUP BY 1
""")
def weighted_pick(t: Tables):
    """A weighted choice, relaxed in three stages."""
    candidates = t.events.where("value > 300").select("event_type", "user_id").distinct().join(_weights(t), "user_id")
    return selection.relaxed_pick(candidates, ["event_type"], "user_id", "weight", _recent(t), 40, 7)


@query("""
WITH z AS (SELECT n_nationkey, 0.5 + n_nationkey % 5 AS mean, 1 + n_nationkey % 3 AS least, 4 + n_nationkey % 4 AS most, count(s_suppkey) AS outputs, 1 + n_nationkey % 2 AS zones FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
s AS (SELECT *, ceil(most * outputs / zones - 1e-9) AS top, ceil(least * outputs / zones - 1e-9) AS low FROM z), f AS (SELECT *, CASE WHEN top > 12 THEN 12 / top ELSE 1.0 END AS f FROM s)
SELECT n_nationkey, round(mean * outputs / zones * f, 6) AS total_mean, (CASE WHEN top > 12 THEN floor(low * f) ELSE low END)::BIGINT AS total_min, least(top, 12)::BIGINT AS total_max, round(mean * f, 6) AS effective, top > 12 AS capped FROM f
""")
def zone_density(t: Tables):
    k = F.col("n_nationkey")
    zones = t.nation.join(t.supplier, F.col("s_nationkey") == k, "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("outputs"))
    out = selection.density(0.5 + k % 5, 1 + k % 3, 4 + k % 4, F.col("outputs"), 1 + k % 2, 12)
    return zones.select("n_nationkey", *(F.round(c, 6).alias(n) if n in ("total_mean", "effective") else c.alias(n) for n, c in out.items()))


_POWERS = """g AS (SELECT s_nationkey, s_acctbal, c, exp(-pow(c - s_suppkey % 4, 2)) AS g, sum(exp(-2 * pow(c - s_suppkey % 4, 2))) OVER (PARTITION BY s_suppkey) AS whole
  FROM supplier, (SELECT unnest(range(0, 4)) AS c) x WHERE s_acctbal > 0),
e AS (SELECT s_nationkey, c AS channel, sum(s_acctbal * g * g / whole) AS power FROM g GROUP BY 1, 2)"""


def _channel_powers(t: Tables):
    talkers = t.supplier.where("s_acctbal > 0").select("s_nationkey", "s_acctbal", spatial.placement_gains((F.col("s_suppkey") % 4).cast("double"), 4).alias("gains"))
    return spatial.expected_power(talkers, ["s_nationkey"], "s_acctbal", "gains")


@query(f"WITH {_POWERS} SELECT s_nationkey, channel, round(power, 6) AS power FROM e")
def channel_power(t: Tables):
    return _channel_powers(t).select("s_nationkey", F.col("channel").cast("long").alias("channel"), F.round("power", 6).alias("power"))


@query(f"""
WITH {_POWERS}, m AS (SELECT s_nationkey, avg(power) AS mean FROM e GROUP BY 1)
SELECT s_nationkey, channel, round(least(3.0, greatest(-3.0, 10 * log10(mean / power))), 6) AS trim_db FROM e JOIN m USING (s_nationkey)
""")
def channel_balance(t: Tables):
    return spatial.trims(_channel_powers(t), ["s_nationkey"]).select("s_nationkey", F.col("channel").cast("long").alias("channel"), F.round("trim_db", 6).alias("trim_db"))


@query(f"""
WITH {_ISLANDS}, h AS (SELECT user_id, a, replace(concat(list_reduce(list_transform(range(0, 8), lambda k: substr(printf('%016x', a), 15 - 2 * k, 2)), lambda x, y: x || y),
  list_reduce(list_transform(range(0, 8), lambda k: substr(printf('%016x', b), 15 - 2 * k, 2)), lambda x, y: x || y),
  list_reduce(list_transform(range(0, 8), lambda k: substr(printf('%016x', n), 15 - 2 * k, 2)), lambda x, y: x || y)), ' ', '') AS bytes FROM islands)
SELECT user_id, sha256(unhex(string_agg(bytes, '' ORDER BY a))) AS digest FROM h GROUP BY 1
""")
def segment_digest(t: Tables):
    return selection.packed_digest(islands_of(t), ["user_id"], ["start"], ["start", "end", "n"])


@query("""
SELECT count(*) AS n, left(sha256(count(*) || '|' || sum(('0x' || left(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 15))::HUGEINT)), 16) AS digest FROM orders
""")
def data_digest(t: Tables):
    return selection.table_digest(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("""
WITH d AS (SELECT o_orderkey, '{"a":{"x":' || o_custkey || ',"y":"' || o_orderstatus || '"},"b":[' || o_orderkey || ',true],"c":null}' AS doc FROM orders)
SELECT o_orderkey, doc AS canonical, 'sha256:' || sha256(doc) AS hash FROM d
""")
def json_canonical(t: Tables):
    doc = F.concat(F.lit('{ "c" : null, "b": ['), "o_orderkey", F.lit(', true],\n "a":{"y":"'), "o_orderstatus", F.lit('", "x":'), "o_custkey", F.lit("}}"))
    rows = t.orders.select("o_orderkey", selection.canonical(doc).alias("canonical"))
    return rows.withColumn("hash", F.concat(F.lit("sha256:"), F.sha2(F.col("canonical").cast("binary"), 256)))


@query(f"""
WITH {_SCENARIOS}, j AS (SELECT n_nationkey, CASE WHEN json_valid(doc) THEN doc::JSON END AS doc FROM x),
p AS (SELECT n_nationkey, doc->>'name' AS name, coalesce((doc->>'voices')::INTEGER, 8) AS voices, coalesce((doc->>'mean')::DOUBLE, 2.0) AS mean, coalesce((doc->>'seconds')::DOUBLE, 60.0) AS seconds FROM j)
SELECT n_nationkey, CASE WHEN name IS NULL THEN 'no object with a name' WHEN voices < 1 THEN 'voices under 1' WHEN NOT mean BETWEEN 0.5 AND voices THEN 'mean out of range' WHEN NOT seconds BETWEEN 1 AND 3600 THEN 'seconds out of range' END AS error FROM p
""")
def preset_check(t: Tables):
    return selection.problems(planning.scenarios(scenario_texts(t), "doc")).select("n_nationkey", "error")


_PRESETS = """
CASE WHEN c_custkey % 11 = 10 THEN c_name ELSE concat('{"schemaVersion":"', CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 1 END, '.', c_custkey % 4, '"',
  CASE WHEN c_custkey % 7 > 0 THEN concat(',"name":"', c_name, '"') ELSE '' END, ',"strategy":"', c_mktsegment, '","macros":{"strengthDb":', c_acctbal,
  CASE WHEN c_custkey % 3 > 0 THEN concat(',"character":0.', c_custkey % 10) ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN ',"voiceAmount":"high"' ELSE '' END,
  CASE WHEN c_custkey % 6 = 0 THEN ',"mood":{"deep":1}' ELSE '' END, '},"outputs":', CASE WHEN c_custkey % 9 = 0 THEN '[]' ELSE concat('{"limiter":{"enabled":',
  CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE '1' END, ',"ceilingDbtp":-', c_custkey % 4, '.5}}') END, CASE WHEN c_custkey % 8 = 0 THEN ',"colour":null' ELSE '' END, '}') END"""

_PRESET = [
    Field("schemaVersion", "version", True, version=(1, 2)), Field("name", "text", True), Field("strategy", "text", choices=("FURNITURE", "MACHINERY", "BUILDING")),
    Field("macros", "object", True), Field("macros.strengthDb", "number", True, 0, 5000), Field("macros.character", "number", True, 0, 1), Field("macros.voiceAmount", "number", False, 0, 1),
    Field("outputs", "object", True), Field("outputs.limiter", "object"), Field("outputs.limiter.enabled", "flag", True), Field("outputs.limiter.ceilingDbtp", "number", False, -2, 0),
]


@query(f"""
WITH d AS (SELECT c_custkey, {_PRESETS} AS doc FROM customer), j AS (SELECT c_custkey, CASE WHEN json_valid(doc) THEN doc::JSON END AS doc FROM d),
s AS (SELECT * FROM (VALUES ('schemaVersion', '$', 'VARCHAR', true, NULL, NULL), ('name', '$', 'VARCHAR', true, NULL, NULL), ('strategy', '$', 'VARCHAR', false, NULL, NULL), ('macros', '$', 'OBJECT', true, NULL, NULL),
  ('macros.strengthDb', '$.macros', 'BIGINT|DOUBLE', true, 0.0, 5000.0), ('macros.character', '$.macros', 'BIGINT|DOUBLE', true, 0, 1), ('macros.voiceAmount', '$.macros', 'BIGINT|DOUBLE', false, 0, 1),
  ('outputs', '$', 'OBJECT', true, NULL, NULL), ('outputs.limiter', '$.outputs', 'OBJECT', false, NULL, NULL), ('outputs.limiter.enabled', '$.outputs.limiter', 'BOOLEAN', true, NULL, NULL),
  ('outputs.limiter.ceilingDbtp', '$.outputs.limiter', 'BIGINT|DOUBLE', false, -2, 0)) f(path, parent, kinds, needed, low, high)),
x AS (SELECT c_custkey, s.*, nullif(json_type(doc, '$.' || path), 'NULL') AS kind, json_extract_string(doc, '$.' || path) AS text, coalesce(json_type(doc, parent) = 'OBJECT', false) AS inside FROM j, s WHERE json_type(doc) = 'OBJECT'),
k AS (SELECT *, coalesce(regexp_matches(kind, kinds), false) AS fits FROM x),
u AS (SELECT c_custkey, parent, unnest(json_keys(doc, parent)) AS name FROM j, (SELECT DISTINCT parent FROM s) p WHERE json_type(doc, parent) = 'OBJECT')
SELECT c_custkey, '$' AS path, 'document' AS fault FROM j WHERE doc IS NULL
UNION ALL SELECT c_custkey, path, 'type' FROM k WHERE kind IS NOT NULL AND NOT fits
UNION ALL SELECT c_custkey, path, 'missing' FROM k WHERE needed AND inside AND kind IS NULL
UNION ALL SELECT c_custkey, path, 'range' FROM k WHERE fits AND NOT TRY_CAST(text AS DOUBLE) BETWEEN low AND high
UNION ALL SELECT c_custkey, path, 'choice' FROM k WHERE path = 'strategy' AND fits AND text NOT IN ('FURNITURE', 'MACHINERY', 'BUILDING')
UNION ALL SELECT c_custkey, path, 'version' FROM k WHERE path = 'schemaVersion' AND fits AND split_part(text, '.', 1)::INTEGER > 1
UNION ALL SELECT c_custkey, concat(substr(parent || '.', 3), name), 'unknown' FROM u WHERE concat(substr(parent || '.', 3), name) NOT IN (SELECT path FROM s)
""")
def preset_faults(t: Tables):
    """Every fault of a preset document for each customer, by its path."""
    customers = spread.even(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "c_custkey")
    docs = customers.select("c_custkey", F.expr(_PRESETS).alias("doc"))
    return documents.faults(docs, ["c_custkey"], "doc", _PRESET).select("c_custkey", "path", "fault")


@query("SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE NULL END AS code, CASE left(o_orderpriority, 1) WHEN '1' THEN '1-URGENT' WHEN '2' THEN '2-HIGH' WHEN '3' THEN '3-MEDIUM' ELSE 'unknown' END AS printed FROM orders")
def enum_parse(t: Tables):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    code = C.parsed("o_orderpriority", names)
    return t.orders.select("o_orderkey", code.alias("code"), C.printed(code, names, "unknown").alias("printed"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS level FROM events WHERE event_type IN ('error', 'purchase')")
def log_gate(t: Tables):
    level = F.coalesce(C.parsed("event_type", ["view", "click", "purchase", "error"]), F.lit(0))
    return t.events.select("event_id", level.alias("level")).where(F.col("level") >= 2)


@query("""
WITH p AS (SELECT vec_id, unnest(range(1, 65)) AS k, unnest(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS p FROM embeddings),
n AS (SELECT *, lag(p) OVER (PARTITION BY vec_id ORDER BY k) AS before, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS after, max(p) OVER (PARTITION BY vec_id) AS top FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS rank FROM n WHERE p > before AND p >= after AND p >= top * 1e-3)
SELECT vec_id, string_agg(k, ',' ORDER BY rank) AS peaks FROM r WHERE rank <= 5 GROUP BY 1
""")
def spectral_peaks(t: Tables):
    """The five strongest local maxima of a spectrum, none 30 dB under the strongest value."""
    power = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return t.embeddings.select("vec_id", F.array_join(C.top_peaks(power, 5, 1e-3).cast("array<string>"), ",").alias("peaks")).where("peaks <> ''")


@query("""
WITH a(i, x, y) AS (VALUES (0, 0.0, 0.0), (1, 10.0, 5.0), (2, 20.0, 6.0), (3, 35.0, 6.0), (4, 50.0, 20.0)),
s AS (SELECT i, x, y, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d, x - lag(x) OVER w AS h0, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS d0 FROM a WINDOW w AS (ORDER BY i)),
e AS (SELECT *, lead(h) OVER (ORDER BY i) AS h1, lead(d) OVER (ORDER BY i) AS d1, lag(h0) OVER (ORDER BY i) AS hb, lag(d0) OVER (ORDER BY i) AS db FROM s),
m AS (SELECT i, x, y, h, CASE
    WHEN i = 0 THEN CASE WHEN ((2 * h + h1) * d - h * d1) / (h + h1) * d <= 0 THEN 0.0 WHEN d * d1 <= 0 AND abs(((2 * h + h1) * d - h * d1) / (h + h1)) > 3 * abs(d) THEN 3 * d ELSE ((2 * h + h1) * d - h * d1) / (h + h1) END
    WHEN h IS NULL THEN CASE WHEN ((2 * h0 + hb) * d0 - h0 * db) / (h0 + hb) * d0 <= 0 THEN 0.0 WHEN d0 * db <= 0 AND abs(((2 * h0 + hb) * d0 - h0 * db) / (h0 + hb)) > 3 * abs(d0) THEN 3 * d0 ELSE ((2 * h0 + hb) * d0 - h0 * db) / (h0 + hb) END
    WHEN d0 * d <= 0 THEN 0.0 ELSE (3 * h0 + 3 * h) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) END AS m FROM e),
p AS (SELECT i, x, y, h, m, lead(y) OVER (ORDER BY i) AS y1, lead(m) OVER (ORDER BY i) AS m1 FROM m),
q AS (SELECT p_partkey, p_size::DOUBLE * 1.1 - 1 AS v FROM part)
SELECT p_partkey, round(CASE WHEN v <= 0 THEN 0.0 WHEN v >= 50 THEN 20.0 ELSE (2 * pow(u, 3) - 3 * u * u + 1) * y + (pow(u, 3) - 2 * u * u + u) * h * m + (3 * u * u - 2 * pow(u, 3)) * y1 + (pow(u, 3) - u * u) * h * m1 END, 6) AS value
FROM (SELECT p_partkey, v, (v - x) / h AS u, p.* FROM q LEFT JOIN p ON v >= x AND v < x + h) z
""")
def pchip(t: Tables):
    anchors = [(0.0, 0.0), (10.0, 5.0), (20.0, 6.0), (35.0, 6.0), (50.0, 20.0)]
    return t.part.select("p_partkey", F.round(C.monotone_cubic(F.col("p_size") * 1.1 - 1, anchors), 6).alias("value"))


@query("""
WITH b AS (SELECT c_custkey, list_transform(range(0, octet_length(encode(c_name))), lambda i: ('0x' || substr(hex(encode(c_name)), 2 * i + 1, 2))::BIGINT) AS b FROM customer)
SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, b), lambda a, x: xor(a, x) * 16777619 % 4294967296) AS hash FROM b
""")
def fnv_hash(t: Tables):
    return t.customer.select("c_custkey", C.fnv1a_32(F.col("c_name")).alias("hash"))


@query("""
WITH n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events),
f AS (SELECT a.event_id, a.user_id, a.value, a.n, a.c, sum(b.value * pow(0.9, a.n - b.n) * CASE WHEN b.n = 1 THEN 1.0 ELSE 0.1 END) AS f FROM n a JOIN n b ON a.user_id = b.user_id AND b.n <= a.n GROUP BY 1, 2, 3, 4, 5)
SELECT a.event_id, round(any_value(a.value) - sum(b.f * pow(0.9, b.n - a.n) * CASE WHEN b.n = b.c THEN 1.0 ELSE 0.1 END), 6) AS y FROM f a JOIN f b ON a.user_id = b.user_id AND b.n >= a.n GROUP BY 1
""")
def dc_removed(t: Tables):
    """Values without their slow part, which is smoothed forwards and then backwards, so that nothing is delayed."""
    rows = spans(t).select("user_id", "event_id", "t0", "value")
    forth = sequences.exponential_average(rows, ["user_id"], ["t0", "event_id"], "value", 0.1, F.col("t0"), DAY)
    turned = forth.select("user_id", (-F.col("t0")).alias("u0"), (-F.col("event_id")).alias("back"), "ema")
    slow = sequences.exponential_average(turned, ["user_id"], ["u0", "back"], "ema", 0.1, F.col("u0"), DAY)
    return rows.join(slow.select((-F.col("back")).alias("event_id"), "ema"), "event_id").select("event_id", F.round(F.col("value") - F.col("ema"), 6).alias("y"))


@query("""
WITH p AS (SELECT user_id, 10 * log10(greatest(lag(value) OVER w, 1e-20)) - 10 * log10(greatest(value, 1e-20)) AS decay, lag(value) OVER w AS la, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT user_id, decay FROM p WHERE gap >= 21600000000 AND la >= 50)
SELECT user_id, count(*) AS n, round(quantile_cont(decay, 0.5), 6) AS median, count(*) >= 5 AND quantile_cont(decay, 0.5) < 1.0 AS reverberant FROM d GROUP BY 1
""")
def reverberation(t: Tables):
    """How far the level falls over pauses, after values that are loud enough; reverberant if it is little, over five pauses or more."""
    placed = spread.numbered(spans(t).select("user_id", "event_id", "t0", "value"), ["user_id"], ["t0", "event_id"], F.col("t0"), DAY, "n")
    before = placed.select("user_id", (F.col("n") + 1).alias("n"), F.col("value").alias("la"), F.col("t0").alias("was"))
    decays = placed.join(before, ["user_id", "n"]).where((F.col("t0") - F.col("was") >= 6 * HOUR) & (F.col("la") >= 50)).select("user_id", "event_id", (C.db(F.col("la")) - C.db(F.col("value"))).alias("decay"))
    n = decays.groupBy("user_id").agg(F.count("*").alias("n"))
    return stats.quantiles(decays, ["user_id"], "decay", "event_id", {"median": 0.5}).join(n, "user_id").select("user_id", "n", F.round("median", 6).alias("median"), ((F.col("n") >= 5) & (F.col("median") < 1.0)).alias("reverberant"))


@query("SELECT doc_id, greatest(n_chars, 0.001) AS weight, n_chars AS speech, round(pow(10.0, least(n_chars, 2000) / 1000.0), 6) AS power FROM documents")
def contribution(t: Tables):
    n = F.col("n_chars")
    return t.documents.select("doc_id", F.greatest(n.cast("double"), F.lit(0.001)).alias("weight"), n.alias("speech"), F.round(C.power(F.least(n, F.lit(2000)) / 100), 6).alias("power"))


@query("""
SELECT epoch_us(ts) // 86400000000 AS day, '{"schema":"diagnostics/1","engine":{"events":' || count(*) || ',"users":' || count(DISTINCT user_id) || '},"faults":{"error":' || count(*) FILTER (WHERE event_type = 'error') ||
  '},"last":"' || arg_max(event_type, [epoch_us(ts), event_id]) || '"}' AS document FROM events GROUP BY 1
""")
def diagnostics(t: Tables):
    """One nested document for each day."""
    days = spans(t).groupBy(F.floor(F.col("t0") / DAY).alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("error"), F.max_by("event_type", F.struct("t0", "event_id")).alias("last"))
    return days.select("day", F.to_json(F.struct(F.lit("diagnostics/1").alias("schema"), F.struct("events", "users").alias("engine"), F.struct("error").alias("faults"), "last")).alias("document"))
