"""Scans, filters, projections and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.operators import curation
from parlance.plans.registry import SPANS, Tables, query, spans


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200")
def scan_filter(t: Tables):
    return t.documents.where("lang = 'en' and n_chars >= 200").select("doc_id", "n_chars")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_suppkey")
def scan_order(t: Tables):
    return t.supplier.select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'")
def scan_project(t: Tables):
    return t.lineitem.where(F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ'2001-01-01 00:00:00'")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(t: Tables):
    return t.customer.where("c_custkey = 42").select("c_custkey", "c_name")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def count_rows(t: Tables):
    count = lambda name: getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("orders").unionByName(count("lineitem")).unionByName(count("events"))


@query("SELECT (SELECT max(o_orderkey) FROM orders) AS max_order, (SELECT max(c_custkey) FROM customer) AS max_customer, (SELECT max(p_partkey) FROM part) AS max_part")
def max_ids(t: Tables):
    rows = t.orders.agg(F.max("o_orderkey").alias("max_order"))
    return rows.crossJoin(t.customer.agg(F.max("c_custkey").alias("max_customer"))).crossJoin(t.part.agg(F.max("p_partkey").alias("max_part")))


@query("SELECT doc_id, source FROM documents d WHERE n_chars > 0 AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic = 0)")
def semi_active(t: Tables):
    return curation.active(t.documents.where("n_chars > 0"), t.labels.where("quality = 1 and toxic = 0"), "doc_id").select("doc_id", "source")


@query("""
WITH versions AS (
  SELECT o_orderkey, o_orderstatus, 0 AS version FROM orders
  UNION ALL SELECT o_orderkey, 'U', 1 FROM orders WHERE o_orderkey % 10 = 0)
SELECT o_orderkey, arg_max(o_orderstatus, version) AS o_orderstatus FROM versions GROUP BY 1
""")
def upsert_latest(t: Tables):
    old = t.orders.select("o_orderkey", "o_orderstatus").withColumn("version", F.lit(0))
    new = t.orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), F.lit(1).alias("version"))
    return curation.upserted(old, new, ["o_orderkey"], "version").select("o_orderkey", "o_orderstatus")


@query("""
SELECT o_orderpriority, o_orderkey, rank FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) t
WHERE rank > 3 AND o_orderkey % 7 <> 0
""")
def retain_newest(t: Tables):
    return curation.expired(t.orders, ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, F.col("o_orderkey") % 7 == 0).select("o_orderpriority", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""
WITH numbered AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events)
SELECT u.user_id, p.pos, coalesce(n.value, 0.0) AS value
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(40, 80)) AS pos) p
LEFT JOIN numbered n ON n.user_id = u.user_id AND n.pos = p.pos
""")
def range_read(t: Tables):
    return curation.frame_range(t.events, "user_id", ["ts", "event_id"], "value", 40, 40)


@query("SELECT doc_id, source, coalesce(text, '') AS head FROM documents")
def csv_parse(t: Tables):
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), quoted(F.col("source")), quoted(F.col("text")))
    parsed = t.documents.select(F.from_csv(line, "doc_id long, source string, head string", {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true", "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("r"))
    return parsed.select("r.doc_id", "r.source", F.coalesce("r.head", F.lit("")).alias("head"))


@query("""
SELECT doc_id, CASE WHEN source = 'src0' THEN -1 ELSE 1 END AS class, CASE WHEN source = 'src0' THEN lang || ',user.removed' ELSE lang END AS codes FROM documents
""")
def cond_update(t: Tables):
    gone = F.col("source") == "src0"
    return t.documents.select("doc_id", F.when(gone, -1).otherwise(1).alias("class"), F.when(gone, F.concat_ws(",", "lang", F.lit("user.removed"))).otherwise(F.col("lang")).alias("codes"))


@query("""
SELECT doc_id, round(12 * log2(n_chars / 100.0), 6) AS semitones, round(log2(greatest(n_chars, 1)), 6) AS octaves,
  CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE -1 END AS code,
  round(greatest(0.01, n_chars / 10000.0), 6) AS weight
FROM documents WHERE n_chars > 0
""")
def feat_project(t: Tables):
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in enumerate(("en", "de", "fr", "es")) for x in (v, k))), F.col("lang")), F.lit(-1))
    return t.documents.where("n_chars > 0").select("doc_id", F.round(C.semitones(F.col("n_chars")), 6).alias("semitones"), F.round(F.log2(F.greatest("n_chars", F.lit(1))), 6).alias("octaves"), code.alias("code"), F.round(F.greatest(F.lit(0.01), F.col("n_chars") / 10000), 6).alias("weight"))


_QUALITY_SQL = """
m AS (SELECT d.doc_id, d.source, d.n_chars, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, list_filter([CASE WHEN n_chars < 100 THEN 'reject.short' END, CASE WHEN toxic = 1 THEN 'reject.toxic' END,
    CASE WHEN n_chars >= 100 AND n_chars < 500 THEN 'warn.short' END, CASE WHEN quality = 0 THEN 'warn.quality' END], lambda x: x IS NOT NULL) AS codes,
  n_chars < 100 OR toxic = 1 AS hard,
  greatest(0.0, 100.0 - 40.0 * least(greatest((n_chars - 500.0) / (100.0 - 500.0), 0.0), 1.0) - CASE WHEN quality = 0 THEN 30.0 ELSE 0.0 END) AS score FROM m),
q AS (SELECT doc_id, source, n_chars, round(score, 6) AS score,
  CASE WHEN hard OR score < 50 THEN 'rejected' WHEN score >= 80 THEN 'good' ELSE 'usable' END AS class,
  CASE WHEN NOT hard AND score < 50 THEN list_append(codes, 'reject.quality') ELSE codes END AS codes FROM r)
"""


@query(f"WITH {_QUALITY_SQL} SELECT doc_id, score, class, array_to_string(codes, ',') AS codes FROM q")
def quality_class(t: Tables):
    return curation.document_quality(t.documents, t.labels).select("doc_id", "score", "class", F.array_join("codes", ",").alias("codes"))


@query(f"""
WITH {_QUALITY_SQL}
SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM q WHERE class = 'rejected') t WHERE code NOT LIKE 'warn.%' GROUP BY 1
""")
def agg_reasons(t: Tables):
    return curation.reject_reasons(curation.document_quality(t.documents, t.labels))


@query(f"""
WITH {_QUALITY_SQL}
SELECT class, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE len(codes) > 0) AS flagged FROM q GROUP BY 1
""")
def agg_tally(t: Tables):
    rows = curation.document_quality(t.documents, t.labels)
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.size("codes") > 0).alias("flagged"))


@query("""
WITH s AS (SELECT source, avg(n_chars) AS m, stddev_pop(n_chars) AS sd FROM documents GROUP BY 1)
SELECT doc_id, source FROM documents JOIN s USING (source) WHERE n_chars > 0 AND sd > 0 AND abs(n_chars - m) / sd <= 2.5
""")
def eligible(t: Tables):
    return curation.within_spread(t.documents.where("n_chars > 0"), ["source"], "n_chars", 2.5, t.documents).select("doc_id", "source")


@query(f"""
WITH {SPANS}, w AS (SELECT epoch_us(TIMESTAMP '2024-01-10') AS a, epoch_us(TIMESTAMP '2024-01-12') AS b)
SELECT event_id, greatest(t0, a) AS t0, least(t1, b) AS t1 FROM spans, w WHERE greatest(t0, a) < least(t1, b)
""")
def clip_events(t: Tables):
    a, b = 1_704_844_800_000_000, 1_705_017_600_000_000
    rows = spans(t).where((F.col("t0") < b) & (F.col("t1") > a))
    return rows.select("event_id", F.greatest("t0", F.lit(a)).alias("t0"), F.least("t1", F.lit(b)).alias("t1")).where("t0 < t1")


@query("SELECT vec_id, list_transform(embedding, lambda x: round(pow(10.0, x::DOUBLE / 10), 6)) AS power FROM embeddings")
def db_to_power(t: Tables):
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(C.power(x.cast("double")), 6)).alias("power"))


@query("""
SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n FROM (
  SELECT user_id, island, count(*) AS n FROM (
    SELECT user_id, sum(CASE WHEN gap IS NULL OR gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t0, event_id) AS island FROM (
      SELECT user_id, event_id, epoch_us(ts) AS t0, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) a) b
  GROUP BY 1, 2) c GROUP BY 1
""")
def load_join(t: Tables):
    """Children counted within their parents and joined to them; parents without children keep none."""
    sessions = curation.sessions(spans(t), "user_id", "t0", "event_id", 21_600_000_000)
    return sessions.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"))


_SCENARIOS = """x AS (SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 6 THEN 'no document' ELSE '{"name":"' || n_name || '"' ||
  CASE WHEN n_nationkey % 3 > 0 THEN ',"voices":' || n_nationkey % 12 ELSE '' END || CASE WHEN n_nationkey % 4 > 0 THEN ',"mean":' || n_nationkey % 5 || '.5' ELSE '' END ||
  CASE WHEN n_nationkey % 5 > 0 THEN ',"seconds":' || n_nationkey * 200 ELSE '' END || '}' END AS doc FROM nation)"""


@query(f"""
WITH {_SCENARIOS}, j AS (SELECT n_nationkey, CASE WHEN json_valid(doc) THEN doc::JSON END AS doc FROM x),
p AS (SELECT n_nationkey, doc->>'name' AS name, coalesce((doc->>'voices')::INTEGER, 8) AS voices, coalesce((doc->>'mean')::DOUBLE, 2.0) AS mean, coalesce((doc->>'seconds')::DOUBLE, 60.0) AS seconds FROM j)
SELECT *, name IS NOT NULL AND voices >= 1 AND mean BETWEEN 0.5 AND voices AND seconds BETWEEN 1 AND 3600 AS valid FROM p
""")
def scenario_rows(t: Tables):
    """Scenarios read from JSON texts, some of them with gaps, out of range or no JSON."""
    from parlance.operators import planning

    return planning.scenarios(scenario_texts(t), "doc").drop("doc")


def scenario_texts(t: Tables):
    k = F.col("n_nationkey")
    part = lambda test, *text: F.when(test, F.concat(*text)).otherwise("")
    doc = F.concat(F.lit('{"name":"'), "n_name", F.lit('"'), part(k % 3 > 0, F.lit(',"voices":'), k % 12), part(k % 4 > 0, F.lit(',"mean":'), k % 5, F.lit(".5")), part(k % 5 > 0, F.lit(',"seconds":'), k * 200), F.lit("}"))
    return t.nation.select("n_nationkey", F.when(k % 7 == 6, "no document").otherwise(doc).alias("doc"))


@query()
def synth_gen(t: Tables):
    from parlance.functions import signal

    return signal.synthetic_corpus(t.spark, speakers=4, recordings=2, seconds=6.0, seed=7).select("speaker", "recording", "n_regions", "speech_seconds")


