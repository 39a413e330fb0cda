"""Writers and readers of files, there and back through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators.intervals import micros
from parlance.plans.registry import DAY, Tables, query
from parlance.sources import files, versions, wav
from parlance.streaming.stateful import folder


@query("SELECT event_id, user_id, event_type FROM events")
def read_piped(t: Tables):
    path = folder(t.spark, "piped")
    line = F.concat(F.lit("  "), "event_id", F.lit(" | "), "user_id", F.lit("|  "), "event_type", F.lit(" "))
    t.events.select(F.explode(F.array(F.lit("; a comment"), line)).alias("value")).write.text(path)
    return files.piped(t.spark, path, "event_id long, user_id long, event_type string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_json_folder(t: Tables):
    path = folder(t.spark, "json")
    t.nation.select("n_nationkey", "n_name", "n_regionkey", F.col("n_nationkey").alias("part")).write.partitionBy("part").json(path)
    rows = files.json_folder(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")
    return rows.select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT user_id % 5 AS seed, event_id AS id, epoch_us(ts) AS start, epoch_us(ts) + 1000000 AS \"end\", value AS gain FROM events")
def read_timeline(t: Tables):
    """Timelines written as one document for each seed, and read as events."""
    path = folder(t.spark, "timelines")
    start = micros("ts")
    files.write_timelines(t.events.select((F.col("user_id") % 5).alias("seed"), F.col("event_id").alias("id"), start.alias("start"), (start + 1_000_000).alias("end"), F.col("value").alias("gain")), path)
    return files.timeline(t.spark, path).select("seed", "id", "start", "end", "gain")


@query("SELECT n_nationkey AS cell, n_nationkey * 1.5 AS level FROM nation")
def read_metrics(t: Tables):
    """Metric documents, some bare and some in a field."""
    path = folder(t.spark, "metrics")
    k = F.col("n_nationkey")
    bare = F.struct(k.alias("cell"), F.struct((k * 1.5).alias("db")).alias("level"))
    doc = F.when(k % 2 == 0, F.to_json(bare)).otherwise(F.to_json(F.struct(bare.alias("metrics"))))
    t.nation.select(doc.alias("value"), k.alias("part")).write.partitionBy("part").text(path)
    return files.metrics(t.spark, path, "cell:long,level:struct<db:double>").select("cell", F.col("level.db").alias("level"))


@query(f"""
WITH d AS (SELECT epoch_us(ts) // {DAY} AS day, event_type FROM events), k AS (SELECT DISTINCT day FROM d ORDER BY day DESC LIMIT 7)
SELECT day, event_type, count(*) AS n FROM d JOIN k USING (day) GROUP BY 1, 2
""")
def log_sink(t: Tables):
    """A log of JSON lines, a folder for each day, of which the newest seven stay."""
    path = folder(t.spark, "log")
    files.write_log(t.events.select("event_id", "event_type", F.date_from_unix_date(F.floor(micros("ts") / DAY).cast("int")).alias("at")), path)
    files.rotate_log(t.spark, path, 7)
    rows = t.spark.read.schema("event_id long, event_type string, date date").json(path)
    return rows.groupBy(F.unix_date("date").cast("long").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, 16000 AS rate, count(*) AS samples, round(sum((value / 1024)::FLOAT::DOUBLE), 6) AS total, round(max((value / 1024)::FLOAT)::DOUBLE, 9) AS peak FROM events GROUP BY 1")
def wav_roundtrip(t: Tables):
    """Series written as WAV files and decoded again."""
    series = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"] / 1024).alias("x"))
    rows = wav.read_wav(wav.write_wav(series, "user_id", "x", 16_000)).where("reason is null")
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("user_id"), "rate", F.size("samples").cast("long").alias("samples"), F.round(total, 6).alias("total"), F.round(F.array_max("samples").cast("double"), 9).alias("peak"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def versioned_tables(t: Tables):
    """Two generations of a table; the manifest points to the second, and the first is purged."""
    path = folder(t.spark, "versions")
    versions.commit(t.spark, path, "v1", {"orders": t.orders.where("o_orderstatus = 'F'"), "nation": t.nation})
    versions.commit(t.spark, path, "v2", {"orders": t.orders})
    versions.purge(t.spark, path)
    return versions.table(t.spark, path, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
