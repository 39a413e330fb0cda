"""Readers of files and folders: scans by extension, JSON folders, CSV of speakers, piped text, timelines, metrics, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that a scan takes.
EXTENSIONS = ("wav", "wave", "aif", "aiff", "aifc", "flac", "mp3", "ogg", "oga", "opus", "m4a", "mp4", "aac")


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, ext, length, modified, content of all files below a folder with one of the extensions; content is read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", ext.alias("ext"), "length", F.col("modificationTime").alias("modified"), "content").where(F.col("ext").isin(*extensions))


def json_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A row for each JSON document of a folder, with its file's name; a document that doesn't parse fails the load."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def speakers_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, speaker, language, labels; quoted fields, an optional header row, and rows without a speaker are skipped."""
    rows = spark.read.schema("file string, speaker string, language string, labels string").option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    header = (F.lower(F.trim("file")) == "file") & (F.lower(F.trim("speaker")) == "speaker")
    return rows.where(~F.coalesce(header, F.lit(False)) & (F.trim("file") != "") & (F.trim("speaker") != ""))


def piped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields between bars, without white space around them; lines that begin with a semicolon are comments."""
    rows = spark.read.schema(schema).option("sep", "|").option("comment", ";").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return rows.csv(path)


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """condition, metric, observed, target, n: means of repeats; a bad row is fatal."""
    rows = spark.read.schema("condition string, metric string, observed double, target double").option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.groupBy("condition", "metric").agg(F.avg("observed").alias("observed"), F.avg("target").alias("target"), F.count("*").alias("n"))


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """Events of timeline documents: a row for each, with the document's seed."""
    event = "struct<id:long,epoch:long,slot:int,speaker:string,recording:string,segment:long,start:long,fadeIn:long,fadeOutStart:long,end:long,anchor:long,gain:double,levelVarDb:double,pan:double,flags:int>"
    docs = spark.read.schema(f"schema string, seed long, corpusVersion string, epoch long, events array<{event}>").option("multiLine", True).json(path)
    return docs.select("seed", F.explode("events").alias("e")).select("seed", "e.*")


def write_timelines(events: DataFrame, folder: str, seed: str = "seed") -> None:
    """A timeline document for each seed, its events in order of start and id; the folder's files are what timeline() reads."""
    fields = [c for c in events.columns if c != seed]
    rest = [c for c in fields if c not in ("start", "id")]
    docs = events.groupBy(seed).agg(F.array_sort(F.collect_list(F.struct("start", "id", *rest))).alias("events"))
    docs.withColumn("part", F.col(seed)).write.partitionBy("part").json(folder)


def metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric documents, either bare or in a metrics field."""
    docs = spark.read.schema(f"metrics struct<{schema}>, {schema.replace(':', ' ')}").option("multiLine", True).json(path)
    bare = F.struct(*(F.col(c.split(":")[0]) for c in _fields(schema)))
    return docs.select(F.coalesce("metrics", bare).alias("m")).select("m.*")


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(at.strip())
            at = ""
        else:
            at += c
    return [*out, at.strip()]


def write_log(events: DataFrame, folder: str, at: str = "at") -> None:
    """Log events as JSON lines, a folder for each day."""
    events.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date").json(folder)


def rotate_log(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Deletes the oldest days of a log, so that the newest few are left; gives their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("date="))
    gone = days[: max(0, len(days) - keep)]
    for day in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, day), True)
    return [d.removeprefix("date=") for d in gone]
