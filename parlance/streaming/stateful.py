"""Streams over files: windows, rate limits, and keyed state that lasts from batch to batch."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a temporary one where none is set, as in tests in one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    shared = shared or "file://" + tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/parlance-streams/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as they arrive, with at: their time as a timestamp of the session's zone."""
    schema = spark.read.parquet(path).schema
    # As a pattern: a stream's plain path would have to be a folder.
    pattern = re.sub(r"(\w)(\.parquet)$", r"[\1]\2", path)
    return spark.readStream.schema(schema).parquet(pattern).withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "complete", base: str | None = None) -> DataFrame:
    """What a stream gives for all that is there now, as a table.

    A batch has a folder of its own, which it overwrites: one that runs again after a crash is there once. In mode
    "complete" each batch is the whole result, and the last one counts. With a base folder of an earlier call the stream
    goes on from its state, and all that has come out so far is given.
    """
    spark = stream.sparkSession
    base = base or folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out" if mode == "complete" else f"{base}/out/*")


def windowed(stream: DataFrame, keys: list[str], length: str, slide: str | None = None) -> DataFrame:
    """keys, window_start, n, total of tumbling or sliding windows."""
    window = F.window("at", length, slide) if slide else F.window("at", length)
    rows = stream.withWatermark("at", "1 day").groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(*keys, F.col("w.start").alias("window_start"), "n", "total")


def sessions(stream: DataFrame, keys: list[str], gap: str) -> DataFrame:
    rows = stream.withWatermark("at", "1 day").groupBy(*keys, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("w.start").alias("session_start"), "n")


def rate_limited(stream: DataFrame, keys: list[str], length: str, burst: int) -> DataFrame:
    """keys, window_start, passed, suppressed: of each window's rows the first burst pass, and one summary says how many didn't."""
    n = stream.withWatermark("at", "1 day").groupBy(*keys, F.window("at", length).alias("w")).agg(F.count("*").alias("n"))
    return n.select(*keys, F.col("w.start").alias("window_start"), F.least("n", F.lit(burst)).alias("passed"), F.greatest(F.col("n") - burst, F.lit(0)).alias("suppressed"))


def moves(legal: dict[str, set[str]]) -> Callable:
    """A step that walks a state machine over roles: a move that isn't legal is counted, and made all the same."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        was, illegal = state[0] if state else "start", 0
        for role in rows["role"]:
            illegal += role not in legal.get(was, ())
            was = role
        return pd.DataFrame({"illegal": [illegal]}), (was,)

    return step


def late(delay: int, number: str = "event_id") -> Callable:
    """A step over rows in order of arrival: late are those whose time t lies more than a delay before the largest seen, which others may wait for."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        before = rows["t"].cummax().shift()
        if state:
            before = before.fillna(state[0]).clip(lower=state[0])
        out = pd.DataFrame({number: rows[number], "late": (rows["t"] < before - delay).to_numpy(bool)})
        return out, (int(max(rows["t"].max(), state[0] if state else rows["t"].max())),)

    return step


def exported(used: DataFrame, last: str, now: int, version: str) -> DataFrame:
    """used with document: its state as JSON, with ages before now instead of times, the clock's rate and the format's version."""
    rest = [c for c in used.columns if c != last]
    return used.select(*rest, F.to_json(F.struct(F.lit(version).alias("version"), F.lit(1_000_000).alias("rate"), (F.lit(now) - F.col(last)).alias("age"), *rest)).alias("document"))


def imported(documents: DataFrame, column: str, now: int, rate: int, major: int) -> DataFrame:
    """documents with last (on a clock of another rate, halves up) and accepted: whether the version's major number is ours; else last is null."""
    doc = F.from_json(column, "version string, rate long, age long")
    rows = documents.withColumn("doc__", doc)
    accepted = F.coalesce(F.split_part("doc__.version", F.lit("."), F.lit(1)) == str(major), F.lit(False))
    age = F.floor((2 * F.col("doc__.age") * rate + F.col("doc__.rate")) / (2 * F.col("doc__.rate")))
    return rows.withColumns({"accepted": accepted, "last": F.when(accepted, F.lit(now) - age)}).drop("doc__")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's rows as they arrive."""
    pattern = re.sub(r"(\w)(\.parquet)$", r"[\1]\2", path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def stateful(stream: DataFrame, key: str, step: Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]], out: str, state: str, order: tuple[str, ...] = ("at", "event_id")) -> DataFrame:
    """A step over each key's new rows in order (of time), from the state that the key's last step left.

    A key's rows of one batch are in memory together; a stream of files bounds them by maxFilesPerTrigger.
    """

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs)).sort_values(list(order), ignore_index=True)
        result, after = step(rows, held.get if held.exists else None)
        held.update(after)
        yield result.assign(**{key: k[0]})[[c.split()[0] for c in out.split(", ")]]

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def hysteresis(rows: pd.DataFrame, state: tuple | None, hours: float = 1) -> tuple[pd.DataFrame, tuple]:
    """Degraded from three errors within so many hours, until as many have passed without one."""
    active, recent = bool(state[0]) if state else False, [pd.Timestamp(x, unit="us") for x in (state[1] if state else [])]
    span, out = pd.Timedelta(hours=hours), []
    for at, kind, event in zip(rows["at"], rows["event_type"], rows["event_id"], strict=True):
        recent = [x for x in recent if at - x < span]
        held = active and bool(recent)
        if kind == "error":
            recent.append(at)
        was, active = active, held or len(recent) >= 3
        if active != was:
            out.append((event, "degraded" if active else "running"))
    return pd.DataFrame(out, columns=["event_id", "state"]), (active, [x.value // 1000 for x in recent])


def correction(rows: pd.DataFrame, state: tuple | None, target: float = 250.0) -> tuple[pd.DataFrame, tuple]:
    """A slow integrator towards a target: deadband, limited slew, limited range, and half the speed while it swings."""
    value, sign, swings, out = *(state or (0.0, 0, 0)), []
    for x, event in zip(rows["value"], rows["event_id"], strict=True):
        off = target - (x + value)
        if abs(off) > 10:
            now = 1 if off > 0 else -1
            swings = swings + 1 if sign and now != sign else max(0, swings - 1)
            sign = now
            move = 0.02 * off * (0.5 if swings > 2 else 1.0)
            value = min(60.0, max(-60.0, value + min(1.0, max(-1.0, move))))
        out.append((event, round(value, 6)))
    return pd.DataFrame(out, columns=["event_id", "trim"]), (value, sign, swings)
