"""Where queries and their SQL are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Events as half-open intervals of value seconds on a microsecond clock.
SPANS = "spans AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t0, epoch_us(ts) + round(value * 1000000)::BIGINT AS t1 FROM events)"


def spans(t: Tables) -> DataFrame:
    from pyspark.sql import functions as F

    from parlance.operators.intervals import micros

    start = micros("ts")
    return t.events.select("event_id", "user_id", "event_type", "value", start.alias("t0"), (start + F.round(F.col("value") * 1000000).cast("long")).alias("t1"))


HOUR, DAY = 3_600_000_000, 86_400_000_000
