"""Versioned tables: a new generation is written beside the old ones, then a numbered manifest points to it.

A manifest is written under another name and renamed to a number that nobody has: the rename makes it visible whole or
not at all, and the highest number counts. So a reader always finds a whole manifest, also if a writer stops halfway; of
two writers at once, the second takes the next number.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What stands between a version's name and its folder's own.
_MARK = "@"


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def digest(df: DataFrame, columns: list[str]) -> str:
    """A version that depends on a table's rows and not on their order: 16 hex digits of a hash of the sorted row hashes.

    Row hashes are added up in two ways before the last step, so nothing is collected or sorted.
    """
    h = df.select(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g"))
    row = h.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("g").alias("x"))
    return row.select(F.substring(F.sha2(F.concat_ws("|", "n", "s", "x"), 256), 1, 16)).first()[0]


def commit(spark: SparkSession, folder: str, version: str, tables: dict[str, DataFrame]) -> None:
    """Writes all tables of a version into a fresh folder, then its manifest; readers see the old version until then.

    A version's name can be used again, also while it is current: its new tables stand beside the old ones.
    """
    place = f"{version}{_MARK}{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{place}/{name}")
    path, fs = _fs(spark, folder)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(path, f".manifest-{version}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps({"version": version, "folder": place, "tables": sorted(tables)}).encode()))
    out.close()
    number = max(_manifests(spark, folder), default=0) + 1
    while not fs.rename(fresh, spark._jvm.org.apache.hadoop.fs.Path(path, _name(number))):
        number += 1


def _name(number: int) -> str:
    return f"manifest-{number:012d}.json"


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    path, fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return [int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d{12})\.json", n))]


def _manifest(spark: SparkSession, folder: str) -> dict:
    newest = max(_manifests(spark, folder), default=None)
    if newest is None:
        raise FileNotFoundError(f"{folder} has no manifest")
    return spark.read.option("multiLine", True).schema("version string, folder string").json(f"{folder}/{_name(newest)}").first().asDict()


def current(spark: SparkSession, folder: str) -> str:
    return _manifest(spark, folder)["version"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{_manifest(spark, folder)['folder']}/{name}")


def purge(spark: SparkSession, folder: str, pinned: set[str] = frozenset()) -> list[str]:
    """Deletes generations that are neither current nor of a pinned version, and manifests before the newest; gives their versions."""
    path, fs = _fs(spark, folder)
    for number in sorted(_manifests(spark, folder))[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, _name(number)), False)
    live, gone = _manifest(spark, folder)["folder"], []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        version = name.rpartition(_MARK)[0]
        if status.isDirectory() and name != live and version not in pinned:
            fs.delete(status.getPath(), True)
            gone.append(version)
    return sorted(gone)
