"""Streams with timers: against plain Python, cut into batches, restarted, and what their state holds."""

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parlance.streaming import stateful, timers

HOUR = 3_600_000
SCHEMA = "user long, t long, value double, number long, is_source boolean"


@pytest.fixture(scope="module")
def rows():
    """Events of four users over 20 days in order of time; user 9 falls silent after two days."""
    rng, out = random.Random(5), []
    for k in range(1_200):
        t = k * 20 * 24 * HOUR // 1_200 + rng.randrange(HOUR // 4)
        user = rng.choice([1, 2, 3, 9] if t < 48 * HOUR else [1, 2, 3])
        out.append((user, t, rng.choice([None, *[rng.gauss(0, 3) for _ in range(9)]]), k, rng.random() < 0.02))
    return out


def stored(folder, rows, name):
    columns = dict(zip(("user", "t", "value", "number", "is_source"), map(list, zip(*rows, strict=True)), strict=True))
    pq.write_table(pa.table(columns, pa.schema([("user", pa.int64()), ("t", pa.int64()), ("value", pa.float64()), ("number", pa.int64()), ("is_source", pa.bool_())])), folder / f"{name}.parquet")


def stream(spark, folder):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return raw.withColumn("at", F.timestamp_millis("t"))


def runs(spark, tmp_path, rows, name, make):
    """What a query gives over one file, and over four files with a restart after two; the folder of the second."""
    found = []
    for files, stops in ((1, (1,)), (4, (2, 4))):
        folder, base = tmp_path / f"{name}{files}", f"file://{tmp_path}/{name}-base{files}"
        folder.mkdir()
        cut, done = [len(rows) * k // files for k in range(files + 1)], 0
        for stop in stops:
            for k in range(done, stop):
                stored(folder, rows[cut[k] : cut[k + 1]], f"part{k}")
            done = stop
            got = stateful.drained(make(stream(spark, folder)), name, "append", base).collect()
        found.append(sorted(map(tuple, got), key=str))
    return *found, base


def test_snapshots(spark, tmp_path, rows):
    horizons, step = [2 * HOUR, 10 * HOUR, 100 * HOUR], 3 * HOUR
    one, four, base = runs(spark, tmp_path, rows, "snapshots", lambda s: timers.snapshots(s, "user", horizons, step, "1 hour"))
    now, want = max(r[1] for r in rows) - HOUR, []
    for user in (1, 2, 3, 9):
        own = [(t, x) for u, t, x, _, _ in rows if u == user and x is not None]
        for at in range(-(-min(t for t, _ in own) // step) * step, now + 1, step):
            row = []
            for h in horizons:
                values = [x * x for t, x in own if at - h < t <= at]
                row += [len(values), sum(values) / len(values) if values else None]
            if row[-2]:
                want.append((user, at, *row))
    close = lambda a, b: all(x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-12)) for x, y in zip(a, b, strict=True))
    want.sort(key=str)
    for got in (one, four):
        assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(want)]
        assert all(close(a, b) for a, b in zip(sorted(got), sorted(want), strict=True))
    held = spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "ring").load()
    left = held.select("key.key", F.explode("list_element").alias("v")) if "list_element" in held.columns and held.schema["list_element"].dataType.typeName() == "array" else held.select("key.key", F.col("list_element").alias("v"))
    # The silent user has no state, and the others none that no horizon of a later snapshot reaches.
    assert {r.key for r in left.collect()} == {1, 2, 3}
    assert min(r.v["t"] for r in left.collect()) > now - step - horizons[-1]


def test_snapshots_state_rows_and_order(spark, tmp_path):
    """A batch leaves one state row a key, however many values it has; a row before the next timer, but not too late, has its snapshots."""
    first = [(1, 100 * HOUR + k, 2.0, k, False) for k in range(50)]
    second = [(1, 80 * HOUR, 3.0, 50, False), (1, 101 * HOUR, 2.0, 51, False)]
    third = [(2, 200 * HOUR, 1.0, 52, False)]
    folder, base = tmp_path / "ordered", f"file://{tmp_path}/ordered-base"
    folder.mkdir()
    make = lambda: timers.snapshots(stream(spark, folder), "user", [6 * HOUR, 24 * HOUR], 12 * HOUR, "24 hours")
    for k, rows in enumerate((first, second)):
        stored(folder, rows, f"part{k}")
        stateful.drained(make(), "ordered", "append", base)
    held = spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "ring").load()
    assert held.count() == 2
    stored(folder, third, "part2")
    got = sorted(map(tuple, stateful.drained(make(), "ordered", "append", base).select("user", "at", "n0", "n1", "power1").collect()))
    assert got == [(1, 84 * HOUR, 1, 1, 9.0), (1, 96 * HOUR, 0, 1, 9.0), (1, 108 * HOUR, 0, 51, 4.0), (1, 120 * HOUR, 0, 51, 4.0)]


def test_postponed(spark, tmp_path, rows):
    one, four, _ = runs(spark, tmp_path, rows, "postponed", lambda s: timers.postponed(s, "user", HOUR, 10, "1 hour"))
    now, want = max(r[1] for r in rows) - HOUR, []
    for user, t, _, number, is_source in rows:
        if not is_source and t + 10 * HOUR <= now:
            first = min((s for u, s, _, _, source in rows if source and u == user and s >= t - 10 * HOUR), default=None)
            tries = None if first is None else max(0, -(-(first - t) // HOUR))
            want.append((user, number, *((tries, "started") if tries is not None and tries <= 10 else (10, "starved"))))
    assert one == four == sorted(want, key=str)
    assert {r[3] for r in want} == {"started", "starved"} and {r[2] for r in want} >= {0, 1, 5, 10}


def test_other_rows_move_the_clock(spark, tmp_path):
    """A request is due, and a snapshot, though only a row of another kind or without a value says that time has passed."""
    stored(tmp_path, [(1, HOUR, 2.0, 7, False), (1, 21 * HOUR, None, 8, None)], "part0")
    asked = stateful.drained(timers.postponed(stream(spark, tmp_path), "user", HOUR, 10, "1 hour"), "clock", "append").collect()
    assert [tuple(r) for r in asked] == [(1, 7, 10, "starved")]
    shots = stateful.drained(timers.snapshots(stream(spark, tmp_path), "user", [50 * HOUR], 6 * HOUR, "1 hour"), "clock", "append").collect()
    assert sorted(tuple(r) for r in shots) == [(1, 6 * HOUR * k, 1, 4.0) for k in (1, 2, 3)]
