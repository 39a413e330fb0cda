"""Streams whose state has timers: snapshots over several horizons, and requests that wait for their source.

State is kept by Spark's state store, in list states that hold only what a later timer can still ask for. A timer of event
time fires once the watermark has passed it, so what comes out doesn't depend on how rows were cut into batches, as long as
none is later than the watermark allows. A batch that runs again after a crash begins from the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Timers and list states need this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Horizons(StatefulProcessor):
    """At every multiple of a step, for each horizon: how many of a key's values lie in it, and the level of their mean square.

    The state has a row for each batch with rows of the key: their first time, and their times and values as arrays. A row
    for each value would go to the state store and back one by one.
    """

    def __init__(self, horizons: list[int], step: int):
        self.horizons, self.step = horizons, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "t long, times binary, x binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        t, x = [], []
        for part in rows:
            t.append(part["t"].to_numpy(np.int64))
            x.append(part["value"].to_numpy(np.float64))
        t, x = np.concatenate(t), np.concatenate(x)
        self.ring.appendValue((int(t.min()), t.tobytes(), x.tobytes()))
        due, timers = -(-int(t.min()) // self.step) * self.step, [int(at) for at in self.handle.listTimers()]
        if timers and due < min(timers):
            self.handle.deleteTimer(min(timers))
        if not timers or due < min(timers):
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = list(self.ring.get())
        t, x = (np.frombuffer(b"".join(bytes(r[k]) for r in held), kind) for k, kind in ((1, np.int64), (2, np.float64)))
        order = np.argsort(t, kind="stable")
        t, x = t[order], x[order]
        at, now, longest = int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs()), self.horizons[-1]
        steps = np.arange(at, min(now, int(t[-1]) + longest - 1) + 1, self.step)
        # A place more, as an empty horizon at the end begins there.
        squares, upto = np.append(x * x, 0.0), np.searchsorted(t, steps, "right")
        out = {"key": np.full(len(steps), key[0]), "at": steps}
        for k, h in enumerate(self.horizons):
            since = np.searchsorted(t, steps - h, "right")
            n = upto - since
            total = np.add.reduceat(squares, np.column_stack((since, upto)).ravel())[::2] if len(steps) else np.zeros(0)
            out |= {f"n{k}": n, f"power{k}": np.where(n > 0, total / np.maximum(n, 1), np.nan)}
        at += len(steps) * self.step
        # Those that stay are at the end.
        first = int(np.searchsorted(t, at - longest, "right"))
        if first < len(t):
            self.ring.put([(int(t[first]), t[first:].tobytes(), x[first:].tobytes())])
            # Nothing happens before the first of them is in a horizon.
            self.handle.registerTimer(max(at, -(-int(t[first]) // self.step) * self.step))
        else:
            self.ring.clear()
        some = n > 0
        if some.any():
            yield pd.DataFrame({c: v[some] for c, v in out.items()})

    def close(self) -> None:
        pass


def snapshots(stream: DataFrame, key: str, horizons: list[int], step: int, delay: str) -> DataFrame:
    """key, at, n0, power0, n1, power1, ...: at every multiple of step (ms) that the watermark has passed, for each horizon
    (ms, ascending) how many of the key's rows lie in (at - horizon, at], and the mean square of their values.

    The stream has the key (a number), at (a timestamp), t (its ms) and value. No row comes out where the longest horizon is
    empty, and then the key has no state. Rows later than the delay are dropped. Null values and times are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    run = Horizons(horizons, step)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("at", T.LongType())])
    for k in range(len(horizons)):
        schema = schema.add(f"n{k}", T.LongType()).add(f"power{k}", T.DoubleType())
    # Names the time, or the filter would be moved before the watermark: rows without a value move the clock, too.
    counts = F.when(F.col("at").isNotNull(), F.col("t").isNotNull() & F.col("value").isNotNull())
    rows = stream.withWatermark("at", delay).where(counts).select(F.col(key).cast("long").alias("key"), "at", "t", F.col("value").cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(run, schema, "append", "EventTime").withColumnRenamed("key", key)


class Postponed(StatefulProcessor):
    """Requests wait for a row that says their source is ready; each is looked at again every step, and given up after so many."""

    def __init__(self, step: int, most: int):
        self.step, self.most = step, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, number long")
        self.ready = handle.getListState("ready", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        fresh = pd.concat(list(rows))
        asked = fresh[~fresh["is_source"]]
        if len(asked):
            self.waiting.appendList(list(zip(asked["t"].tolist(), asked["number"].tolist(), strict=True)))
        sources = fresh.loc[fresh["is_source"], "t"]
        if len(sources):
            self.ready.appendList([(t,) for t in sources.tolist()])
        due = int(fresh["t"].min()) + self.most * self.step
        timers = [int(t) for t in self.handle.listTimers()]
        if not timers:
            self.handle.registerTimer(due)
        elif due < min(timers):
            self.handle.deleteTimer(min(timers))
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, wait = int(timerValues.getCurrentWatermarkInMs()), self.most * self.step
        asked = sorted(tuple(r) for r in self.waiting.get())
        ready = np.sort(np.array([r[0] for r in self.ready.get()], np.int64))
        out, left = [], []
        for t, number in asked:
            if t + wait > now:
                left.append((t, number))
                continue
            # The first source at or after the request's own period of grace.
            k = np.searchsorted(ready, t - wait)
            first = int(ready[k]) if k < len(ready) else None
            tries = None if first is None else max(0, -(-(first - t) // self.step))
            started = tries is not None and tries <= self.most
            out.append((*key, number, tries if started else self.most, "started" if started else "starved"))
        # A source counts for requests up to the wait after it; requests still to come are after the watermark.
        oldest = min([t for t, _ in left], default=now) - wait
        stay = [(int(t),) for t in ready.tolist() if t >= min(oldest, now - wait)]
        for state, rows in ((self.waiting, left), (self.ready, stay)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        times = [t + wait for t, _ in left] + [t + 2 * wait for (t,) in stay]
        if times:
            self.handle.registerTimer(max(min(times), now + 1))
        yield pd.DataFrame(out, columns=["key", "number", "postponed", "outcome"])

    def close(self) -> None:
        pass


def postponed(stream: DataFrame, key: str, step: int, most: int, delay: str) -> DataFrame:
    """key, number, postponed, outcome of each request (a row whose is_source is false): started once a row of the key with
    is_source is there, at most a wait of most steps (ms) before it or after it, looked for again every step; else starved.

    The stream has the key (a number), at (a timestamp), t (its ms), number and is_source. A request comes out once the
    watermark has passed its last step, and just once. Rows later than the delay are dropped; null times are left out.
    Rows whose is_source is null only move the clock: a stream that is filtered before would be behind it.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # Names the time, or the filter would be moved before the watermark.
    counts = F.when(F.col("at").isNotNull(), F.col("t").isNotNull() & F.col("is_source").isNotNull())
    rows = stream.withWatermark("at", delay).where(counts).select(F.col(key).cast("long").alias("key"), "at", "t", F.col("number").cast("long").alias("number"), "is_source")
    schema = "key long, number long, postponed int, outcome string"
    return rows.groupBy("key").transformWithStateInPandas(Postponed(step, most), schema, "append", "EventTime").withColumnRenamed("key", key)
