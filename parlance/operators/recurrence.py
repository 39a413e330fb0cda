"""Linear recurrences over long series, exactly and in parallel.

A recurrence s' = A s + B x with y = C s + D x makes of any stretch of rows an affine map of the state before it: of n rows,
s -> A^n s + b, where b is what the stretch leaves behind by itself. So each stretch gives one row (n, b); these maps are
composed over groups of stretches, over each key's groups, and back, which gives each stretch its true state; and then
every stretch runs from there. No task has a whole key, and nothing is cut off, however far back it lies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators import spread
from parlance.operators.kept import kept

#: Rows of a stretch, stretches of a group, and stretches that run side by side.
STRETCH, GROUP, SIDE = 1_024, 4_096, 256


@dataclass(frozen=True)
class Linear:
    """s' = a s + b x, y = c s + d x; a key's first state is first * its first value."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    first: np.ndarray

    def then(self, other: Linear) -> Linear:
        """The recurrence whose y goes through another one."""
        m, n = len(self.b), len(other.b)
        a = np.block([[self.a, np.zeros((m, n))], [np.outer(other.b, self.c), other.a]])
        # Both begin in rest, or with what the first value gives.
        first = np.r_[self.first, other.first * (self.c @ self.first + self.d)]
        return Linear(a, np.r_[self.b, other.b * self.d], np.r_[other.d * self.c, other.c], other.d * self.d, first)

    def run(self, series: list[np.ndarray], states: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Each series' y from its state, and the states behind them; all series take their steps side by side."""
        sizes = np.array([*map(len, series)])
        longest = int(sizes.max(initial=0))
        x = np.zeros((longest, len(series)))
        for k, own in enumerate(series):
            x[: len(own), k] = own
        y, states, ends, last = np.empty_like(x), states.copy(), states.copy(), set((sizes - 1).tolist())
        for k in range(longest):
            y[k] = states @ self.c + self.d * x[k]
            states = states @ self.a.T + np.outer(x[k], self.b)
            if k in last:
                ends[sizes - 1 == k] = states[sizes - 1 == k]
        return [y[:n, k] for k, n in enumerate(sizes.tolist())], ends


def exponential(alpha: float) -> Linear:
    """y += alpha * (x - y), begun with the first value."""
    one = np.ones(1)
    return Linear(np.array([[1 - alpha]]), alpha * one, (1 - alpha) * one, alpha, one)


def biquad(b: tuple[float, float, float], a: tuple[float, float]) -> Linear:
    """y = b0 x + b1 x' + b2 x'' - a0 y' - a1 y'', from rest."""
    (b0, b1, b2), (a1, a2) = b, a
    return Linear(np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0]), b0, np.zeros(2))


def mapped(df: DataFrame, add: Callable[[pa.RecordBatch], list[pa.Array]], schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with columns (schema) that a function of a batch gives, SIDE rows at a time; without those to drop."""
    kept = [c for c in df.columns if c not in drop]
    out = T.StructType([*df.select(*kept).schema.fields, *T.StructType.fromDDL(schema).fields])

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, SIDE):
                part = batch.slice(s, SIDE)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *add(part)], names=out.names)

    return df.mapInArrow(run, out)


def _values(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("x__")
    cuts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _composed(system: Linear, maps: list[dict], state: np.ndarray) -> list[np.ndarray]:
    """The states before each of some maps in a row, and behind the last."""
    powers: dict[int, np.ndarray] = {}
    out = [state]
    for m in maps:
        n = m["n__"]
        if n not in powers:
            powers[n] = np.linalg.matrix_power(system.a, n)
        out.append(powers[n] @ out[-1] + np.array(m["b__"]))
    return out


_LISTS = pa.list_(pa.float64())


def scan(df: DataFrame, keys: list[str], order: list[str], value: str, system: Linear, at: Column, width: int, name: str = "y", place: str | None = None) -> DataFrame:
    """df's keys and order with the recurrence's y, as doubles, under a name (and, under another one, a row's place from 1). at and width: see spread.numbered().

    The order must not tie within a key (rows that tie have no defined place). A null value counts as 0, a null key is a
    key of its own; NaN and infinities go on to all later rows, as in the recurrence. An empty table gives an empty result.
    """
    rows = spread.numbered(df.select(*keys, *order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x__")), keys, order, at, width, "n__")
    cell = rows.select(*keys, F.floor((F.col("n__") - 1) / STRETCH).cast("long").alias("stretch__"), F.struct("n__", *order, "x__").alias("v__"))
    cells = kept(cell.groupBy(*keys, "stretch__").agg(F.array_sort(F.collect_list("v__")).alias("v__")))
    stretches = cells.withColumn("x__", F.transform("v__", lambda v: v["x__"]))
    start = lambda x, is_first: np.array([system.first * own[0] if f else np.zeros(len(system.b)) for own, f in zip(x, is_first, strict=True)])

    def left_behind(batch):
        x = _values(batch)
        _, ends = system.run(x, start(x, batch.column("stretch__").to_numpy() == 0))
        return [pa.array([len(own) for own in x], pa.int64()), pa.array(ends.tolist(), _LISTS)]

    maps = mapped(stretches.select(*keys, "stretch__", "x__"), left_behind, "n__ long, b__ array<double>", ("x__",))
    groups = maps.groupBy(*keys, F.floor(F.col("stretch__") / GROUP).alias("group__")).agg(F.array_sort(F.collect_list(F.struct("stretch__", "n__", "b__"))).alias("maps__"))

    def one_map(batch):
        own = batch.column("maps__").to_pylist()
        ends = [_composed(system, m, np.zeros(len(system.b)))[-1].tolist() for m in own]
        return [pa.array([sum(m["n__"] for m in x) for x in own], pa.int64()), pa.array(ends, _LISTS)]

    def before_each(batch):
        first = batch.column("state__").to_pylist() if "state__" in batch.schema.names else [[0.0] * len(system.b)] * batch.num_rows
        found = [_composed(system, m, np.array(s))[:-1] for m, s in zip(batch.column("maps__").to_pylist(), first, strict=True)]
        return [pa.array([[s.tolist() for s in x] for x in found], pa.list_(_LISTS))]

    above = mapped(groups, one_map, "n__ long, b__ array<double>", ("maps__",))
    above = above.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("group__", "n__", "b__"))).alias("maps__"))
    states = "states__ array<array<double>>"
    each = lambda df, place: df.select(*keys, F.explode(F.arrays_zip(F.col(f"maps__.{place}").alias("p"), F.col("states__").alias("s"))).alias("e")).select(*keys, F.col("e.p").alias(place), F.col("e.s").alias("state__"))
    of_groups = each(mapped(above, before_each, states), "group__")
    of_stretches = each(mapped(spread.joined(groups, of_groups, [*keys, "group__"]), before_each, states), "stretch__")

    def through(batch):
        x, s = _values(batch), batch.column("state__").to_pylist()
        first = batch.column("stretch__").to_numpy() == 0
        y, _ = system.run(x, np.where(first[:, None], start(x, first), np.array(s)))
        return [pa.array([own.tolist() for own in y], _LISTS)]

    ran = mapped(spread.joined(stretches, of_stretches, [*keys, "stretch__"]), through, "y__ array<double>", ("x__", "state__"))
    out = ran.select(*keys, F.explode(F.arrays_zip("v__", "y__")).alias("e"))
    return out.select(*keys, *(F.col(f"e.v__.{c}").alias(c) for c in order), F.col("e.y__").alias(name), *([F.col("e.v__.n__").alias(place)] if place else []))
