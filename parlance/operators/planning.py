"""Talker pools, shuffle cycles, event plans, replanning, layouts and bus power.

Recurrences of plans (a start waits for the one before, a slot for its last phrase) are running maxima over stretches of
the clock; draws are hashes of a seed and a name, so results depend on neither order nor partitions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import intervals, spread, stats
from parlance.operators.kept import kept


def generator(seed: int, *name: object) -> np.random.Generator:
    """A random stream of its own for each seed and name: results depend on neither order nor partitions."""
    digest = hashlib.sha256("/".join(map(str, (seed, *name))).encode()).digest()
    return np.random.Generator(np.random.Philox(int.from_bytes(digest[:8], "little")))


def draw(seed: int, *parts: Column) -> Column:
    """A text to order by: a random one for each seed and parts, the same in every system that has MD5."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def scenarios(texts: DataFrame, column: str) -> DataFrame:
    """Scenario documents (JSON) to name, voices, mean, seconds with defaults filled in, and valid: whether all ranges hold.

    A text that isn't a JSON object has no name and isn't valid.
    """
    doc = F.from_json(column, "name string, voices int, mean double, seconds double")
    rows = texts.select(*texts.columns, doc.alias("doc__"))
    rows = rows.select(*texts.columns, "doc__.name", F.coalesce("doc__.voices", F.lit(8)).alias("voices"), F.coalesce("doc__.mean", F.lit(2.0)).alias("mean"), F.coalesce("doc__.seconds", F.lit(60.0)).alias("seconds"))
    return rows.withColumn("valid", F.col("name").isNotNull() & (F.col("voices") >= 1) & F.col("mean").between(0.5, F.col("voices")) & F.col("seconds").between(1, 3600))


def balanced_pool(speakers: DataFrame, keys: list[str], value: str, number: str, size: int, seed: int) -> DataFrame:
    """size members of each group, a quarter from each quartile of the value, drawn by a seeded hash.

    What doesn't divide goes to quartiles 1, 2, 0, 3 in turn; what a quartile lacks comes from all that are left.
    """
    rows = stats.quartiles(speakers.select(*keys, value, number), keys, value, number).withColumn("quartile", F.col("quartile").cast("int")).withColumn("draw__", draw(seed, F.col(number)))
    # A member beyond the first size of its quartile's draw is never picked, so only these few meet.
    place = F.row_number().over(Window.partitionBy(*keys, "quartile").orderBy("draw__", number))
    rows = rows.withColumn("place__", place).where(F.col("place__") <= size)
    quota = F.lit(size // 4) + F.when(F.element_at(F.array(*(F.lit(k) for k in (3, 1, 2, 4))), F.col("quartile") + 1) <= size % 4, 1).otherwise(0)
    rows = rows.withColumn("spare__", F.when(F.col("place__") <= quota, 0).otherwise(1))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("spare__", "draw__", number))
    return rows.withColumn("rank__", rank).where(F.col("rank__") <= size).drop("rank__", "place__", "draw__", "spare__")


def spread_pool(vectors: DataFrame, keys: list[str], number: str, vector: str, size: int, seed: int) -> DataFrame:
    """keys, pick, number: a first member by chance, then in each round one of the three farthest from all before.

    A round is a broadcast of each group's last pick, a new least distance of each row and the first three of each group,
    so no task has a whole group.
    """
    rows = vectors.select(*keys, F.to_json(F.struct(*keys)).alias("g__"), number, F.transform(vector, lambda x: x.cast("double")).alias("v__"))
    groups = rows.groupBy("g__").agg(*(F.first(k).alias(k) for k in keys), F.count("*").alias("n__"))

    def draw(parts):
        for pdf in parts:
            out = []
            for g, names, n in zip(pdf["g__"], pdf["names__"], pdf["n__"], strict=True):
                rng = generator(seed, "spread", *names)
                out.append((g, 0, int(rng.integers(n))))
                out += [(g, r, int(rng.choice(min(3, n - r)))) for r in range(1, min(size, n))]
            yield pd.DataFrame(out, columns=["g__", "pick", "draw__"])

    names = F.array(*(F.col(k).cast("string") for k in keys)).alias("names__")
    drawn = kept(groups.select("g__", names, "n__").mapInPandas(draw, "g__ string, pick int, draw__ long"))
    place = spread.numbered(rows.select("g__", number), ["g__"], [number], F.col(number), 1 << 16, "place__")
    first = place.join(F.broadcast(drawn.where("pick = 0")), "g__").where("place__ = draw__ + 1").select("g__", number, "pick")
    last = kept(rows.join(F.broadcast(first), ["g__", number]).select("g__", number, "pick", "v__"))
    picks, left = last, rows.select("g__", number, "v__", F.lit(float("inf")).alias("far__"))
    for r in range(1, size):
        before = last.select("g__", F.col(number).alias("last__"), F.col("v__").alias("p__"))
        squares = F.zip_with("v__", "p__", lambda x, y: (x - y) * (x - y))
        far = F.least("far__", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))
        left = kept(left.join(F.broadcast(before), "g__").select("g__", number, "v__", F.when(F.col(number) == F.col("last__"), -1.0).otherwise(far).alias("far__")))
        rank = F.row_number().over(Window.partitionBy("g__").orderBy(F.desc("far__"), number))
        best = left.where("far__ >= 0").select("g__", number, "far__").withColumn("rank__", rank).where("rank__ <= 3")
        chosen = best.join(F.broadcast(drawn.where(F.col("pick") == r)), "g__").where("rank__ = draw__ + 1").select("g__", number, "pick")
        last = kept(left.join(F.broadcast(chosen), ["g__", number]).select("g__", number, "pick", "v__"))
        picks = picks.unionByName(last)
    return picks.join(groups, "g__").select(*keys, "pick", F.col(number).cast("long").alias("number"))


def matched_pool(speakers: DataFrame, keys: list[str], number: str, value: str, size: int) -> DataFrame:
    """keys, pick, number: for each of size even quantiles of the values, the nearest member not yet taken (ties: smaller value, then number).

    Fewer than size members are taken before any quantile's turn, so its size nearest are enough: only these few meet.
    """
    wanted = stats.quantiles(speakers, keys, value, number, {f"q{k}__": (k + 0.5) / size for k in range(size)})
    targets = F.posexplode(F.array(*(f"q{k}__" for k in range(size)))).alias("pick", "q__")
    near = speakers.select(*keys, number, value).join(wanted.select(*keys, targets), keys).withColumn("far__", F.abs(F.col(value) - F.col("q__")))
    rank = F.row_number().over(Window.partitionBy(*keys, "pick").orderBy("far__", value, number))
    near = near.withColumn("rank__", rank).where(F.col("rank__") <= size)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        for _, part in pdf.sort_values(["pick", "rank__"]).groupby("pick"):
            free = [n for n in part[number] if n not in taken]
            taken += free[:1]
        return pd.DataFrame({**{k: [x] * len(taken) for k, x in zip(keys, key, strict=True)}, "pick": range(len(taken)), "number": taken})

    kinds = ", ".join(f"{k} {speakers.schema[k].dataType.simpleString()}" for k in keys)
    return near.select(*keys, "pick", "rank__", number).groupBy(*keys).applyInPandas(run, f"{kinds}, pick int, number long")


def shuffle_cycles(members: DataFrame, keys: list[str], number: str, cycles: int, seed: int) -> DataFrame:
    """keys, cycle, position, number: every member of a group once in each cycle, in random order; none of the last fifth of a cycle opens the next.

    The opener is the first of a cycle's draw that isn't in that fifth. It comes from the front, so it changes no cycle's
    last fifth (groups of over two members), and a cycle depends on the draws of the one before alone.
    """
    rows = members.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    by = Window.partitionBy(*keys, "cycle")
    rows = rows.withColumn("draw__", draw(seed, F.col("cycle"), F.col(number))).withColumns({"place__": F.row_number().over(by.orderBy("draw__", number)), "n__": F.count("*").over(by)})
    tail = rows.where(F.col("place__") > F.col("n__") - F.ceil(F.col("n__") / 5)).select(*keys, (F.col("cycle") + 1).alias("cycle"), number, F.lit(True).alias("tail__"))
    rows = rows.join(tail, [*keys, "cycle", number], "left").withColumn("tail__", F.coalesce("tail__", F.lit(False)))
    opener = F.min(F.when(~F.col("tail__"), F.col("place__"))).over(by)
    place = F.when(F.col("place__") == opener, 0).otherwise(F.col("place__"))
    return rows.withColumn("order__", place).select(*keys, "cycle", (F.row_number().over(by.orderBy("order__")) - 1).cast("long").alias("position"), number)


#: Microseconds: starts keep so far apart, phrases are at least and at most so long and end on a grid.
GUARD, SHORTEST, LONGEST, GRID = 40_000_000, 60_000_000, 480_000_000, 1_000_000


def phrases(rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows with length: that of the material, within bounds and on the grid."""
    return rows.withColumn("length", (F.floor(F.greatest(F.lit(SHORTEST), F.least(F.col(end) - F.col(start), F.lit(LONGEST))) / GRID) * GRID).cast("long"))


def plan(rows: DataFrame, keys: list[str], number: str, start: str, width: int) -> DataFrame:
    """phrases() with planned: where they start, in order, each the guard after the one before or later.

    s(n) = max(t(n), s(n - 1) + guard) is n * guard + max over m <= n of (t(m) - m * guard): a running maximum.
    """
    placed = spread.numbered(rows, keys, [start, number], F.col(start), width, "n__").withColumn("slack__", F.col(start) - F.col("n__") * GUARD)
    run = spread.running(spread.dealt(placed, F.col(start), width), keys, [start, number], "slack__", "most__", "max")
    return run.withColumn("planned", (F.col("most__") + F.col("n__") * GUARD).cast("long")).drop("n__", "slack__", "most__", "range__")


def plan_slots(rows: DataFrame, keys: list[str], number: str, start: str, slots: int, overlap: int, width: int) -> DataFrame:
    """phrases() with slot and planned: phrases go round a fixed number of slots, each starting when its slot's last one is about to end.

    s(n) = max(t(n), s(n - 1) + length(n - 1) - overlap) within a slot: with P the running sum of (length - overlap)
    before n, it is P(n) + max over m <= n of (t(m) - P(m)).
    """
    placed = spread.numbered(rows, keys, [start, number], F.col(start), width, "n__").withColumns({"slot": F.pmod(F.col("n__") - 1, F.lit(slots)).cast("long"), "step__": F.col("length") - overlap})
    by = [*keys, "slot"]
    run = spread.running(spread.dealt(placed, F.col(start), width), by, [start, number], "step__", "sum__", "sum", before=True)
    run = run.withColumn("slack__", F.col(start) - F.col("sum__"))
    run = spread.running(run, by, [start, number], "slack__", "most__", "max")
    return run.withColumn("planned", (F.col("most__") + F.col("sum__")).cast("long")).drop("n__", "step__", "sum__", "slack__", "most__", "range__")


def replan(old: DataFrame, fresh: DataFrame, number: str, at: int, freeze: int, fade: int) -> DataFrame:
    """Plans (planned, length) joined at a time: old's phrases that start before at + freeze are final (epoch 0), fresh's from there on follow (epoch 1).

    A final phrase that runs past the joint is handed over: cut there, after a fade whose length its number decides.
    """
    joint = at + freeze
    cut = F.lit(joint) + F.pmod(F.col(number), F.lit(4)) * fade
    kept = old.where(F.col("planned") < joint).withColumns({"epoch": F.lit(0), "length": F.least(F.col("length"), cut - F.col("planned"))})
    return kept.unionByName(fresh.where(F.col("planned") >= joint).withColumn("epoch", F.lit(1)))


def shortened(turns: DataFrame, keys: list[str], order: str, length, most: int) -> DataFrame:
    """Every turn cut to a length, with its start before and after: what is cut earlier moves the later ones up."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("length", length.cast("long")).withColumn("kept", F.least("length", F.lit(most)))
    return rows.withColumns({"source_start": F.coalesce(F.sum("length").over(by), F.lit(0)), "start": F.coalesce(F.sum("kept").over(by), F.lit(0))})


def bus_power(events: DataFrame, keys: list[str], start: str, end: str, level, width: int) -> DataFrame:
    """keys, bin, power: squared levels of running events, averaged over each bin of time."""
    parts = intervals.apportioned(events.withColumn("power__", level * level), start, end, width)
    return parts.groupBy(*keys, "bin").agg((F.sum(F.col("power__") * F.col("part")) / width).alias("power"))
