"""Mixing sources to target weights: how many words each source gives, and which documents make them up.

Targets share the corpus's size among sources by weight and stop at a multiple of a source's own size; what that leaves
over is shared again by weight. A source first takes all its documents as often as they fit whole. The rest of its
target is a subset sum: documents are counted by exact length, each length gives its proportional share, and a bounded
knapsack over the counts that are left fills the remaining words. Which documents of a length are taken is drawn by a
seeded hash. Only counts by length meet in one place, never documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import shared

WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
#: The knapsack fills at most so many words; larger rests are first brought down length by length.
KNAPSACK = 1 << 15
#: Documents of one source and length are dealt to so many slots of the seeded hash, so that none of them meets in full.
SLOTS = 1024


def n_words(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to those and target (double): one row for each source, null last.

    A source stops at most * source_size; the level, a number of words for each unit of weight, that shares everything
    among the others is found by adding up sources in order of where they stop. This works on one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "k")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({"total": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every), "stopped": F.coalesce(F.sum("stop").over(before), F.lit(0.0)), "stopped_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    # With all sources before this one at their stops, the level for the rest; the first that stays under its stop sets it.
    rows = rows.withColumn("level", (F.col("total") - F.col("stopped")) / (F.col("all_weight") - F.col("stopped_weight")))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("stopped_weight").alias("w"), "level"))).over(every)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least("stop", F.col("level") * F.col("weight")), F.col("stop")).alias("target"))


def subset(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (ascending, positive) to take so that their sizes add up to near the budget, never over."""
    size, count = size.astype(object), count.astype(object)
    total = int((size * count).sum())
    if budget >= total:
        return count.astype(np.int64)
    take = count * budget // total
    rest = budget - int((size * take).sum())
    # Proportional shares round down by less than one document of each length; the longest make most of that up.
    for i in range(len(size) - 1, -1, -1):
        if rest <= KNAPSACK:
            break
        more = min(int(count[i] - take[i]), (rest - KNAPSACK) // int(size[i]) + 1, rest // int(size[i]))
        take[i] += more
        rest -= more * int(size[i])
    return (take + knapsack(size, count - take, rest)).astype(np.int64)


def knapsack(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """A bounded knapsack whose items weigh what they are worth: the best sum within the budget, by sets of reachable sums as bits.

    Counts are split into powers of two. It stops as soon as the whole budget is reachable.
    """
    take = np.zeros(len(size), object)
    mask, reach = (1 << (budget + 1)) - 1, 1
    steps = []
    for i in range(len(size)):
        left = min(int(count[i]), budget // int(size[i]))
        step = 1
        while left > 0:
            step = min(step, left)
            fresh = (reach | reach << (step * int(size[i]))) & mask
            if fresh != reach:
                steps.append((i, step, reach))
                reach = fresh
            left -= step
            step *= 2
        if reach >> budget & 1:
            break
    best = reach.bit_length() - 1
    for i, step, before in reversed(steps):
        if not before >> best & 1:
            take[i] += step
            best -= step * int(size[i])
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """A source's counts by length to how often all are taken and how many once more."""
    pdf = pdf.sort_values("size", ignore_index=True)
    whole = int(pdf["source_size"].iloc[0])
    target = int(round(pdf["target"].iloc[0]))
    times = min(target // whole, MOST) if whole else 0
    rest = target - times * whole
    more = np.zeros(len(pdf), np.int64)
    some = (pdf["size"] > 0).to_numpy()
    if rest > 0 and times < MOST and some.any():
        more[some] = subset(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], rest)
    return pdf.assign(times=np.int64(times), more=more)[["key", "size", "times", "more"]]


def mix(docs: DataFrame, seed: int = 42, doc: str = "doc_id", column: str = "text", source: str = "source") -> DataFrame:
    """docs with size__, source_size__, target__ and times__: how often the mix takes the row (0 to MOST).

    Where a column of docs ends in two underscores, these have more; see shared.namer().

    Null texts have size 0; rows of size 0 are never taken. A null source is a source of its own, last in order. Equal
    rows are rows of their own; which of them is taken makes no difference, and reruns agree. Columns keep their names;
    an empty table gives an empty result.
    """
    n = shared.namer(docs.columns)
    base = docs.select(*(F.col(f"`{c}`") for c in docs.columns), n_words(F.col(column)).alias(n("size")))
    # Null can't be a join key: sources are told apart by a key that has none.
    base = base.withColumn(n("key"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null")))
    # With the text in it, rows without a doc_id, or of one doc_id, are dealt to all slots too.
    base = base.withColumn(n("draw"), F.xxhash64(F.lit(seed), F.col(doc), n("size"), F.col(column)))
    base = base.withColumn(n("slot"), F.shiftrightunsigned(n("draw"), 54).cast("int"))
    slots = base.groupBy(F.col(n("key")).alias("key"), F.col(source).alias("source"), F.col(n("size")).alias("size"), F.col(n("slot")).alias("slot")).agg(F.count("*").alias("n"))
    slots = shared.table(slots, "slots")
    lengths = slots.groupBy("key", "source", "size").agg(F.sum("n").alias("n"))
    sources = shared.table(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    sources = sources.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).drop("source")
    plan = shared.table(lengths.select("key", "size", "n").join(sources, "key").groupBy("key").applyInPandas(_plan, "key string, size long, times long, more long"), "plan")
    # Slots of a length fill up in order; a slot is taken in full, in part or not at all.
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    cuts = slots.join(plan.hint("merge"), ["key", "size"]).withColumn("before", F.coalesce(before, F.lit(0)))
    cuts = cuts.withColumn("extra", F.least(F.greatest(F.col("more") - F.col("before"), F.lit(0)), "n")).join(sources, "key")
    cuts = cuts.select(F.col("key").alias(n("key")), F.col("size").alias(n("size")), F.col("slot").alias(n("slot")), F.col("times").alias(n("all")), F.col("extra").alias(n("extra")), F.col("n").alias(n("n")), F.col("source_size").alias(n("source_size")), F.col("target").alias(n("target")))
    # Merged, never broadcast: there are as many slots as there are documents, up to SLOTS for each source and length; and
    # taken() needs rows by these keys anyway.
    return base.join(cuts.hint("merge"), [n("key"), n("size"), n("slot")])


def taken(docs: DataFrame, seed: int = 42, doc: str = "doc_id", column: str = "text", source: str = "source") -> DataFrame:
    """mix() with times__ settled: rows of a slot are ranked by the seeded hash, which decides where a slot is taken in part."""
    n = shared.namer(docs.columns)
    rows = mix(docs, seed, doc, column, source)
    # The rank's keys are those of mix()'s join, so texts are shuffled once.
    rank = F.row_number().over(Window.partitionBy(n("key"), n("size"), n("slot")).orderBy(n("draw"), F.col(doc)))
    rows = rows.withColumn(n("times"), F.col(n("all")) + F.when(rank <= F.col(n("extra")), 1).otherwise(0))
    return rows.select(*(F.col(f"`{c}`") for c in [*docs.columns, *map(n, ("size", "source_size", "target", "times"))]))


def mixture_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of it, repeats counted) of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    n = shared.namer(slim.columns)
    return taken(slim).select("doc_id", F.col(n("size")).alias("size"), F.col(n("source_size")).alias("source_size"), F.col(n("target")).alias("target"), (F.col(n("size")) * F.col(n("times"))).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs as the mix has them: rows that it takes, as often as it takes them."""
    n = shared.namer(docs.columns)
    rows = taken(docs, seed).where(F.col(n("times")) > 0)
    return rows.withColumn(n("copy"), F.explode(F.sequence(F.lit(1), F.col(n("times"))))).select(*(F.col(f"`{c}`") for c in docs.columns))
