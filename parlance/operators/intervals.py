"""Half-open intervals on an integer clock: islands, gaps, overlaps, containment, as-of lookups and concurrency.

Every operator works within keys, so rows are shuffled once by them. Range conditions become equi-joins on time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def islands(df: DataFrame, keys: list[str], min_gap: int, start: str = "start", end: str = "end") -> DataFrame:
    """keys, island (from 1), start, end, n: intervals merged while a start is less than min_gap after the running end."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = df.withColumn("opens__", F.when(reach.isNull() | (F.col(start) - reach >= min_gap), 1).otherwise(0))
    numbered = opens.withColumn("island", F.sum("opens__").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def gaps(merged: DataFrame, keys: list[str], boundary: int) -> DataFrame:
    """The free stretches between islands; boundary: whether one is that long."""
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    out = merged.withColumn("next__", after).where("next__ is not null")
    return out.select(*keys, F.col("end").alias("gap_start"), F.col("next__").alias("gap_end"), (F.col("next__") - F.col("end") >= boundary).alias("boundary"))


def concurrency(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, max_active, min_active, mean_active (weighted by time), from starts and ends alone."""
    deltas = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("x"))
    merged = deltas.groupBy(*keys, F.col("x.t").alias("t__")).agg(F.sum("x.d").alias("d__"))
    by = Window.partitionBy(*keys).orderBy("t__")
    steps = merged.withColumns({"on__": F.sum("d__").over(by), "span__": F.lead("t__").over(by) - F.col("t__")}).where("span__ is not null")
    return steps.groupBy(*keys).agg(F.max("on__").alias("max_active"), F.min("on__").alias("min_active"), (F.sum(F.col("on__") * F.col("span__")) / F.sum("span__")).alias("mean_active"))


def bucketed(df: DataFrame, start: str, end: str, width: int, name: str = "bucket__") -> DataFrame:
    """A row for each time bucket that [start, end) touches."""
    last = F.greatest(F.floor((F.col(end) - 1) / F.lit(width)), F.floor(F.col(start) / F.lit(width)))
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / F.lit(width)), last)))


def containing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """points joined to the spans with start <= at < end; spans are dealt to buckets of about their usual length."""
    p = points.withColumn("bucket__", F.floor(F.col(at) / F.lit(width)))
    s = bucketed(spans, start, end, width)
    return p.join(s, [*keys, "bucket__"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("bucket__")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int, a_cols: tuple[str, str], b_cols: tuple[str, str]) -> DataFrame:
    """Pairs of intervals that overlap, with overlap: each pair once, in the bucket where the overlap begins."""
    (a0, a1), (b0, b1) = a_cols, b_cols
    pairs = bucketed(a, a0, a1, width).join(bucketed(b, b0, b1, width), [*keys, "bucket__"])
    first = F.floor(F.greatest(a0, b0) / F.lit(width))
    pairs = pairs.where((F.greatest(a0, b0) < F.least(a1, b1)) & (F.col("bucket__") == first))
    return pairs.withColumn("overlap", F.least(a1, b1) - F.greatest(a0, b0)).drop("bucket__")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with found: the value of the last right row (at, value) of its keys at or before it; one shuffle, no range join."""
    both = left.withColumns({"side__": F.lit(1), "value__": F.lit(None).cast(right.schema[value].dataType)})
    both = both.unionByName(right.select(*keys, at, F.col(value).alias("value__"), F.lit(0).alias("side__")), allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy(at, "side__", "value__").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("value__", ignorenulls=True).over(by)).where("side__ = 1").drop("side__", "value__")


def apportioned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bin of an interval, with bin and the part of the interval in it."""
    rows = bucketed(df.where(F.col(end) > F.col(start)), start, end, width, "bin")
    return rows.withColumn("part", F.least(F.col(end), (F.col("bin") + 1) * width) - F.greatest(F.col(start), F.col("bin") * width))


def isolated(merged: DataFrame, keys: list[str], shorter: int, silence: int) -> DataFrame:
    """Short islands with a long silence on both sides; a missing neighbour is far away."""
    by = Window.partitionBy(*keys).orderBy("start")
    rows = merged.withColumns({"before__": F.col("start") - F.lag("end").over(by), "after__": F.lead("start").over(by) - F.col("end")})
    far = lambda c: F.col(c).isNull() | (F.col(c) >= silence)
    return rows.where((F.col("end") - F.col("start") < shorter) & far("before__") & far("after__")).select(*keys, "start", "end")


def longest_run(points: DataFrame, merged: DataFrame, keys: list[str], at: str, horizon: int) -> DataFrame:
    """The longest island in the horizon after each key's point, cut to the horizon."""
    both = points.join(merged, keys).where((F.col("start") < F.col(at) + horizon) & (F.col("end") > F.col(at)))
    return both.groupBy(*keys).agg(F.max(F.least(F.col("end"), F.col(at) + horizon) - F.greatest("start", at)).alias("longest"))


def anchors(merged: DataFrame, spans: DataFrame, keys: list[str], lead_in: int, remaining: int, window: int, speech: int) -> DataFrame:
    """Island starts after a long enough silence, with enough left and enough speech right after them."""
    by = Window.partitionBy(*keys).orderBy("start")
    rows = merged.select(*keys, F.col("start").alias("anchor"), (F.col("start") - F.coalesce(F.lag("end").over(by), F.lit(0))).alias("lead__"), (F.max("end").over(Window.partitionBy(*keys)) - F.col("start")).alias("remaining"))
    rows = rows.where((F.col("lead__") >= lead_in) & (F.col("remaining") >= remaining)).withColumn("until__", F.col("anchor") + window)
    found = overlapping(rows, spans.where("t0 < t1"), keys, window, ("anchor", "until__"), ("t0", "t1"))
    return found.groupBy(*keys, "anchor", "remaining").agg(F.sum("overlap").alias("speech")).where(F.col("speech") >= speech)
