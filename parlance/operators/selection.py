"""What a selector asks of its material: eligibility, cooled intervals, weights, recent lists, relaxed picks; digests and checks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import intervals
from parlance.operators.planning import draw


def eligible_material(pieces: DataFrame, start: str, end: str, least: int, margin: int) -> DataFrame:
    """Pieces that are long enough for the shortest segment and a margin."""
    return pieces.where(F.col(end) - F.col(start) >= least + margin)


def not_cooled(anchors: DataFrame, cooled: DataFrame, keys: list[str], at: str, number: str, width: int) -> DataFrame:
    """Anchors that lie in none of their key's cooled intervals [start, end): an interval anti join by buckets of time."""
    hot = intervals.containing(anchors.select(*keys, at, number), cooled.select(*keys, "start", "end"), keys, at, width).select(number).distinct()
    return anchors.join(hot, number, "left_anti")


def weight(share: Column, age: Column | None, solo: Column, rest: Column, solo_weight: float) -> Column:
    """A speaker's weight: its share, its age since the last use (1 and more, 3 at most, 3 if never used), and the mix of its solo-risk material."""
    old = F.coalesce(F.least(1 + age, F.lit(3.0)), F.lit(3.0))
    return share * old * F.when(rest > 0, (solo * solo_weight + (rest - solo)) / rest).otherwise(1.0)


def recent(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """keys, recent: the last n values of each key, oldest first; all others are dropped before anything is collected."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    last = rows.withColumn("k__", F.row_number().over(newest)).where(F.col("k__") <= n)
    return last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k__")).alias("k"), F.col(value).alias("v")))), lambda x: x["v"]).alias("recent"))


def relaxed_pick(candidates: DataFrame, keys: list[str], number: str, weight_: str, recents: DataFrame, n: int, seed: int) -> DataFrame:
    """keys, stage, number: a weighted choice among those not among the last n; if there are none, the last n / 2; then any.

    The choice is the smallest -ln(u) / weight, where u is a hash of the seed and the names: each is picked with its
    weight's probability, and order and partitions don't matter.
    """
    rows = candidates.join(recents, keys, "left")
    back = F.size("recent") - F.array_position("recent", F.col(number))  # how many came after its last use
    used = F.array_contains("recent", F.col(number))
    stage = F.when(~F.coalesce(used, F.lit(False)), 0).when(back >= n // 2, 1).otherwise(2)
    u = (F.conv(F.substring(draw(seed, *(F.col(k) for k in keys), F.col(number)), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return rows.withColumns({"stage": stage, "draw__": -F.ln(u) / F.col(weight_)}).groupBy(*keys).agg(F.min_by(F.struct("stage", number), F.struct("stage", "draw__", number)).alias("p")).select(*keys, "p.stage", f"p.{number}")


def density(mean: Column, least: Column, most: Column, outputs: Column, zones: Column, cap: int) -> dict[str, Column]:
    """Counts of a zone's talkers scaled to all outputs, and brought under a cap: total_mean, total_min, total_max, effective, capped."""
    n, k = F.greatest(outputs, F.lit(0)), F.greatest(zones, F.lit(1))
    top, low = F.ceil(most * n / k - 1e-9), F.ceil(least * n / k - 1e-9)
    capped = top > cap
    f = F.when(capped, cap / top).otherwise(1.0)
    return {"total_mean": mean * n / k * f, "total_min": F.when(capped, F.floor(low * f)).otherwise(low).cast("long"), "total_max": F.least(top, F.lit(cap)).cast("long"), "effective": mean * f, "capped": capped}


def little_endian(x: Column) -> Column:
    """A long as the hex digits of its eight bytes, the lowest first."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8)))


def packed_digest(rows: DataFrame, keys: list[str], order: list[str], numbers: list[str]) -> DataFrame:
    """keys, digest: SHA-256 of a key's numbers, packed as 64-bit integers, row by row in order."""
    row = F.struct(*order, F.concat(*(little_endian(F.col(c).cast("long")) for c in numbers)).alias("bytes__"))
    return rows.groupBy(*keys).agg(F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["bytes__"]), "")), 256).alias("digest"))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n, digest of a table, whatever its order: row hashes are added up before the last step, so nothing is sorted or collected."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns))
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("s"))
    return sums.select("n", F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string")).cast("binary"), 256), 1, 16).alias("digest"))


def canonical(document: Column) -> Column:
    """A JSON text with keys in order and no white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(document))


def problems(rows: DataFrame) -> DataFrame:
    """planning.scenarios() with error: the first rule that a document breaks, null if none."""
    rules = [(F.col("name").isNull(), "no object with a name"), (F.col("voices") < 1, "voices under 1"), (~F.col("mean").between(0.5, F.col("voices")), "mean out of range"), (~F.col("seconds").between(1, 3600), "seconds out of range")]
    return rows.withColumn("error", F.coalesce(*(F.when(test, F.lit(text)) for test, text in rules)))
