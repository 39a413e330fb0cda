"""Order MinHash: fingerprints of whole texts that follow edit distance, and each text's likeness to another.

A text's k-mers of code points are numbered by occurrence (the second "abcd" isn't the first), and each numbered k-mer has
one random value. Component c selects the TUPLE k-mers whose values come first from c / COMPONENTS of the way round the
circle of values, puts them back into text order, and hashes their values as a tuple. One value serves all components: a
text of many k-mers has enough in each arc of the circle, and in one of few the arcs overlap, so that a component always
has TUPLE k-mers, if the text does. Two texts' likeness is the share of equal components (1 if both are empty). Moving a
passage changes the order within tuples, so it lowers the likeness, as it raises edit distance; plain MinHash would not
notice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import shared, text

#: Code points of a k-mer, components of a fingerprint, and k-mers of a tuple.
GRAM, COMPONENTS, TUPLE = 8, 64, 2
#: Up to so many bits of a hash make room for the place of its k-mer; more k-mers are sorted with their places apart.
PLACE_BITS = 16
_U64 = np.uint64
_ARCS = np.array([(c << 64) // COMPONENTS for c in range(COMPONENTS)], _U64)


def _order(h: np.ndarray) -> np.ndarray:
    """Places in order of their hashes, equal hashes in text order."""
    bits = int(len(h) - 1).bit_length()
    if bits > PLACE_BITS:
        return np.argsort(h, kind="stable")
    # The place goes into the low bits, so one sort without indices does; 48 bits at least tell hashes apart.
    low = (_U64(1) << _U64(bits)) - _U64(1)
    return (np.sort((h & ~low) | np.arange(len(h), dtype=_U64)) & low).astype(np.int64)


def _k_mers(code: np.ndarray) -> np.ndarray:
    """A hash of each k-mer of code points; fewer code points are one k-mer."""
    n = max(1, len(code) - GRAM + 1)
    grams = np.zeros(n, _U64)
    for j in range(min(GRAM, len(code))):
        grams = grams * _U64(0x9E3779B97F4A7C15) + code[j : j + n] + _U64(1)
    return text.mix(grams)


def fingerprint(s: str) -> np.ndarray:
    """A text's components. A text shorter than a k-mer is its own only k-mer; the empty one's components are 0."""
    code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U64)
    if not len(code):
        return np.zeros(COMPONENTS, _U64)
    grams = _k_mers(code)
    n = len(grams)
    place = _order(grams)
    bits = _U64(max(0, min(int(n - 1).bit_length(), PLACE_BITS)))
    gram = grams[place] >> bits if n <= 1 << PLACE_BITS else grams[place]
    fresh = np.r_[True, gram[1:] != gram[:-1]]
    index = np.arange(n)
    occurrence = np.empty(n, _U64)
    occurrence[place] = index - np.maximum.accumulate(np.where(fresh, index, 0))
    value = text.mix(grams + occurrence * _U64(0xD1342543DE82EF95))
    by_value = _order(value)
    first = np.searchsorted(value[by_value], _ARCS)
    size = min(n, TUPLE)
    chosen = np.sort(by_value[(first[:, None] + np.arange(size)) % n], axis=1)
    out = np.full(COMPONENTS, size, _U64)
    for j in range(size):
        out = text.mix(out * _U64(0xA0761D6478BD642F) + value[chosen[:, j]])
    return np.maximum(out, _U64(1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _as_text(fp: np.ndarray) -> str:
    return fp.astype(">u8").tobytes().hex()


def edited(s: str, following: str) -> str:
    """s with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(s) // 2
    return s[: len(s) - half] + following[:half]


def _deal(docs: DataFrame, doc: str, column: str, parts: int) -> tuple[DataFrame, int]:
    """(part, key, doc_id, text, own) rows: ranges of doc_id in order, each with a copy of the first row of the next range.

    The cuts are doc_ids themselves, so a range's first row is known by its id. A null id comes before all others.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    spark: SparkSession = docs.sparkSession
    probe = rows.select("doc_id").where("doc_id is not null")
    cuts = sorted({int(x) for x in probe.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    low = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("m"), F.min("doc_id").alias("least")).first()
    if not low["n"]:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("wrap"), "doc_id", "text", F.lit(True).alias("own")), 1
    cuts = [c for c in cuts if c > low["least"]] if low["m"] else []
    edges = spark.sparkContext.broadcast(np.array(cuts, np.int64))
    last = len(cuts)
    opens = F.col("doc_id").isNull() if low["m"] < low["n"] else F.col("doc_id") == F.lit(low["least"])

    @F.pandas_udf("int")
    def part_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(edges.value, ids.fillna(-(1 << 63)).astype("int64"), "right").astype(np.int32))

    own = rows.withColumn("part", part_of("doc_id"))
    # A row that opens a range also closes the one before; the very first also closes the last, where it comes after all.
    before = F.when(opens, F.lit(last)).when(F.col("doc_id").isin(cuts) if cuts else F.lit(False), F.col("part") - 1)
    to = F.array_compact(F.array(F.struct("part", F.lit(0).alias("wrap"), F.lit(True).alias("own")), F.when(before.isNotNull(), F.struct(before.alias("part"), F.when(opens, 1).otherwise(0).alias("wrap"), F.lit(False).alias("own")))))
    return own.withColumn("to", F.explode(to)).select("to.part", "to.wrap", "doc_id", "text", "to.own"), last + 1


def _pairs(batches):
    """Sorted rows, each with the next one's text."""
    held = None
    for batch in batches:
        for doc, s, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
            if held:
                yield (*held, s)
            # The closing row may be one of several with the same id; its copies only serve as the last row's next.
            held = (doc, s) if own else None
            if not own:
                return


def _fingerprints(batches):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def out(rows):
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows, last, size = [], (None, None), 0
    for doc, s, following in _pairs(batches):
        own = last[1] if last[0] == s else fingerprint(s)
        after = fingerprint(following)
        last = (following, after)
        change = edited(s, following)
        fp = fingerprint(change)
        rows.append((doc, len(s), hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest(), _as_text(own), _as_text(fp), likeness(own, fp), likeness(own, after)))
        size += 1
        if size == 500:
            yield out(rows)
            rows, size = [], 0
    if rows:
        yield out(rows)


def fingerprints(docs: DataFrame, doc: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The next document is the one with the next larger doc_id, and the first after the last; rows with the same doc_id
    follow each other in order of their texts, a null doc_id comes first. A null text counts as empty; empty texts have
    a fingerprint of empty slots. A table of one row is its own next. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows, parts = _deal(docs, doc, column, shared.n_buckets(spark))
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("wrap", F.col("doc_id").asc_nulls_first(), F.col("own").desc(), "text")
    return dealt.select("doc_id", "text", "own").mapInArrow(shared.tidy(_fingerprints), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
