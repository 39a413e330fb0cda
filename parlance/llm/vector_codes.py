"""Product quantisation in whole numbers: weighted Lloyd rounds over the distinct parts of all vectors.

A component x becomes floor(SCALE * x), a vector PARTS consecutive parts. Equal parts of one position are one row with a
weight, so a vector that a third of the table shares is four rows from there on. Each of ROUNDS rounds is a pass over
these rows: a task finds the nearest entry of each and adds up, by entry, weights and weighted components, of which there
are as many as the codebooks have numbers. What a round takes from the driver and gives to it is no larger than that.
Codes and errors are joined back to the vectors one position after the other; a part that very many vectors share is one
row on one side of such a join, so Spark can split the other.

All sums are of integers, so neither partitions nor their order change a result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import shared

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances are worked out at once.
ROWS = 2_048


def usable(column: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def reach(length: int) -> int:
    """The largest whole component: with it, squared distances of a whole vector still fit 64 bits."""
    return math.isqrt((1 << 62) // max(1, length)) // 2


def whole(column: Column, length: int) -> Column:
    """A vector's components as floor(SCALE * x), those beyond reach() as that."""
    most = float(reach(length))
    return F.transform(column, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-most)), F.lit(most))).cast("long"))


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: by products of doubles where these are whole numbers, else by differences."""
    most = max(int(np.abs(x).max(initial=0)) for x in (rows, entries))
    if 4 * rows.shape[1] * most * most < 1 << 53:
        a, b = rows.astype(np.float64), entries.astype(np.float64)
        return (np.sum(a * a, 1)[:, None] - 2 * (a @ b.T) + np.sum(b * b, 1)[None, :]).astype(np.int64)
    out = np.zeros((len(rows), len(entries)), np.int64)
    for j in range(rows.shape[1]):
        out += (rows[:, j][:, None] - entries[:, j][None, :]) ** 2
    return out


def nearest_entries(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, equal ones to the lower index."""
    index, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for s in range(0, len(rows), ROWS):
        d = distances(rows[s : s + ROWS], entries)
        index[s : s + ROWS] = d.argmin(axis=1)
        error[s : s + ROWS] = d[np.arange(len(d)), index[s : s + ROWS]]
    return index, error


def _of_positions(batch: pa.RecordBatch):
    """(position, rows, matrix) of the parts of each position."""
    column, pos = batch.column("part"), batch.column("pos").to_numpy()
    cuts, flat = column.offsets.to_numpy(), column.values.to_numpy()
    for p in np.unique(pos).tolist():
        rows = np.flatnonzero(pos == p)
        size = cuts[rows[0] + 1] - cuts[rows[0]]
        yield p, rows, flat[cuts[rows][:, None] + np.arange(size)]


def _sums(codebooks: list[np.ndarray]):
    """Weighted parts to (pos, entry, at, total): the sum of component at by entry; at -1 has the weights."""

    def run(batches):
        total = [np.zeros((len(c), c.shape[1] + 1), object) for c in codebooks]
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, rows, matrix in _of_positions(batch):
                index, _ = nearest_entries(matrix, codebooks[p])
                w = weight[rows]
                every = np.c_[np.ones(len(w), np.int64), matrix]
                if int(np.abs(every).max()) * int(w.sum()) < 1 << 62:
                    own = np.zeros(total[p].shape, np.int64)
                    np.add.at(own, index, every * w[:, None])
                else:
                    own = np.zeros(total[p].shape, object)
                    np.add.at(own, index, every.astype(object) * w.astype(object)[:, None])
                total[p] += own
        for p, x in enumerate(total):
            entry, at = np.nonzero(np.broadcast_to((x[:, :1] != 0), x.shape))
            if len(entry):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(at.astype(np.int32) - 1), pa.array([str(v) for v in x[entry, at]])], names=["pos", "entry", "at", "total"])

    return run


def _coded(codebooks: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, matrix in _of_positions(batch):
                code[rows], error[rows] = nearest_entries(matrix, codebooks[p])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), pa.array(code), pa.array(error)], names=["pos", "part", "code", "error"])

    return run


class Codebooks:
    """The entries of each part's position, as matrices."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    def sha256(self) -> str:
        """Of all entries' components in decimal, by position, entry and place, joined by commas; lowercase hexadecimal."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_parts(vectors: DataFrame, name, column: str, length: int, parts: int) -> DataFrame:
    """vectors with their parts as columns part0, part1, ... (named by name)."""
    at = [length * p // parts for p in range(parts + 1)]
    ints = vectors.withColumn(name("ints"), whole(F.col(f"`{column}`"), length))
    return ints.withColumns({name(f"part{p}"): F.slice(name("ints"), at[p] + 1, at[p + 1] - at[p]) for p in range(parts)}).drop(name("ints"))


def compress(vectors: DataFrame, column: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vectors with code array<int> and error long, codebooks): each vector's nearest entries by part, and their squared distance.

    The codebooks begin as the parts of the first entries vectors by order (null last, equal ones by their components; all
    of them, if fewer). A round assigns every part to its nearest entry and moves each entry to the rounded-down mean of
    its parts; one without parts stays. Vectors that are null or hold a null or a component that isn't finite are left out,
    and so are those of another length than the first vector's. A length that parts don't divide gives parts whose lengths
    differ by one. Components beyond reach() count as that. Repeated rows and equal ids are rows of their own; other columns are kept (code and error are
    replaced). Without a usable vector the result is empty.
    """
    spark, name = vectors.sparkSession, shared.namer(vectors.columns)
    good = vectors.where(usable(F.col(f"`{column}`")))
    key = [F.asc_nulls_last(f"`{order}`")]
    head = good.orderBy(*key, F.asc(f"`{column}`")).select(F.size(f"`{column}`")).head()
    length = head[0] if head else 0
    good = good.where(F.size(f"`{column}`") == length)
    split = vector_parts(good, name, column, length, parts)
    named = [name(f"part{p}") for p in range(parts)]
    first = split.orderBy(*key, *named).select(*named).limit(entries).collect()
    widths = [length * (p + 1) // parts - length * p // parts for p in range(parts)]
    books = [np.array([r[p] for r in first], np.int64).reshape(len(first), widths[p]) for p in range(parts)]

    scratch = shared.Scratch(spark)
    if first:
        every = F.explode(F.array(*(F.struct(F.lit(p).alias("pos"), F.col(named[p]).alias("part")) for p in range(parts))))
        weighted = scratch.table(split.select(every.alias("x")).groupBy("x.pos", "x.part").agg(F.count("*").alias("weight")), "parts")
        for _ in range(rounds):
            sums = weighted.mapInArrow(shared.tidy(_sums(books)), "pos int, entry int, at int, total string")
            books = [b.copy() for b in books]
            rows = sums.groupBy("pos", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
            count = {(r.pos, r.entry): int(r.total) for r in rows if r["at"] < 0}
            for r in rows:
                if r["at"] >= 0:
                    books[r.pos][r.entry, r["at"]] = int(r.total) // count[r.pos, r.entry]
        codes = shared.table(weighted.mapInArrow(shared.tidy(_coded(books)), "pos int, part array<long>, code int, error long"), "codes")
        scratch.clear()
    else:
        codes = spark.createDataFrame([], "pos int, part array<long>, code int, error long")
    out = split
    for p in range(parts):
        own = codes.where(F.col("pos") == p).select(F.col("part").alias(named[p]), F.col("code").alias(name(f"code{p}")), F.col("error").alias(name(f"error{p}")))
        out = out.join(own, named[p]).drop(named[p])
    kept = [F.col(f"`{c}`") for c in vectors.columns if c not in ("code", "error")]
    error = sum((F.col(name(f"error{p}")) for p in range(1, parts)), F.col(name("error0")))
    return out.select(*kept, F.array(*(name(f"code{p}") for p in range(parts))).alias("code"), error.alias("error")), Codebooks(books)


def code_digests(embeddings: DataFrame) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error (of all vectors with the label) and codebooks_sha256."""
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    coded, codebooks = compress(slim)
    coded = shared.table(coded.drop("embedding"), "coded")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    digits = F.concat(*(F.lower(F.lpad(F.hex(F.col("code")[p]), 2, "0")) for p in range(PARTS)))
    rows = coded.select("vec_id", digits.alias("code"), "error", F.col("label").alias("of"))
    joined = rows.join(by_label, F.col("of").eqNullSafe(F.col("label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """code_digests() in DuckDB SQL, a round of assignment and means after the other."""
    steps = [f"""
k AS (SELECT *, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0),
i AS (SELECT r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM k),
p AS (SELECT r, vec_id, pos, list_slice(v, pos * len(v) // {PARTS} + 1, (pos + 1) * len(v) // {PARTS}) AS part FROM i, range({PARTS}) t(pos)),
d AS (SELECT pos, part, count(*) AS weight FROM p GROUP BY 1, 2),
c0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part AS e FROM p
  WHERE r IN (SELECT r FROM i ORDER BY vec_id LIMIT {ENTRIES}))"""]  # fmt: skip
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS (SELECT d.pos, part, weight, min(struct_pack(error := list_dot_product(part, part) - 2 * list_dot_product(part, e) + list_dot_product(e, e), entry := entry)) AS best
  FROM d JOIN c{k} c ON c.pos = d.pos GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
s{k} AS (SELECT pos, entry, list(m ORDER BY j) AS e FROM (
  SELECT pos, best.entry AS entry, j, floor(sum(weight * part[j]) / sum(weight)) AS m FROM a{k}, range(1, 65) t(j) WHERE j <= len(part) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS (SELECT c.pos, c.entry, coalesce(s.e, c.e) AS e FROM c{k} c LEFT JOIN s{k} s ON s.pos = c.pos AND s.entry = c.entry)""")
    return f"""
WITH {",".join(steps)},
x AS (SELECT p.r, string_agg(lower(printf('%02x', best.entry::INTEGER)), '' ORDER BY p.pos) AS code, sum(best.error)::BIGINT AS error
  FROM p JOIN a{ROUNDS} a ON a.pos = p.pos AND a.part = p.part GROUP BY 1),
y AS (SELECT i.vec_id, i.label, x.code, x.error FROM x JOIN i USING (r)),
h AS (SELECT sha256(string_agg(n::BIGINT::VARCHAR, ',' ORDER BY pos, entry, j)) AS codebooks_sha256 FROM (SELECT pos, entry, generate_subscripts(e, 1) AS j, unnest(e) AS n FROM c{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM y, h
"""


CODES_SQL = _sql()
