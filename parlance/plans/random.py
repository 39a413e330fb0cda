"""Random streams of customers: numbers, integers and draws that any rerun gives again."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import random64 as R
from parlance.operators import spread
from parlance.plans.registry import Tables, query

_MASTER, _WRAP = 42, 1 << 64
_wide = lambda x: f"(({x})::UHUGEINT % {_WRAP})"
_xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
_rotated = lambda x, k: _wide(f"({x}) * {1 << k}") + f" + (({x})::UBIGINT >> {64 - k})::UHUGEINT"


def _mix_sql(source: str, target: str, z: str) -> str:
    """Common tables that mix the column z of source into the column target."""
    a, b, c = (f"{target}_{k}" for k in "abc")
    return f"""{a} AS (SELECT *, {_wide(f"{z} + {R.GOLDEN}::UHUGEINT")} AS z1 FROM {source}),
{b} AS (SELECT *, {_wide(f"{_xor('z1', 'z1::UBIGINT >> 30')} * {R.MIX_1}::UHUGEINT")} AS z2 FROM {a}),
{c} AS (SELECT *, {_wide(f"{_xor('z2', 'z2::UBIGINT >> 27')} * {R.MIX_2}::UHUGEINT")} AS z3 FROM {b}),
{target} AS (SELECT * EXCLUDE (z1, z2, z3), {_xor('z3', 'z3::UBIGINT >> 31')} AS {target} FROM {c})"""


def _streams_sql() -> str:
    bytes_ = "list_transform(range(1, length(c_mktsegment) + 1), lambda i: ascii(substr(c_mktsegment, i, 1))::UHUGEINT)"
    parts = [
        f"""h AS (SELECT c_custkey, c_mktsegment, list_reduce(list_prepend({R.FNV_START}::UHUGEINT, {bytes_}), lambda h, b: {_wide(f"{_xor('h', 'b')} * {R.FNV_PRIME}::UHUGEINT")}) AS hash FROM customer),
k AS (SELECT *, {_xor(_xor(str(_MASTER), 'hash'), _wide(f'c_custkey::UHUGEINT * {R.GOLDEN}::UHUGEINT'))} AS z FROM h)""",
        _mix_sql("k", "seed", "z"),
    ]
    source = "seed"
    for j in range(4):
        parts.append(_mix_sql(source, f"s{j}", f"(seed + {j * R.GOLDEN % _WRAP}::UHUGEINT)"))
        source = f"s{j}"
    names = "c_custkey, hash, seed"
    for j in range(3):
        kept = "".join(f", x{i}" for i in range(j))
        parts.append(f"""n{j} AS (SELECT {names}{kept}, s0, s1, {_xor('s2', 's0')} AS t2, {_xor('s3', 's1')} AS t3, {_wide('s1 * 5')} AS m FROM {source}),
r{j} AS (SELECT {names}{kept}, {_wide(f"({_rotated('m', 7)}) * 9")} AS x{j}, {_xor('s0', 't3')} AS s0, {_xor('s1', 't2')} AS s1, {_xor('t2', _wide('s1 * 131072'))} AS s2, {_rotated('t3', 45)} AS s3 FROM n{j})""")
        source = f"r{j}"
    return ",\n".join(parts)


@query(f"""
WITH {_streams_sql()}, u AS (SELECT *, (x0::UBIGINT >> 11)::DOUBLE * pow(2.0, -53) AS u FROM r2)
SELECT c_custkey, hash::VARCHAR AS hash, seed::VARCHAR AS seed, x0::VARCHAR AS x0, x1::VARCHAR AS x1, x2::VARCHAR AS x2, u, ((x1 * 1000) // {_WRAP}::UHUGEINT)::BIGINT AS below, round(-2.5 * ln(1 - u), 9) AS waiting FROM u
""")
def random_streams(t: Tables):
    """Each customer's stream (by segment and key): its hash and seed, three numbers, a uniform one, one of a thousand, and a waiting time."""
    customers = spread.even(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    rows = customers.select("c_custkey", R.byte_hash(F.col("c_mktsegment")).alias("hash"), R.stream_seed(_MASTER, F.col("c_mktsegment"), F.col("c_custkey")).alias("seed"))
    rows = rows.withColumn("x", R.draws(F.col("seed"), 3))
    u = R.uniform(F.col("x")[0])
    shown = [R.unsigned(c).cast("string").alias(n) for n, c in (("hash", F.col("hash")), ("seed", F.col("seed")), *((f"x{k}", F.col("x")[k]) for k in range(3)))]
    return rows.select("c_custkey", *shown, u.alias("u"), R.below(F.slice("x", 2, 2), 1000).alias("below"), F.round(R.exponential(u, 2.5), 9).alias("waiting"))
