"""Random streams against plain integers and golden values, and distributions against their moments and bounds."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import random64 as R

MASK = (1 << 64) - 1


def mix(z):
    z = (z + R.GOLDEN) & MASK
    z = ((z ^ (z >> 30)) * R.MIX_1) & MASK
    z = ((z ^ (z >> 27)) * R.MIX_2) & MASK
    return z ^ (z >> 31)


def walked(s, n):
    turn = lambda x, k: (x << k | x >> (64 - k)) & MASK
    out, s = [], list(s)
    for _ in range(n):
        out.append(turn(s[1] * 5 & MASK, 7) * 9 & MASK)
        t = s[1] << 17 & MASK
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = turn(s[3], 45)
    return out


def fnv(raw):
    h = R.FNV_START
    for b in raw:
        h = (h ^ b) * R.FNV_PRIME & MASK
    return h


def one(spark, *columns):
    return [int(x) if x is not None else None for x in spark.range(1).select(*(R.unsigned(c).alias(f"c{k}") for k, c in enumerate(columns))).first()]


def test_golden_values(spark):
    state = R.bits(1_234_567)
    assert one(spark, R.split_mix(state), R.split_mix(R.add(state, R.bits(R.GOLDEN))), R.split_mix(R.add(R.add(state, R.bits(R.GOLDEN)), R.bits(R.GOLDEN)))) == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    assert walked([1, 2, 3, 4], 4) == [11520, 0, 1509978240, 1215971899390074240]
    assert one(spark, *(R.byte_hash(F.lit(x)) for x in ("", "a", "foobar", "é中"))) == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, fnv("é中".encode())]
    assert one(spark, R.byte_hash(F.lit(None).cast("string"))) == [None]


def test_arithmetic_wraps(spark):
    rng = np.random.default_rng(0)
    numbers = [0, 1, MASK, 1 << 63, (1 << 63) - 1, (1 << 32) - 1, 1 << 32, *(int(x) for x in rng.integers(0, 1 << 64, 60, dtype=np.uint64))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a in numbers[:20] for b in numbers], "a long, b long")
    factors = [5, R.GOLDEN, R.MIX_1, MASK, R.FNV_PRIME, 1 << 63]
    rows = df.select("a", "b", R.unsigned(R.add(F.col("a"), F.col("b"))).alias("sum"), *(R.unsigned(R.times(F.col("a"), f)).alias(f"p{k}") for k, f in enumerate(factors)), R.unsigned(R.rotated(F.col("a"), 45)).alias("r")).collect()
    for r in rows:
        a, b = r.a & MASK, r.b & MASK
        assert int(r["sum"]) == (a + b) & MASK and [int(r[f"p{k}"]) for k in range(len(factors))] == [a * f & MASK for f in factors]
        assert int(r.r) == (a << 45 | a >> 19) & MASK


def test_streams(spark):
    df = spark.createDataFrame([("planner", 0), ("planner", 1), ("gain", 0), ("planner", 7_000_000_000)], "name string, epoch long")
    rows = df.withColumn("x", R.draws(R.stream_seed(42, F.col("name"), F.col("epoch")), 5)).withColumn("x", F.transform("x", R.unsigned)).collect()
    for r in rows:
        seed = mix(42 ^ fnv(r.name.encode()) ^ (r.epoch * R.GOLDEN & MASK))
        assert [int(x) for x in r.x] == walked([mix((seed + k * R.GOLDEN) & MASK) for k in range(4)], 5)
    assert len({tuple(r.x) for r in rows}) == 4
    assert "Python" not in df.select(R.draws(R.stream_seed(42, F.col("name"), F.col("epoch")), 5))._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def drawn(spark):
    return spark.range(20_000).select("id", R.draws(R.stream_seed(7, F.lit("t"), F.col("id")), 2).alias("x")).withColumn("u", R.uniform(F.col("x")[0])).cache()


def test_integers_are_even_and_bounded(spark, drawn):
    got = drawn.select(R.below(F.col("x"), 10).alias("n")).groupBy("n").count().collect()
    assert {r.n for r in got} == set(range(10)) and all(abs(r["count"] - 2_000) < 250 for r in got)
    assert {r.n for r in drawn.limit(50).select(R.below(F.col("x"), 1).alias("n")).collect()} == {0}
    # A number whose lower half is among the first (2^64 mod n) isn't taken; the next one is.
    n = 3
    assert spark.range(1).select(R.below(F.array(R.bits(0), R.bits(MASK)), n).alias("n")).first().n == (MASK * n) >> 64
    assert spark.range(1).select(R.below(F.array(R.bits(0)), n).alias("n")).first().n is None
    with pytest.raises(ValueError, match="2\\^31"):
        R.below(F.col("x"), 1 << 31)


def test_distributions(drawn):
    u = F.col("u")
    names = {"u": u, "e": R.exponential(u, 2.0), "n": R.normal(u, 1.0, 3.0), "l": R.log_normal(u, 0.0, 0.5), "t": R.truncated_normal(u, 2.0, 1.5)}
    rows = drawn.select(*(c.alias(k) for k, c in names.items()))
    got = rows.agg(*(f(k).alias(f"{g}_{k}") for k in names for g, f in (("mean", F.avg), ("sd", F.stddev), ("min", F.min), ("max", F.max)))).first()
    assert 0 <= got.min_u and got.max_u < 1 and abs(got.mean_u - 0.5) < 0.01
    assert abs(got.mean_e - 2) < 0.06 and abs(got.sd_e - 2) < 0.1 and got.min_e >= 0
    assert abs(got.mean_n - 1) < 0.08 and abs(got.sd_n - 3) < 0.08
    assert abs(got.mean_l - math.exp(0.125)) < 0.02
    assert -3 <= got.min_t < -2.9 < 2.9 < got.max_t <= 3 and abs(got.mean_t) < 0.04
    again = drawn.repartition(7).select("id", names["t"].alias("t")).orderBy("id").limit(100).collect()
    assert again == drawn.select("id", names["t"].alias("t")).orderBy("id").limit(100).collect()


def test_normal_quantile_is_exact_enough(spark):
    p = [1e-12, 1e-6, 0.01, 0.024, 0.025, 0.3, 0.5, 0.7, 0.97, 0.98, 1 - 1e-9]
    got = [r.z for r in spark.createDataFrame([(k, x) for k, x in enumerate(p)], "k int, p double").select("k", R.normal_quantile(F.col("p")).alias("z")).orderBy("k").collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(x) for x in p], rtol=3e-9, atol=3e-9)


def test_weighted_choice(spark):
    cases = [([1.0, 0.0, 3.0], 0.0, 0), ([1.0, 0.0, 3.0], 0.25, 2), ([1.0, 0.0, 3.0], 0.9999, 2), ([0.0, None, -1.0], 0.5, None), ([], 0.5, None), ([None, 2.0, 0.0], 0.999, 1)]
    df = spark.createDataFrame([(k, w, u) for k, (w, u, _) in enumerate(cases)], "k int, w array<double>, u double")
    assert [r.at for r in df.select("k", R.weighted_choice(F.col("u"), F.col("w")).alias("at")).orderBy("k").collect()] == [c for _, _, c in cases]
