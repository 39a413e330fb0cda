"""Selection of places against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import selecting, stats

KINDS = {"hot": lambda r: r.gauss(0, 1), "tied": lambda r: r.choice([1.0, 1.0, 1.0, 7.0]), "wide": lambda r: 10.0 ** r.randint(-300, 300), "one": lambda r: 5.0}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(k, f(r), i, i % 3) for k, f in KINDS.items() for i in range(3000 if k == "hot" else 700)] + [(None, 2.0, 1, 1), (None, None, 2, 1), ("none", None, 3, 1), ("single", 4.0, 4, 0)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, id long, w int").repartition(7)


def of(rows, key):
    return sorted(v for k, v, *_ in rows if k == key and v is not None)


@pytest.mark.parametrize("limit, short", [(1, 9), (50, 0), (1 << 20, 9), (1 << 20, 0)])
def test_places(table, rows, limit, short):
    wanted = {"first": lambda n: n * 0, "third": lambda n: F.floor(n / 3) + 1, "last": lambda n: n + 5}
    got = {r.k: r for r in selecting.values_at(table, ["k"], "v", "id", wanted, limit=limit, short=short).collect()}
    assert set(got) == {*KINDS, "single", None}
    for k, r in got.items():
        x = of(rows, k)
        assert (r.all__, r.first, r.third, r.last) == (len(x), x[0], x[len(x) // 3], x[-1])


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_weights(table, rows, limit):
    got = {r.k: r.m for r in selecting.values_at(table, ["k"], "v", "id", {"m": lambda n: n * 0.5}, "w", limit).collect()}
    for k in KINDS:
        pairs, run = sorted((v, w) for key, v, _, w in rows if key == k), 0
        for v, w in pairs:
            run += w
            if run >= sum(w for _, w in pairs) / 2:
                break
        assert got[k] == v
    assert got["single"] == 4.0  # weight 0


def test_poor_cuts_cost_nothing_but_time(table, rows):
    """Cuts far from the place: what lies between them is counted, so the result stays."""
    got = selecting.values_at(table, ["k"], "v", "id", {"m": lambda n: F.floor(n / 2) + 1}, limit=20)
    assert {r.k: r.m for r in got.collect()} == {k: of(rows, k)[len(of(rows, k)) // 2] for k in [*KINDS, "single", None]}


def test_nan_is_the_largest_and_an_empty_table_gives_no_rows(spark):
    odd = spark.createDataFrame([("a", float("nan"), 1), ("a", float("inf"), 2), ("a", -0.0, 3), ("a", 0.0, 4)], "k string, v double, id long")
    r = selecting.values_at(odd, ["k"], "v", "id", {"p2": lambda n: n * 0 + 2, "p3": lambda n: n * 0 + 3, "p4": lambda n: n}).first()
    assert r.p2 == 0 and math.isinf(r.p3) and math.isnan(r.p4)
    assert stats.quantiles(odd.where("id > 9"), ["k"], "v", "id", {"m": 0.5}).collect() == []


def test_clashing_columns_and_integers(spark):
    df = spark.createDataFrame([(1, 3, 1, 9, 9), (1, 8, 2, 9, 9), (2, 2, 3, 9, 9)], "k int, v long, id long, all__ int, cuts__ int")
    assert sorted(map(tuple, stats.quantiles(df, ["k"], "v", "id", {"m": 0.5, "top": 1.0}).collect())) == [(1, 5.5, 8.0), (2, 2.0, 2.0)]


def test_one_hot_key_in_many_cells(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 200_003).alias("v"), "id")
    got = selecting.values_at(df, ["k"], "v", "id", {"m": lambda n: F.floor(n / 2) + 1}, limit=1000)
    assert got.first().m == sorted(i * 7919 % 200_003 for i in range(200_000))[100_000]
