"""Operators on small cases: boundaries, ties, determinism and signals whose answers are known."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import columns as C
from parlance.functions import signal
from parlance.operators import configs, curation, fingerprints, graphs, intervals, joins, planning, sequences, spatial, spread, stats
from parlance.streaming import stateful


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_islands_merge_under_the_gap_only(spark):
    rows = table(spark, [("a", 0, 10), ("a", 14, 20), ("a", 25, 30), ("a", 5, 6), ("b", 0, 1)], "k string, start long, end long")
    got = sorted(tuple(r) for r in intervals.islands(rows, ["k"], 5).select("k", "start", "end", "n").collect())
    assert got == [("a", 0, 20, 3), ("a", 25, 30, 1), ("b", 0, 1, 1)]
    gaps = intervals.gaps(intervals.islands(rows, ["k"], 5), ["k"], 5).collect()
    assert [tuple(r) for r in gaps] == [("a", 20, 25, True)]


def test_concurrency_is_half_open(spark):
    rows = table(spark, [("a", 0, 10), ("a", 10, 20), ("a", 5, 10), ("a", 30, 40)], "k string, start long, end long")
    r = intervals.concurrency(rows, ["k"]).first()
    assert (r.max_active, r.min_active) == (2, 0) and r.mean_active == pytest.approx(35 / 40)


def test_spread_series_are_like_windows(spark):
    rng = np.random.default_rng(3)
    rows = table(spark, [("a" if k % 5 else "b", k, int(v), int(v) + int(w)) for k, (v, w) in enumerate(zip(rng.integers(0, 900, 400), rng.integers(1, 60, 400), strict=True))], "k string, id long, s long, e long").repartition(7).cache()
    one = sorted(map(tuple, intervals.concurrency(rows, ["k"], "s", "e").collect()))
    assert one == sorted(map(tuple, spread.concurrency(rows, ["k"], 50, "s", "e").collect()))
    from pyspark.sql import Window

    by = Window.partitionBy("k").orderBy("s", "id")
    want = rows.select("id", F.sum("e").over(by.rowsBetween(-6, 0)).alias("x"), F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("m"), F.lead("e").over(by).alias("n"), F.row_number().over(by).alias("p"))
    last = spread.over_last(rows, ["k"], ["s", "id"], F.col("s"), 50, 7, {"x": lambda w: F.sum("e").over(w)}, block=8).select("id", "x")
    dealt = spread.following(spread.running(spread.dealt(rows, F.col("s"), 50), ["k"], ["s", "id"], "e", "m", "max", before=True), ["k"], ["s", "id"], "e", "n").select("id", "m", "n")
    got = last.join(dealt, "id").join(spread.numbered(rows, ["k"], ["s", "id"], F.col("s"), 50, "p").select("id", "p"), "id").select("id", "x", "m", "n", "p")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def test_overlaps_give_each_pair_once(spark):
    rng = np.random.default_rng(1)
    spans = [(k, int(s), int(s + n)) for k, (s, n) in enumerate(zip(rng.integers(-500, 500, 60), rng.integers(1, 90, 60), strict=True))]
    a = table(spark, [(x, s, e, 0) for x, s, e in spans[:30]], "x long, a0 long, a1 long, g int")
    b = table(spark, [(x, s, e, 0) for x, s, e in spans[30:]], "y long, b0 long, b1 long, g int")
    got = sorted((r.x, r.y, r.overlap) for r in intervals.overlapping(a, b, ["g"], 40, ("a0", "a1"), ("b0", "b1")).collect())
    assert got == sorted((x, y, min(e, f) - max(s, t)) for x, s, e in spans[:30] for y, t, f in spans[30:] if max(s, t) < min(e, f))


def test_containment_and_as_of(spark):
    points = table(spark, [(0, 5), (0, 10), (0, 9), (0, -1)], "k int, at long")
    spans = table(spark, [(0, 5, 10)], "k int, start long, end long")
    assert sorted(r.at for r in intervals.containing(points, spans, ["k"], "at", 3).collect()) == [5, 9]
    right = table(spark, [(0, 9, "x"), (0, 4, "y")], "k int, at long, v string")
    assert {r.at: r.found for r in intervals.as_of(points, right, ["k"], "at", "v").collect()} == {5: "y", 10: "x", 9: "x", -1: None}


def test_quantiles_differ(spark):
    rows = table(spark, [(0, k, v, w) for k, (v, w) in enumerate([(1, 1), (2, 1), (3, 1), (10, 5)])], "g int, id int, v int, w int")
    assert stats.upper_median(rows, ["g"], "v", "id").first().upper_median == 3
    assert stats.floor_percentile(rows, ["g"], "v", "id", 0.25).first().floor_percentile == 2
    assert stats.weighted_median(rows, ["g"], "v", "w", "id").first().weighted_median == 10
    assert rows.agg(F.percentile("v", 0.5)).first()[0] == 2.5


def test_histogram_keeps_empty_bins(spark):
    rows = table(spark, [(0.5,), (9.0,), (-3.0,)], "v double")
    assert {r.bin: r.n for r in stats.histogram(rows, "v", [0, 1, 5]).collect()} == {0: 1, 1: 0, 2: 1}


def test_gate_drops_what_is_quiet(spark):
    rows = table(spark, [(0, 1.0), (0, 1.0), (0, 0.01), (0, 1e-9)], "g int, p double")
    r = stats.gated_mean(rows, ["g"], "p", -70, -10).first()
    assert r.n == 2 and r.gated_db == pytest.approx(0)


def test_axes_are_signed(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 3)) * [5, 2, 0.1]
    rows = table(spark, [tuple(map(float, r)) for r in x], "a double, b double, c double")
    first = stats.principal_axes(rows, ["a", "b", "c"], 2).orderBy("axis").first()
    assert first.weights[0] == pytest.approx(1, abs=0.05) and first.eigenvalue == pytest.approx(np.linalg.eigvalsh(np.cov(x.T)).max())


def test_runs_and_peaks(spark):
    rows = table(spark, [(0, k, v) for k, v in enumerate([1, 3, 3, 0, 5, 5])], "g int, t int, v int")
    got = sorted((r["first"], r["last"], r.closed) for r in sequences.runs(rows, ["g"], ["t"], F.col("v") >= 3).collect())
    assert got == [(2, 3, True), (5, 6, False)]
    peaks = rows.withColumn("p", sequences.is_peak("v", ["g"], ["t"])).where("p").collect()
    assert [r.t for r in peaks] == [1, 4]


def test_dense_ids_go_on_after_the_largest(spark):
    known = table(spark, [("b", 7)], "name string, id long")
    fresh = table(spark, [("c",), ("a",), ("b",), ("a",)], "name string")
    assert {r.name: r.id for r in sequences.dense_ids(known, fresh, "name", "id").collect()} == {"b": 7, "a": 8, "c": 9}


def test_exact_copies_keep_the_first(spark):
    rows = table(spark, [(3, "x"), (1, "x"), (2, "y"), (5, None), (4, None)], "id int, t string")
    assert sorted(r.id for r in sequences.later_copies(rows.where("t is not null"), F.col("t"), ["id"]).collect()) == [3]


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(C.interpolate(F.lit(5.0), [(0, 1), (10, 100)], "log")) == pytest.approx(10)
    assert one(C.interpolate(F.lit(99.0), [(0, 1), (10, 100)], "step")) == 100
    assert one(C.convert_rate(F.lit(-1), 2, 1)) == 0 and one(C.convert_rate(F.lit(3), 2, 1)) == 2
    assert one(C.fnv1a_32(F.lit("a"))) == 0xE40C292C and one(C.fnv1a_32(F.lit(""))) == 0x811C9DC5
    assert one(C.redact_path(F.lit("/home/x/a.wav"))).endswith(">.wav")
    assert one(C.hours_minutes_seconds(F.lit(3725.9))) == "1h02m05s"
    assert one(C.semitones(F.lit(0.0))) is None
    assert one(C.db(F.lit(0.0))) == pytest.approx(-200)


def test_degrading(spark):
    rows = table(spark, [(2, 4, "strict"), (2, 4, "safe"), (3, 4, "continuous"), (5, 4, "strict"), (1, 4, "continuous")], "a int, w int, p string")
    got = [tuple(r)[3:] for r in configs.degraded(rows, "a", "w", "p").collect()]
    assert got == [("error", 0.0, 0.0), ("stationary", 0.0, 0.0), ("reduced", 0.5, 0.25), ("as planned", 1.0, 0.0), ("stationary", 0.0, 0.0)]


def test_nested_children_may_be_missing(spark):
    rows = joins.nested(table(spark, [(1,), (2,)], "k int"), table(spark, [(1, 5), (1, 4)], "k int, v int"), "k", F.col("v"), "vs")
    assert {r.k: r.vs for r in rows.collect()} == {1: [4, 5], 2: []}


def test_spatial(spark):
    rows = table(spark, [("a", 0.0, 0.5), ("a", 3.0, 0.25)], "z string, position double, activity double").withColumn("g", spatial.placement_gains(F.col("position"), 4))
    assert all(sum(x * x for x in r.g) == pytest.approx(1) for r in rows.collect())
    power = spatial.expected_power(rows, ["z"], "activity", "g")
    assert power.agg(F.sum("power")).first()[0] == pytest.approx(0.75)
    trim = {r.channel: r.trim_db for r in spatial.trims(power, ["z"]).collect()}
    assert trim[0] == -3.0 and trim[2] > 0
    assert {r.z: r.talkers for r in spatial.zone_counts(table(spark, [("a", 9.0), ("b", 1.0), ("c", 0.01)], "z string, m double"), "z", "m", 10).collect()} == {"a": 9, "b": 1, "c": 1}
    assert spatial.least_loaded(table(spark, [(1, 2, 0.5), (1, 1, 0.5), (1, 0, 0.9)], "k int, o int, e double"), ["k"], "o", "e").first().o == 1


def test_graph_components(spark):
    edges = table(spark, [(5, 4), (4, 3), (9, 8), (3, 1)], "u long, v long")
    assert {r.node: r.component for r in graphs.components(edges).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_greedy_acceptance_depends_on_order(spark):
    near = table(spark, [(1, 2), (2, 3)], "a long, b long")
    got = {r.doc_id: r.accepted for r in fingerprints.accepted(near, table(spark, [(1,), (2,), (3,), (4,)], "doc_id long")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_frequent_grams_count_as_others_do(spark):
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(2)]
    rows = [(k, " ".join(f"c{i}" for i in range(20))) for k in range(50)]
    rows += [(100 + k, f"x{k} {passages[k % 2]} y{k}") for k in range(100)] + [(300, " ".join(passages)), (301, " ".join(passages) + " end")]
    rows += [(400, "one two three four five"), (401, "one two three four  five"), (402, "a b a b a b a b"), (403, "a b a b a b a b"), (404, "a b a b a b q")]
    docs = table(spark, rows, "doc_id long, text string")
    held = {}
    for k, text in rows:
        w = text.split()
        held[k] = [tuple(w[i : i + 4]) for i in range(len(w) - 3)]
    want, best = {}, {}
    for a in sorted(held):
        for b in (x for x in sorted(held) if x > a):
            n = {}
            for i, g in enumerate(held[a]):
                for j, h in enumerate(held[b]):
                    if g == h:
                        n[j - i] = n.get(j - i, 0) + 1
            top = sorted((-v, s) for s, v in n.items() if v >= 2)[:8]
            want |= {(a, b, s): (-v, r + 1) for r, (v, s) in enumerate(top)}
            if top:
                s = top[0][1]
                over = [held[a][i] == held[b][i + s] for i in range(len(held[a])) if 0 <= i + s < len(held[b])]
                best[a, b] = (len(over), round(over.count(False) / len(over), 6))
    found = fingerprints.votes(docs).cache()
    assert {(r.a, r.b, r["shift"]): (r.votes, r["rank"]) for r in found.collect()} == want
    assert {(r.a, r.b): (r.n, r.rate) for r in fingerprints.mismatch(found).collect()} == best
    assert best[300, 301] == (57, 0.0)


def accepted_by_loop(rows):
    sets = {}
    for k, text in rows:
        w = (text or "").split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    kept = []
    for k in sorted(sets):
        if not any(100 * len(sets[k] & sets[x]) >= 80 * len(sets[k] | sets[x]) for x in kept if sets[k] & sets[x]):
            kept.append(k)
    return set(kept)


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_duplicates_against_a_loop(spark, monkeypatch, rounds):
    """Copies, chains in which each is near to the one before only, a passage that many quote, short texts and nothing."""
    monkeypatch.setattr(fingerprints, "ROUNDS", rounds)
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows, passage = [], [word() for _ in range(25)]
    for _ in range(6):
        base = [word() for _ in range(80)]
        for _ in range(8):
            base = list(base)
            for at in rng.integers(0, 80, 2):
                base[at] = word()
            rows.append(" ".join(base))
    rows += [" ".join([*passage, *(word() for _ in range(int(rng.integers(1, 40))))]) for _ in range(30)] + [rows[3], rows[3] + "  ", "a b", "a b", "a  b", "", None, "one two three four five", "one two three four five six"]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(rows)), rows, strict=True)]
    got = {r.doc_id for r in fingerprints.near_duplicates(table(spark, rows, "doc_id long, text string")).where("accepted").collect()}
    assert got == accepted_by_loop(rows)


def test_unit_vectors_keep_the_sign_of_zero(spark):
    rows = table(spark, [(1, [-1e-7, 3.0, 4.0]), (2, [0.0, 0.0, 0.0])], "id int, v array<double>")
    got = {r.id: r.unit for r in rows.select("id", F.transform(C.unit_power(F.col("v")), lambda x: C.rounded(x, 6)).alias("unit")).collect()}
    assert str(got[1]) == "[-0.0, 0.6, 0.8]" and str(got[2]) == "[nan, nan, nan]"


def test_equal_values_have_equal_means(spark):
    values = [29.27, 122.79, 0.1, 0.2, 0.3, 1e6, 55.55]
    rows = table(spark, [(g, x) for g in range(2) for x in (values if g else values[::-1])] + [(2, 1e30), (2, 3e30)], "g int, x double").coalesce(1)
    got = {r.g: r.m for r in rows.groupBy("g").agg(stats.steady_mean("x").alias("m")).collect()}
    assert got[0] == got[1] and got[2] == 2e30


def test_means_in_order_are_those_of_a_loop(spark):
    rng = np.random.default_rng(11)
    rows = [(int(g), k, float(x)) for k, (g, x) in enumerate(zip(rng.integers(0, 5, 600), rng.integers(1, 50_000, 600) / 100, strict=True))]
    rows += [(5, 600, None), (5, 601, 0.1), (5, 602, None), (6, 603, None)]
    want = {}
    for g in range(7):
        total, own = 0.0, [x for h, _, x in rows if h == g and x is not None]
        for x in own:
            total += x
        want[g] = total / len(own) if own else None
    df = table(spark, [rows[k] for k in rng.permutation(len(rows))], "g int, id long, x double").repartition(7)
    assert {r.g: r["mean"] for r in stats.mean_in_order(df, ["g"], "x", ["id"]).collect()} == want


def test_gram_counts_shuffle_no_text(spark):
    rows = [(1, "a b c d a b c d"), (2, "a b c d"), (2, "a b c d e"), (3, "a b c"), (4, None), (None, "x y z w"), (None, "x y z w v")]
    got = fingerprints.gram_counts(table(spark, rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 5, 4), (2, 3, 2), (None, 3, 2)]
    # Where no key has several texts, nothing but keys is moved.
    alone = fingerprints.gram_counts(spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat("id", i)), " ").alias("text")))
    assert alone.agg(F.sum("n"), F.sum("n_distinct")).first()[:] == (400 * 297, 400 * 297)
    text = alone._jdf.queryExecution().toString()
    assert "LeftAnti" in text and "hashpartitioning(gram" not in text.split("Union")[0]


def test_nearest_and_sums_by_products(spark, monkeypatch):
    """Copies, near copies, ties of 6 digits and missing languages, over many blocks."""
    monkeypatch.setattr(curation, "BLOCK", 40)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 8)), 2)
    x[50:60], x[60:70], x[70:80] = x[:10], x[:10] + 3e-7, x[10:20] * [1, 1, 1, 1, 1, 1, 1, 9]
    rows = [(k, v.tolist(), [None, 1, 2, 3][k % 4]) for k, v in enumerate(x)]
    vectors, w = table(spark, rows, "vec_id long, embedding array<double>, label int"), curation.FEATURE_WEIGHTS
    d = np.sqrt((((x[:, None, :7] - x[None, :, :7]) ** 2) * w).sum(2)) + [[bool(p[2] and q[2] and p[2] != q[2]) for q in rows] for p in rows]
    np.fill_diagonal(d, np.inf)
    want = {k: min((round(float(y), 6), j) for j, y in enumerate(d[k])) for k in range(150)}
    near, sums = curation.nearest(vectors).collect(), curation.distance_sums(vectors).collect()
    assert {r.a: (r.distance, r.b) for r in near} == want
    np.fill_diagonal(d, 0)
    assert len(sums) == 150 and all(abs(r.total - d[r.a].sum()) < 1.1e-6 for r in sums)
    product, size = curation._squares(x[:, :7], x[:, :7], w)
    assert np.abs(product - (((x[:, None, :7] - x[None, :, :7]) ** 2) * w).sum(2)).max() < 1e-14 * size


def test_even_tasks(spark):
    even = spread.even(spark.range(1_000).coalesce(1), "id", 100)
    sizes = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_000 and max(sizes) < 200
    assert spread.even(spark.range(0), "id").count() == 0


def test_flat_runs_in_one_order(spark, tmp_path):
    from parlance.plans import QUERIES

    values = [None, None, 1.0, 1.0, 1.0, 2.0, 1.0, 1.0, None]
    rows = [(1, k, 1, 1, q, 1.0) for k, q in enumerate(values)] + [(2, k, 1, 1, float(k), 1.0) for k in range(5)]
    table(spark, rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["win_flat_runs"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 3)]
    # Two orders of the rows were two windows, and their sorts were held at once.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_pools(spark):
    rows = table(spark, [("g", k, float(k % 13)) for k in range(40)], "g string, id long, v double")
    balanced = planning.balanced_pool(rows, ["g"], "v", "id", 10, 3).groupBy("quartile").count().collect()
    assert {r.quartile: r["count"] for r in balanced} == {0: 2, 1: 3, 2: 3, 3: 2}
    picks = planning.matched_pool(rows, ["g"], "id", "v", 5).collect()
    assert len({r.number for r in picks}) == 5
    medoid = curation.medoid(table(spark, [(1, 2, 1.0), (2, 1, 1.0), (1, 3, 4.0), (3, 1, 4.0), (2, 3, 2.0), (3, 2, 2.0)], "a int, b int, distance double")).first()
    assert medoid.medoid == 2


def test_cycles_use_everyone_once(spark):
    members = table(spark, [(g, k) for g in "ab" for k in range(10)], "g string, id long")
    rows = planning.shuffle_cycles(members, ["g"], "id", 5, 1).toPandas()
    again = planning.shuffle_cycles(members.repartition(1), ["g"], "id", 5, 1).toPandas()
    assert {tuple(r) for r in rows.to_numpy().tolist()} == {tuple(r) for r in again.to_numpy().tolist()}
    for _, g in rows.groupby("g"):
        order = g.sort_values(["cycle", "position"])["id"].tolist()
        for c in range(5):
            assert sorted(order[10 * c : 10 * c + 10]) == list(range(10))
            assert not c or order[10 * c] not in order[10 * c - 2 : 10 * c]


def test_plans_against_their_recurrences(spark):
    rng = np.random.default_rng(4)
    rows = [("k", k, int(at), int(n)) for k, (at, n) in enumerate(zip(np.sort(rng.integers(0, 10**10, 300)), rng.integers(6, 48, 300) * 10**7, strict=True))]
    df = table(spark, rows, "k string, id long, t long, length long")
    got = {r.id: r.planned for r in planning.plan(df, ["k"], "id", "t", 10**9).collect()}
    last = None
    for _, k, at, _ in rows:
        last = at if last is None else max(at, last + planning.GUARD)
        assert got[k] == last
    got = {r.id: (r.slot, r.planned) for r in planning.plan_slots(df, ["k"], "id", "t", 4, 10**6, 10**9).collect()}
    free = {}
    for n, (_, k, at, length) in enumerate(rows):
        start = max(at, free.get(n % 4, at))
        assert got[k] == (n % 4, start)
        free[n % 4] = start + length - 10**6
    old = table(spark, [("k", 1, 100, 50), ("k", 2, 990, 300), ("k", 3, 1200, 10)], "k string, id long, planned long, length long")
    assert {(r.epoch, r.id, r.planned, r.length) for r in planning.replan(old, old.withColumn("planned", F.col("planned") + 40), "id", 900, 100, 7).collect()} == {(0, 1, 100, 50), (0, 2, 990, 24), (1, 2, 1030, 300), (1, 3, 1240, 10)}


def test_matched_pool_against_a_loop(spark):
    rng = np.random.default_rng(7)
    rows = [(g, k, float(v)) for g in "ab" for k, v in enumerate(rng.integers(0, 30, 40))] + [("c", 1, 5.0)]
    want = set()
    for g in "abc":
        own = sorted((v, k) for h, k, v in rows if h == g)
        values, taken = np.array([v for v, _ in own]), []
        for pick in range(min(6, len(own))):
            q = np.quantile(values, (pick + 0.5) / 6)
            taken.append(min((abs(v - q), v, k) for v, k in own if k not in taken)[2])
            want.add((g, pick, taken[-1]))
    assert {tuple(r) for r in planning.matched_pool(table(spark, rows, "g string, id long, v double"), ["g"], "id", "v", 6).collect()} == want


def test_quantiles_and_runs_of_a_hot_key(spark):
    rng = np.random.default_rng(9)
    rows = [("hot", k, float(v)) for k, v in enumerate(rng.integers(0, 50, 3000))] + [("cold", k, float(k)) for k in range(3)]
    df = table(spark, rows, "g string, id long, v double").repartition(5)
    got = {r.g: (r.a, r.b) for r in stats.quantiles(df, ["g"], "v", "id", {"a": 0.1, "b": 0.77}).collect()}
    for g in ("hot", "cold"):
        values = [v for h, _, v in rows if h == g]
        assert got[g] == pytest.approx((np.quantile(values, 0.1), np.quantile(values, 0.77)))
    runs = lambda r: sorted((x.g, x["first"], x["last"], x.n, x.closed) for x in r.collect())
    assert runs(spread.runs(df, ["g"], ["id"], F.col("id"), 100, F.col("v") > 20)) == runs(sequences.runs(df, ["g"], ["id"], F.col("v") > 20))


def test_exponential_average_against_the_recursion(spark):
    values = np.random.default_rng(2).standard_normal(900)
    df = table(spark, [("k", k, float(v)) for k, v in enumerate(values)], "k string, n long, v double")
    got = {r.n: r.ema for r in sequences.exponential_average(df, ["k"], ["n"], "v", 0.2, F.col("n"), 100).collect()}
    s = None
    for k, v in enumerate(values):
        s = v if s is None else s + 0.2 * (v - s)
        assert got[k] == pytest.approx(s, abs=1e-12)


def test_hysteresis_and_correction():
    import pandas as pd

    at = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:10", "2024-01-01 00:20", "2024-01-01 03:00"])
    rows = pd.DataFrame({"at": at, "event_id": range(4), "event_type": ["error", "error", "error", "view"], "value": [0.0] * 4})
    whole, _ = stateful.hysteresis(rows, None)
    assert whole.values.tolist() == [[2, "degraded"], [3, "running"]]
    first, state = stateful.hysteresis(rows[:2], None)
    rest, _ = stateful.hysteresis(rows[2:], state)
    assert pd.concat([first, rest]).values.tolist() == whole.values.tolist()
    trims, _ = stateful.correction(rows, None)
    assert trims["trim"].tolist() == [1.0, 2.0, 3.0, 4.0]


def test_stateful_stream_goes_on_from_batch_to_batch(spark, tmp_path):
    events = table(spark, [(k, 1, "error" if k < 3 else "view", 0.0, f"2024-01-01 0{k}:00:00") for k in range(4)], "event_id long, user_id long, event_type string, value double, s string")
    events = events.withColumn("ts", F.to_timestamp_ntz("s")).drop("s")
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = stateful.drained(stateful.stateful(stateful.event_stream(spark, str(tmp_path / "events.parquet")), "user_id", stateful.correction, "user_id long, event_id long, trim double", "value double, sign int, swings int"), "t", "append")
    assert sorted(r.trim for r in rows.collect()) == [1.0, 2.0, 3.0, 4.0]


def test_kernels_on_known_signals():
    t = np.arange(signal.RATE * 2) / signal.RATE
    tone = 0.1 * np.sin(2 * np.pi * 200 * t)
    pitch = signal.pitches(tone)
    assert np.median(pitch[pitch > 0]) == pytest.approx(200, rel=0.02)
    assert signal.levels(tone).mean() == pytest.approx(10 * np.log10(0.005), abs=0.1)
    loudest = signal.BANDS[int(np.argmax(signal.band_powers(tone)))]
    assert loudest == 23
    gated = tone * (np.arange(len(t)) % (signal.RATE // 2) < signal.RATE // 4)
    level, share = signal.active_level(gated)
    assert share == pytest.approx(0.5, abs=0.2)
    wobble = 10 * np.log10((1 + 0.5 * np.sin(2 * np.pi * 4 * np.arange(1000) / 100)) ** 2)
    cuts = np.geomspace(0.5, 16, 17)
    best = int(np.argmax(signal.modulation(wobble)))
    assert cuts[best] <= 4.1 and cuts[best + 1] >= 3.9


def test_synthetic_recordings_depend_on_their_numbers_only(spark):
    a = signal.synthetic_corpus(spark, 2, 2, 2.0, 1).orderBy("speaker", "recording").toPandas()
    b = signal.synthetic_corpus(spark, 3, 2, 2.0, 1).where("speaker < 2").orderBy("speaker", "recording").toPandas()
    assert all(np.array_equal(x, y) for x, y in zip(a["samples"], b["samples"], strict=True))


def searched(texts, ask, least=2, best=8):
    """Every vote of every pair by plain Python, and the best few alignments of each text that asks."""
    want = set()
    grams = {k: [tuple(w[i : i + 4]) for i in range(len(w) - 3)] for k, t in texts.items() for w in (t.split(),)}
    for a in filter(ask, texts):
        votes = Counter((b, pb - pa) for pa, x in enumerate(grams[a]) for b in texts if b != a for pb in range(0, len(grams[b]), 4) if grams[b][pb] == x)
        rows = sorted((-n, b, shift) for (b, shift), n in votes.items() if n >= least)[:best]
        want |= {(a, b, shift, -n, k + 1) for k, (n, b, shift) in enumerate(rows)}
    return want


@pytest.mark.parametrize("sizes", [{}, {"asked": (40, 3), "indexed": (30, 5), "laid": 7}])
def test_search_by_cells(spark, sizes):
    """Copies, one word over and over, few words, and no texts: the same whatever a task's share is."""
    rng = random.Random(3)
    texts = {k: " ".join(rng.choice("abc") for _ in range(rng.choice([2, 4, 9, 30]))) for k in range(40)}
    texts |= {40: texts[3], 41: texts[3], 42: "a " * 40, 43: "a " * 25, 44: "a " * 40, 45: "", 46: "\u00a0"}
    docs = table(spark, [*texts.items(), (47, None)], "doc_id long, text string")
    got = fingerprints.search(docs, F.col("doc_id") % 3 == 0, **sizes)
    assert {(r.a, r.b, r["shift"], r.votes, r["rank"]) for r in got.collect()} == searched(texts, lambda k: k % 3 == 0)
    assert fingerprints.search(docs.where("doc_id > 44"), F.col("doc_id") % 3 == 0, **sizes).isEmpty()
    assert fingerprints.search(docs, F.lit(False), **sizes).isEmpty()


def test_search_ties_with_a_copy(spark):
    """A text's own class has nine alignments as good as those with a text between it and its copy."""
    texts = {0: "w " * 40, 1: "w " * 37, 2: "w " * 36, 3: "w " * 35, 4: "w  " * 40, 5: "x y z " * 20, 6: "x y z " * 19, 7: "x y z  " * 20}
    for ask in (lambda k: k == 0, lambda k: k < 8):
        got = fingerprints.search(table(spark, [*texts.items()], "doc_id long, text string"), F.col("doc_id").isin([k for k in texts if ask(k)]))
        assert {(r.a, r.b, r["shift"], r.votes, r["rank"]) for r in got.collect()} == searched(texts, ask)


def most_rows(df):
    """The most rows that any node of a plan has made."""
    df.collect()
    left, most = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            children, rows = node.children(), node.metrics().get("numOutputRows")
            left += [children.apply(k) for k in range(children.size())]
            most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


def test_search_frequent_grams(spark):
    """Texts that share a line: their pairs are as many as the square of their number, and no step gives them all out."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.col("id"), F.lit(" x y z one two three four five six seven eight nine ten")).alias("text"))
    found = fingerprints.search(docs, F.col("doc_id") % 2 == 0)
    assert most_rows(found) < 400 * 200 // 2
    assert {(r.b, r.rank) for r in found.where("a = 0").collect()} == {(k, k) for k in range(1, 9)}


def test_near_duplicates_hash_once(spark, monkeypatch):
    """Runs of words are hashed where their text has come, not for a filter before it travels as well."""
    plans, real = [], fingerprints.kept
    monkeypatch.setattr(fingerprints, "kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k"), (3, "x y"), (4, "")]
    got = fingerprints.near_duplicates(table(spark, rows, "doc_id long, text string"))
    assert {r.doc_id: r.accepted for r in got.collect()} == {1: True, 2: False, 3: True, 4: True}
    assert any("xxhash64" in p for p in plans)
    assert not [line for p in plans for line in p.split("\n") if "Filter" in line and "xxhash64" in line]
