"""The Jaccard join and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import jaccard_join, suffix_dedup
from parlance.llm.components import components


def shingles(t):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def linked_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(sets[i]), least.get(top(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_join_on_odd_documents(odd_docs, odd_rows):
    got = jaccard_join.jaccard_components(odd_docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_groups([r[:2] for r in odd_rows])


def test_join_of_nothing(no_docs):
    assert jaccard_join.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("part", [4096, 7])
def test_join_of_large_groups(spark, monkeypatch, part):
    """Groups over SMALL_TILE whose copies are near their base and not each other, and a passage that all texts quote."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    quoted = [word() for _ in range(30)]
    rows = []
    for g in range(3):
        base = [word() for _ in range(120)]
        for _ in range(25):
            t = list(base)
            for at in rng.sample(range(120), 2 + g):
                t[at] = word()
            rows.append(" ".join(t))
    rows += [" ".join(quoted + [word() for _ in range(rng.randint(5, 60))]) for _ in range(40)]
    rows = list(enumerate(rows))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_groups(rows)


def test_hot_group_makes_few_pairs(spark, monkeypatch):
    """A group twice as large has about twice the pairs, not four times."""
    made = []
    links = jaccard_join._Join.links

    def counted(self, pairs):
        pairs = self.scratch.table(pairs, "seen")
        made[-1] += pairs.count()
        return links(self, pairs)

    monkeypatch.setattr(jaccard_join._Join, "links", counted)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(80)]
    for size in (60, 120):
        rows = []
        for k in range(size):
            t = list(base)
            t[rng.randrange(80)] = word()
            rows.append((k, " ".join(t)))
        made.append(0)
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_groups(rows)
    assert made[1] < 3 * made[0]


def test_join_over_many_portions(odd_docs, odd_rows):
    """Copies, near copies and passages in portions of different tasks."""
    got = jaccard_join.jaccard_components(odd_docs.repartition(9)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked_groups([r[:2] for r in odd_rows])


def test_join_of_more_sets_than_a_portion_numbers(spark, tmp_path):
    """One file, read as one partition: a long text, then 39,000 linked pairs of 14 words, whose sets pass 16 bits."""
    pair = lambda k: [" ".join(f"w{k}x{j}" for j in range(14)) + end for end in ("", f" y{k}")]
    texts = [" ".join(f"l{j}" for j in range(1_060_000)), *(t for k in range(39_000) for t in pair(k))]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "docs.parquet")
    docs = spark.read.parquet(str(tmp_path / "docs.parquet")).coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {0: 0} | {1 + k: 1 + k - k % 2 for k in range(78_000)}


def test_bit_counts_bound_overlap_from_above():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(2))
        width = min(len(jaccard_join.bitmap(a)), len(jaccard_join.bitmap(b))) * 8
        bound = jaccard_join.overlap_bound(jaccard_join.fold(jaccard_join.bitmap(a), width), jaccard_join.fold(jaccard_join.bitmap(b), width), len(a), len(b))
        assert bound >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], [(k, k + 1) for k in range(40)] + [(100, k) for k in range(50, 60)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert got == {x: c for x, c in label.items() if x != c}


def removed(rows, length=100):
    """(doc_id, text) to what is left, by looking at every string of the corpus in order."""
    signed = lambda t: (h := xxhash.xxh64((t or "").encode(), seed=42).intdigest()) - (h >> 63 << 64)
    place = lambda r: (r[0] is None, r[0] or 0, signed(r[1]))
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=place):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p : p + length], (d, t, p)) != (d, t, p):
                gone[p : p + length] = b"\1" * length
        out[d, t] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return Counter((d, *out[d, t]) for d, t in rows)


def test_dedup_on_odd_documents(odd_docs, odd_rows):
    got = suffix_dedup.removal_digests(odd_docs).collect()
    assert Counter(tuple(r) for r in got) == removed([r[:2] for r in odd_rows])


def test_dedup_of_nothing_and_columns(no_docs, odd_docs):
    assert suffix_dedup.removal_digests(no_docs).count() == 0
    assert suffix_dedup.remove_repeats(odd_docs).columns == odd_docs.columns


def test_dedup_in_small_portions(spark, monkeypatch):
    rng = random.Random(2)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(40, 260))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for k in range(60)]
    monkeypatch.setattr(suffix_dedup, "ANCHORS", 50)
    monkeypatch.setattr(suffix_dedup, "BYTES", 2000)
    got = suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == removed(rows)


def test_dedup_with_colliding_hashes(monkeypatch):
    """Hashes of three bits: strings are removed for their bytes, never for their hash."""
    rng = random.Random(7)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(90, 150))) for _ in range(6)]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))) for k in range(20)]
    weak = suffix_dedup.window_hashes
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda data, n: weak(data, n) & np.uint64(7))
    raw = [t.encode() for _, t in rows]
    start = [np.arange(len(t) - 99) for t in raw]
    cols = [np.zeros(len(raw), np.uint64), np.arange(len(raw)), np.arange(len(raw)), np.zeros(len(raw), np.int32), np.array([len(x) for x in start])]
    (doc, _, at), _ = suffix_dedup._Portion(cols, np.frombuffer(b"".join(raw), np.uint8)).settle()
    seen, want = set(), set()
    for k, t in enumerate(raw):
        for p in range(len(t) - 99):
            (want if t[p : p + 100] in seen else set()).add((k, p))
            seen.add(t[p : p + 100])
    assert set(zip(doc.tolist(), at.tolist(), strict=True)) == want


def test_factors_in_any_order_of_equal_strings():
    rng = np.random.default_rng(2)
    for _ in range(50):
        names = np.sort(rng.integers(0, 8, 40))
        order = rng.permutation(40)
        same = np.r_[False, names[1:] == names[:-1]]
        want = [any(order[j] < order[i] for j in np.flatnonzero(names == names[i])) for i in range(40)]
        assert suffix_dedup.factors(order, same).tolist() == want


def test_dedup_with_clashing_columns(odd_docs):
    clash = odd_docs.withColumns({c: F.lit(7) for c in ("copy__", "runs__", "doc__", "cid__", "copied__")})
    got = suffix_dedup.remove_repeats(clash)
    assert got.columns == clash.columns and got.agg(F.sum("copy__")).first()[0] == 7 * odd_docs.count()


def test_cut_keeps_whole_code_points(spark):
    passage = "".join(chr(0x100 + k) for k in range(60))
    # The matches begin in the middle of the second text's first accented letter.
    rows = [(0, "\u0100" + passage), (1, "a\u0140" + passage + "b"), (2, None)]
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "\u0100" + passage, 1: "ab", 2: None}
