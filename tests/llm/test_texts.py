"""The language model, fingerprints, packing, mixing, chats and search against brute force and exact round trips."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import chat_format, jaccard_join, mixing, ngram_lm, order_minhash, packing, text, vp_search


def tokens(t):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), 1]


def kneser_ney(train):
    uni, pairs, after = Counter(), Counter(), Counter()
    for s in train:
        for u, w in zip([0, *s], s, strict=False):
            uni[w] += 1
            pairs[u, w] += 1
            after[u] += 1
    follows, kinds = Counter(w for _, w in pairs), defaultdict(Counter)
    for (u, _), c in pairs.items():
        kinds[u][min(c, 3)] += 1
    counts = lambda c: ngram_lm.discounts([Counter(c.values())[k] for k in (1, 2, 3, 4)])
    d, e = counts(pairs), counts(follows)
    rest = sum(e[min(c, 3)] for c in follows.values()) / max(len(pairs), 1) if pairs else 1.0

    def single(w):
        return max(follows[w] - e[min(follows[w], 3)], 0) / max(len(pairs), 1) + rest / (len(uni) + 1)

    def p(u, w):
        if not after[u]:
            return single(w)
        return max(pairs[u, w] - d[min(pairs[u, w], 3)], 0) / after[u] + sum(d[k] * kinds[u][k] for k in (1, 2, 3)) / after[u] * single(w)

    return uni, p


def test_model_on_odd_documents(odd_docs, odd_rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    uni, p = kneser_ney([tokens(t) for d, t, *_ in odd_rows if not held(d)])
    n, v = sum(uni.values()), len(uni)
    want = Counter()
    for d, t, *_ in odd_rows:
        s = tokens(t)
        score = sum(math.log10(p(u, w)) for u, w in zip([0, *s], s, strict=False))
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s)
        want[d, held(d), len(s), sum(uni[w] > 0 for w in s), n, round(base, 5), round(score, 5)] += 1
    got = ngram_lm.lm_scores(odd_docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


def test_probabilities_add_up():
    uni, p = kneser_ney([tokens("a b a b c"), tokens("a c c"), tokens("d")])
    for u in (0, b"a", b"nothing"):
        assert sum(p(u, w) for w in uni) + p(u, b"unknown") == pytest.approx(1)


def test_model_of_nothing(no_docs, spark):
    assert ngram_lm.lm_scores(no_docs).count() == 0
    only_held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = ngram_lm.lm_scores(spark.createDataFrame([(k, "a b") for k in only_held], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in got] == [(0, 0, 0.0)] * 3


def test_counts_over_255(spark):
    rows = [(k, "the the") for k in range(700)]
    uni, p = kneser_ney([tokens(t) for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2])
    s = tokens("the the")
    want = sum(math.log10(p(u, w)) for u, w in zip([0, *s], s, strict=False))
    got = ngram_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.score == pytest.approx(want) for r in got)


def test_fingerprints_on_odd_documents(odd_docs, odd_rows):
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, r in enumerate(rows):
        own, following = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        change = order_minhash.edited(own, following)
        fp = [order_minhash.fingerprint(x) for x in (own, change, following)]
        want[r[0], len(own), hashlib.sha256(change.encode()).hexdigest(), order_minhash.likeness(fp[0], fp[1]), order_minhash.likeness(fp[0], fp[2])] += 1
    got = order_minhash.fingerprints(odd_docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == want
    same = defaultdict(set)
    for r, o in ((r, o) for r in got for o in odd_rows if r.doc_id == o[0] and r.n_chars == len(o[1] or "")):
        same[o[1] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for t, x in same.items() if len(t) > 200)


def plain_fingerprint(s):
    """The definition word for word, with dictionaries and Python's integers."""
    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    seen, values = Counter(), []
    for k in range(max(1, len(s) - 7)):
        h = 0
        for c in s[k : k + 8]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & top
        h = mix(h)
        values.append(mix((h + seen[h] * 0xD1342543DE82EF95) & top))
        seen[h] += 1
    out = []
    for c in range(64 if s else 0):
        first = sorted(range(len(values)), key=lambda k: (values[k] - (c << 58)) % (1 << 64))[:2]
        h = len(first)
        for k in sorted(first):
            h = mix((h * 0xA0761D6478BD642F + values[k]) & top)
        out.append(max(h, 1))
    return out or [0] * 64


def test_fingerprints_against_the_definition(odd_rows):
    texts = {t or "" for _, t, *_ in odd_rows if len(t or "") < 5000} | {"abcabcabcabc" * 30, "a" * 200, "abcdefgh", "abcdefghi"}
    for t in texts:
        assert order_minhash.fingerprint(t).tolist() == plain_fingerprint(t)


def test_long_texts_sort_places_apart(monkeypatch):
    texts = ["".join(np.random.default_rng(k).choice(list("ab"), 3000)) for k in range(3)]
    want = [order_minhash.fingerprint(t).tolist() for t in texts]
    monkeypatch.setattr(order_minhash, "PLACE_BITS", 4)
    assert [order_minhash.fingerprint(t).tolist() for t in texts] == want


def permuted_likeness(a, b, components=400):
    """Order MinHash with a permutation of all numbered k-mers for each component."""
    def tuples(s):
        seen, numbered = Counter(), []
        for k in range(len(s) - 7):
            g = s[k : k + 8]
            numbered.append((g, seen[g]))
            seen[g] += 1
        keys = [int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "big") for x in numbered]
        values = np.array(keys, np.uint64)
        for c in range(components):
            first = np.sort(np.argsort(text.mix(values ^ np.uint64(c * 0x9E3779B97F4A7C15 % (1 << 64))))[:2])
            yield tuple(numbered[k] for k in first)

    return np.mean([x == y for x, y in zip(tuples(a), tuples(b), strict=True)])


def test_one_value_agrees_with_a_permutation_each():
    """Within 0.2 for each pair (64 components have a deviation of 0.06 at most) and 0.05 on average."""
    rng = np.random.default_rng(8)
    off = []
    for n in (300, 1500):
        for share in (0.02, 0.1, 0.3):
            for move in (False, True):
                a = "".join(rng.choice(list("abcdefghijklmnop "), n))
                at = int(n * share)
                b = a[at:] + a[:at] if move else a[:-at] + "".join(rng.choice(list("qrstuvwxyz"), at))
                off.append(order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b)) - permuted_likeness(a, b))
    assert np.abs(off).max() < 0.2 and abs(np.mean(off)) < 0.05


def test_moved_block_in_a_short_text():
    rng = np.random.default_rng(3)
    moved, kept = [], []
    for _ in range(40):
        s = "".join(rng.choice(list("abcdefghijklmnop"), 60))
        fp = order_minhash.fingerprint(s)
        grams = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
        turned = s[30:] + s[:30]
        moved.append(order_minhash.likeness(fp, order_minhash.fingerprint(turned)))
        kept.append(len(grams(s) & grams(turned)) / len(grams(s) | grams(turned)))
    # Shared k-mers alone would say three quarters; half of the pairs change their order.
    assert np.mean(kept) > 0.7 and np.mean(moved) < 0.5


def test_fingerprints_of_nothing_and_one(no_docs, spark):
    assert order_minhash.fingerprints(no_docs).count() == 0
    one = order_minhash.fingerprints(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_likeness_follows_edit_distance():
    rng = np.random.default_rng(4)
    s = "".join(rng.choice(list("abcdefghijklmnop"), 4000))
    near = [order_minhash.likeness(order_minhash.fingerprint(s), order_minhash.fingerprint(s[:-k] + "".join(rng.choice(list("qrstuvwxyz"), k)))) for k in (40, 400, 2000, 3999)]
    assert near == sorted(near, reverse=True) and near[0] > 0.8 and near[-1] < 0.05
    swapped = s[2000:] + s[:2000]
    assert order_minhash.likeness(order_minhash.fingerprint(s), order_minhash.fingerprint(swapped)) < 0.8


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_packing_on_odd_documents(odd_docs, odd_rows, no_docs):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(VOCABULARY), Counter()
    for d, t, *_ in odd_rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    got = packing.pack_documents(odd_docs, VOCABULARY).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == packing.lower_bound(np.array([r.length for r in got]))
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


def test_partitions_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 100)
    monkeypatch.setattr(packing, "POOL", 3)
    lengths = np.random.default_rng(3).integers(1, 2049, 1500).tolist()
    rows = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(rows).toPandas()
    assert len(got) == 1500 and got.groupby("sequence_id")["length"].sum().max() <= 2048
    # A certified partition is final: it can be one bin above its share of the whole, and here there are 15 of them.
    assert got["sequence_id"].nunique() <= packing.lower_bound(np.array(lengths)) * 1.03 + 2 + 15
    assert (got.groupby("sequence_id")["certified"].nunique() == 1).all() and (got["bins"] >= got["bound"]).all()


def test_the_certificate_decides_who_exchanges(spark, monkeypatch):
    import pandas as pd

    rows = lambda lengths: pd.DataFrame({"part": 0, "doc_id": range(len(lengths)), "piece": 0, "start": 0, "length": lengths, "ids_crc32": 0})
    tight = packing._pack(2048, 48)(rows([1024] * 7 + [100]))
    assert tight["certified"].all() and not tight["given"].any() and set(tight["bins"]) == set(tight["bound"]) == {4}
    for lengths in np.random.default_rng(5).integers(2, 9, (200, 12)).tolist():
        got = packing._pack(10, 48)(rows(lengths))
        assert got["certified"].all() == (got["bins"].iloc[0] == got["bound"].iloc[0]) and got["given"].any() <= (not got["certified"].any())
    # Partitions that are all certified end after the first level.
    monkeypatch.setattr(packing, "PIECES", 50)
    full = spark.createDataFrame([(k, 0, 0, 1024, 0) for k in range(400)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(full).toPandas()
    levels = got.assign(level=got["sequence_id"] // (1 << 54), part=(got["sequence_id"] // (1 << 20)) % (1 << 34))
    assert got["certified"].all() and set(levels["level"]) == {0} and levels["part"].nunique() == 8


def test_equal_rows_are_dealt_to_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 500)
    same = spark.createDataFrame([(None, 0, 0, 1500, 7)] * 4000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(same).toPandas()
    parts = (got["sequence_id"] // (1 << 20)) % (1 << 34)
    assert parts.nunique() == 8 and parts.value_counts().max() < 700 and got["sequence_id"].nunique() == 4000


def test_bounds_never_exceed_what_fits():
    rng = np.random.default_rng(9)
    for _ in range(40):
        lengths = rng.integers(1, 65, rng.integers(1, 60))
        assert packing.lower_bound(lengths, 64) <= len(packing.best_fit(lengths, 64)[2])
    assert packing.lower_bound(np.array([33, 33, 33]), 64) == 3


def test_mixing_on_odd_documents(odd_docs, odd_rows, no_docs):
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    totals = Counter()
    for r in odd_rows:
        totals[r[3]] += size(r[1])
    names = sorted(totals, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(totals.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * totals[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * totals[s] for s in over}
        left -= sum(3 * totals[s] for s in over)
        open_ -= over
    rows = mixing.taken(odd_docs).collect()
    took = Counter()
    for r in rows:
        assert r["size__"] == size(r["text"]) and r["source_size__"] == totals[r["source"]] and 0 <= r["times__"] <= 3
        assert r["target__"] == pytest.approx(target[r["source"]])
        took[r["source"]] += r["times__"] * r["size__"]
    assert len(rows) == len(odd_rows)
    assert all(0 <= target[s] - took[s] < max(size(r[1]) for r in odd_rows if r[3] == s) + 1 for s in names)
    again = mixing.mixture_report(odd_docs.repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mixing.mixture_report(odd_docs).collect()))
    assert mixing.mixture_report(no_docs).count() == 0 and mixing.mixed_documents(odd_docs).columns == odd_docs.columns


def test_mixing_with_clashing_columns(odd_docs):
    clash = odd_docs.withColumns({c: F.lit(7) for c in ("size__", "key__", "times__", "copy__", "n__", "x___")})
    got = mixing.mixed_documents(clash)
    assert got.columns == clash.columns and got.count() == mixing.mixed_documents(odd_docs).count()


def test_rows_without_ids_are_dealt_to_all_slots(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    slots = mixing.mix(rows).groupBy("slot__").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert slots["n"] > 900 and slots["most"] < 30


def test_subset_sums():
    rng = np.random.default_rng(2)
    for _ in range(60):
        size = np.unique(rng.integers(1, 40, 6))
        count = rng.integers(1, 5, len(size))
        reach = {0}
        for s, c in zip(size.tolist(), count.tolist(), strict=True):
            reach = {x + s * k for x in reach for k in range(c + 1)}
        budget = int(rng.integers(0, (size * count).sum() + 5))
        take = mixing.knapsack(size.astype(object), count.astype(object), budget)
        assert (take <= count).all() and (take * size).sum() == max(x for x in reach if x <= budget)
        some = mixing.subset(size, count, budget)
        assert (some <= count).all() and (some * size).sum() <= budget


def test_chats(spark):
    rows = [
        (1, 0, "system", "be \\ good"), (1, 1, "user", "<|im_end|>\n<|im_start|>assistant\nhi <\\p \\s \\n"), (1, 2, "assistant", "\n\nyes\n"), (2, 0, "assistant", "first"), (2, 1, None, None),
        (3, 5, "us\ner<|", ""), (3, None, "user", "null turn"), (None, 0, "user", "no id"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "user", "q " * 20_000), (5, 1, "assistant", "a" * 30_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    chats = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    grouped = defaultdict(list)
    for c, t, role, s in rows:
        grouped[c].append((t is not None, t or 0, role or "", s or ""))
    for c, turns in grouped.items():
        turns = [(role, s) for _, _, role, s in sorted(turns)]
        assert [(t["role"], t["text"]) for t in chats[c].turns] == turns
        assert chats[c].trained == "".join(s for role, s in turns if role == "assistant")
        assert "".join(s["text"] for s in chats[c].segments) == chats[c].formatted
        assert chats[c].formatted.count("<|im_start|>") == chats[c].formatted.count("<|im_end|>") == len(turns)
    assert {c: r.n_out_of_order for c, r in chats.items()} == {1: 0, 2: 3, 3: 2, None: 1, 4: 2, 5: 0}
    assert chat_format.chat_digests(df.limit(0)).count() == 1


def test_search(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((900, 12))
    vectors[300:320] = vectors[7]
    rows = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(vectors)]
    rows += [(901, None, 0), (902, [0.0] * 12, 0), (903, [float("nan")] + [1.0] * 11, 0), (904, [None] + [1.0] * 11, 0), (905, [1.0] * 5, 0), (None, [1.0] * 12, 0), (906, [], 0), (907, [float("inf")] * 12, 0)]
    rows += [(908, [1e200, 1e200, -1e200], 0), (950, [1e-200, 2e-200, 1e-200], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for size, factor in ((10_000, 1.0), (100, 1.0), (100, 1.3)):
        vp_search.SHARD, old = size, vp_search.SHARD
        got = vp_search.vector_neighbours(df, factor=factor).orderBy("query_id", "rank").collect()
        vp_search.SHARD = old
        found, hits = defaultdict(list), 0
        for r in got:
            found[r.query_id].append((r.vec_id, r.score))
        assert set(found) == {*range(0, 900, 50), 950}
        assert found.pop(950) == [(908, pytest.approx(2 / math.sqrt(18)))]
        for q, near in found.items():
            cos = unit @ unit[q]
            order = [k for k in np.lexsort((np.arange(900), -np.round(cos, 12))) if k != q][:5]
            hits += len({v for v, _ in near} & set(order))
            if factor == 1.0:
                assert [v for v, _ in near] == order and np.allclose([s for _, s in near], cos[order], atol=1e-12)
        assert hits >= 0.9 * 5 * len(found)
    assert vp_search.vector_neighbours(df.limit(0)).count() == 0


def test_search_with_ties(spark):
    """Every ninth vector is the same: ties go to the smaller vec_id, whatever place of a block a row has."""
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((2_003, 64))
    vectors[5::9] = vectors[5]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    for size in (8_192, 300):
        vp_search.SHARD, old = size, vp_search.SHARD
        got = vp_search.vector_neighbours(df).orderBy("query_id", "rank").collect()
        vp_search.SHARD = old
        found = defaultdict(list)
        for r in got:
            found[r.query_id].append((r.vec_id, r.score))
        for q in range(0, 2_003, 50):
            score = vp_search.cosine(np.broadcast_to(vectors[q], vectors.shape), vectors)
            order = [k for k in np.lexsort((np.arange(2_003), -score)) if k != q][:5]
            assert found[q] == [(k, score[k]) for k in order]


def test_discounts():
    assert ngram_lm.discounts([5, 4, 0, 1]).tolist() == [0, 0.5, 1, 1.5]
    y = 10 / (10 + 2 * 6)
    assert np.allclose(ngram_lm.discounts([10, 6, 4, 3]), [0, 1 - 2 * y * 6 / 10, 2 - 3 * y * 4 / 6, 3 - 4 * y * 3 / 4])


def test_words_that_collide_in_powers_of_two(spark):
    """Thue-Morse words and their complements, which every polynomial modulo 2^64 takes for equal."""
    pairs = [["".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n)) for flip in (0, 1)] for n in (1_024, 2_048, 4_096)]
    for a, b in pairs:
        data, offsets = text.buffer(pa.array([a, b]))
        assert len(set(text.words(data, offsets)[0].tolist())) == 2
        trained, scored = next(d for d in range(1_000) if zlib.crc32(str(d).encode()) % 7 != 2), next(d for d in range(1_000) if zlib.crc32(str(d).encode()) % 7 == 2)
        df = spark.createDataFrame([(trained, a), (scored, b)], "doc_id long, text string")
        assert {r.doc_id: r.n_known for r in ngram_lm.lm_scores(df).collect()} == {trained: 2, scored: 1}
        assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()} == {trained: trained, scored: scored}
        path = public_tokenizers.path("word_bpe_49k.json")
        tok = Tokenizer.from_file(path)
        want = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], np.uint32) for d, t in ((trained, a), (scored, b))}
        got = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pack_documents(df, path).collect()}
        assert got == {(d, j): zlib.crc32(x[s : s + 2048].tobytes()) for d, x in want.items() for j, s in enumerate(range(0, len(x), 2048))}


def test_spans_are_hashed_alike_wherever_they_stand(monkeypatch):
    raw = np.random.default_rng(0).integers(0, 256, 5_000).astype(np.uint8)
    data = np.r_[raw, np.zeros(77, np.uint8), raw, raw[:-1]]
    starts, ends = np.array([0, 5_077, 10_077, 4_000, 9_077]), np.array([5_000, 10_077, 15_076, 4_100, 9_177])
    one, two, other, *short = text.spans_hash(data, starts, ends).tolist()
    assert one == two != other and len(set(short)) == 1
    monkeypatch.setattr(text, "_EXACT", 10)
    assert text.spans_hash(data, starts, ends).tolist() == [one, two, other, *short]


def test_words_are_bytes_between_white_space():
    samples = ["", " a\tb ", "Ä b\x0bC\x0c", "x" * 5000, "a\x1cb \xa0", None]
    data, offsets = text.buffer(pa.array(samples))
    starts, ends = text.bounds(data, offsets)
    raw = data.tobytes()
    assert [raw[s:e] for s, e in zip(starts, ends, strict=True)] == [w for t in samples for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    hashes, cuts = text.words(data, offsets)
    assert len(set(hashes.tolist())) == len({w.lower() for t in samples for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())}) and np.diff(cuts).tolist() == [0, 2, 3, 1, 2, 0]
