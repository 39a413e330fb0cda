"""Vector codes, byte-level BPE and lexical search against brute force and the tokenizer's own library."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from parlance.llm import byte_bpe, lexical_search, vector_codes

# --- Vector codes ---


def coded(rows, length):
    """(vec_id, vector, label) rows to Counter of digests, a vector after the other."""
    keep = [r for r in rows if r[1] is not None and len(r[1]) == length and all(x is not None and math.isfinite(x) for x in r[1])]
    most = vector_codes.reach(length)
    whole = [[min(max(math.floor(1024 * x), -most), most) for x in r[1]] for r in keep]
    cut = [length * p // 4 for p in range(5)]
    order = sorted(range(len(keep)), key=lambda k: (keep[k][0] is None, keep[k][0] or 0, whole[k]))
    books = [[whole[k][cut[p] : cut[p + 1]] for k in order[:256]] for p in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            groups = defaultdict(list)
            for v in whole:
                groups[near(v[cut[p] : cut[p + 1]], books[p])[1]].append(v[cut[p] : cut[p + 1]])
            for j, own in groups.items():
                books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(v[cut[p] : cut[p + 1]], books[p]) for p in range(4)] for v in whole]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(keep, errors, strict=True):
        by_label[r[2]] += e
    return Counter((r[0], "".join(f"{j:02x}" for _, j in f), e, by_label[r[2]], sha) for r, f, e in zip(keep, found, errors, strict=True))


@pytest.mark.parametrize("length", [8, 10])
def test_vector_codes(spark, length):
    rng = np.random.default_rng(length)
    rows = [(k, [float(x) for x in rng.standard_normal(length)], int(k % 3) if k % 7 else None) for k in range(420)]
    rows += [(1000 + k, rows[5][1], 1) for k in range(200)]
    rows += [(None, rows[9][1], None), (7, rows[3][1], 0), (8, None, 0), (9, [None] * length, 0), (10, [float("nan")] * length, 1), (11, [float("inf")] * length, 1), (12, [1.0] * (length + 3), 2), (13, [], 2)]
    rows += [(14, [0.0] * length, 2), (14, [0.0] * length, 2), (15, [1e300] * length, 2), (16, [-1e300, *[1e7] * (length - 1)], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    assert Counter(tuple(r) for r in vector_codes.code_digests(df).collect()) == coded(rows, length)


def test_vector_codes_of_few_and_clashing(spark):
    df = spark.createDataFrame([(3, [0.5] * 8, 1), (1, [0.25] * 8, None)], "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(r) for r in vector_codes.code_digests(df).collect()) == coded([(3, [0.5] * 8, 1), (1, [0.25] * 8, None)], 8)
    assert vector_codes.code_digests(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit("x") for c in ("code", "part0__", "code0__", "error0__", "pos", "part")})
    got, books = vector_codes.compress(clash)
    assert set(got.columns) == {*clash.columns, "error"} and got.where("pos = 'x' and part0__ = 'x' and size(code) = 4").count() == 2
    assert [b.shape for b in books.books] == [(2, 2)] * 4


def test_distances_are_exact():
    rng = np.random.default_rng(0)
    for most in (1_000, 1 << 27):
        a, b = rng.integers(-most, most, (40, 16)), rng.integers(-most, most, (30, 16))
        assert vector_codes.distances(a, b).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for q in b] for p in a]


# --- Byte-level BPE ---

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def digest(library, text):
    ids = np.array(library.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_coding_of_odd_documents(odd_docs, odd_rows, library):
    got = byte_bpe.coding_digests(odd_docs, RANKS).collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *digest(library, r[1])) for r in odd_rows)


def test_coding_of_long_words_and_nothing(spark, library, no_docs):
    rng = random.Random(2)
    texts = ["a" * 30_000, " " * 5_000 + "x", "\n" * 3_000, "".join(rng.choice("etaoin") for _ in range(20_000)), "文字" * 2_000, "x" * 1_024, "y" * 1_025, "'s't're'll 'd\n'm''s", "𝒳" * 300 + "\u0085 ", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = byte_bpe.coding_digests(df, RANKS).collect()
    assert Counter(tuple(r) for r in got) == Counter((k, *digest(library, t)) for k, t in enumerate(texts))
    assert byte_bpe.coding_digests(no_docs, RANKS).count() == 0


def test_coding_keeps_columns(odd_docs):
    coded_docs = byte_bpe.encode(odd_docs.withColumn("ids", F.lit(1)), RANKS)
    assert coded_docs.columns == [*(c for c in odd_docs.columns if c != "text"), "ids"]
    back = byte_bpe.decode(coded_docs, RANKS, out="text")
    want = Counter((r.doc_id, r.n, r.text or "") for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n, bytes(r.text).decode()) for r in back.collect()) == want


def test_words_that_share_a_hash_are_noticed(spark, library, monkeypatch):
    """Hashes of six bits in the driver's process: looked-up ids that don't decode to the word aren't taken."""
    docs = ["the cat and the dog and other words of a text", "some more"]
    raw, edges = "".join(docs).encode(), np.cumsum([0, *map(len, docs)])
    vocabulary = byte_bpe.Vocabulary(byte_bpe.load_ranks(RANKS))

    class Wrong:
        def find(self, hashes):
            return np.tile(np.array([1, 5, 262], np.uint32), len(hashes))[: len(hashes)], np.ones(len(hashes), np.int64)

    ids, cuts = byte_bpe._ids_of(raw, edges, Wrong(), vocabulary)
    assert [ids[s:e].tolist() for s, e in zip(cuts[:-1], cuts[1:], strict=True)] == [library.encode_ordinary(t) for t in docs]


def test_words_of_a_text(monkeypatch):
    rng, alphabet = random.Random(0), list("aZé9 \n\t'srtvmdel.,! 　中١ⅷ́😀\x85\x1c​'  ")
    for _ in range(600):
        docs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        raws = [d.encode() for d in docs]
        starts, ends = byte_bpe.words(b"".join(raws), np.cumsum([0, *map(len, raws)]))
        want = [w.encode() for d in docs for w in byte_bpe.regex.findall(public_tokenizers.PATTERN, d)]
        assert [b"".join(raws)[s:e] for s, e in zip(starts, ends, strict=True)] == want


def test_long_texts_come_in_blocks(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "BLOCK", 50)
    rng = random.Random(1)
    docs = ["".join(rng.choice("ab  \n\n'st.é") for _ in range(n)) for n in (0, 30, 900, 5, 400)]
    got: list[list] = [[] for _ in docs]
    vocabulary = byte_bpe.Vocabulary(byte_bpe.load_ranks(RANKS))

    class Empty:
        def find(self, hashes):
            return np.zeros(0, np.uint32), np.zeros(len(hashes), np.int64)

    blocks = [*byte_bpe._blocks(pa.record_batch({"text": docs}), "text")]
    assert len(blocks) > 10
    for raw, edges, rows in blocks:
        ids, cuts = byte_bpe._ids_of(raw, edges, Empty(), vocabulary)
        for row, s, e in zip(rows, cuts[:-1], cuts[1:], strict=True):
            got[row] += ids[s:e].tolist()
    assert got == [library.encode_ordinary(t) for t in docs]


# --- Lexical search ---

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def term_list(t):
    return _TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def ranked(docs, items, k=50):
    """(doc_id, text) and (item_id, text) rows to the best documents of each item, every document against every item."""
    bags = [(d, Counter(term_list(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= {*term_list(t)}
    out = []
    for i, own in asked.items():
        found = []
        for d, bag, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in own if t in bag)
            if score > 0:
                found.append((-score, d is None, d or 0))
        found.sort()
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(found[:k])]
    return Counter(out)


def test_search_of_odd_documents(spark, odd_docs, odd_rows):
    items = [(k, t) for k, t in enumerate(["ab cd", "", None, odd_rows[0][1], "é" * 150, "x" * 100, "one ONE One", "nothing-here zzz"])] + [(None, "one"), (6, "spam")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(odd_docs, df).collect()
    assert Counter(tuple(r) for r in got) == ranked([r[:2] for r in odd_rows], items)


def test_search_in_small_shards_and_query_blocks(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(vocabulary[min(299, int(rng.expovariate(0.02)))] for _ in range(rng.randint(0, 60)))) for k in range(3_000)]
    docs += [(5_000 + k, docs[7][1]) for k in range(400)]
    items = [(k, " ".join(rng.sample(vocabulary, rng.randint(1, 12)))) for k in range(30)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = ranked(docs, items)
    assert Counter(tuple(r) for r in lexical_search.search(df, asked).collect()) == want
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 400)
    assert Counter(tuple(r) for r in lexical_search.search(df, asked).collect()) == want
    assert lexical_search.search(df.limit(0), asked).count() == lexical_search.search(df, asked.limit(0)).count() == 0


def test_shards_skip_and_stay_exact():
    rng = np.random.default_rng(3)
    n_docs, n_terms = 6_000, 40
    held = [np.flatnonzero(rng.random(n_docs) < 0.5 ** (1 + t / 5)) for t in range(n_terms)]
    term, place = np.repeat(np.arange(n_terms), [len(x) for x in held]), np.concatenate(held)
    value = rng.integers(1, 9, len(place)) ** 4
    shard = lexical_search.Shard(np.arange(n_docs)[::-1].copy(), np.ones(n_docs, bool), term, place, value, n_terms)
    for _ in range(20):
        own = np.sort(rng.choice(n_terms, 6, replace=False))
        weights = rng.integers(0, 5_000, 6)
        total = np.zeros(n_docs, np.int64)
        for t, w in zip(own, weights, strict=True):
            total[held[t]] += value[term == t] * w
        order = [k for k in np.lexsort((shard.doc, -total)) if total[k] > 0][:50]
        best, score = shard.search(own, weights, 50)
        assert best.tolist() == order and score.tolist() == total[order].tolist()


def test_blocks_have_least_error():
    rng = np.random.default_rng(5)

    def least(place, value, longest):
        cost, best = lexical_search.COST * max(value), [0.0] + [math.inf] * len(place)
        for j in range(1, len(place) + 1):
            for i in range(max(0, j - longest), j):
                best[j] = min(best[j], best[i] + (place[j - 1] - place[i] + 1) * max(value[i:j]) + cost)
        return best[-1]

    for _ in range(30):
        lists = [np.sort(rng.choice(400, rng.integers(1, 60), replace=False)) for _ in range(4)]
        place, first = np.concatenate(lists), np.concatenate([np.arange(len(x)) == 0 for x in lists])
        value = rng.integers(1, 100, len(place))
        starts, most = lexical_search.block_bounds(place, value, first)
        ends, owner = np.r_[starts[1:], len(place)], np.cumsum(first) - 1
        at = 0
        for k, own in enumerate(lists):
            mine = np.flatnonzero(owner[starts] == k)
            v = value[at : at + len(own)]
            got = sum((place[ends[b] - 1] - place[starts[b]] + 1) * most[b] + lexical_search.COST * v.max() for b in mine)
            assert got == least(own.tolist(), v.tolist(), lexical_search.BLOCK)
            assert all(most[b] == value[starts[b] : ends[b]].max() for b in mine)
            at += len(own)
