"""Trained models by held-out accuracy, and the pipeline stage by stage."""

import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import line_crf, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels")}


def test_toxicity_on_held_out_documents(tables):
    """Learnt from two thirds of the labelled rows, judged on the others."""
    labels = tables["labels"].where("pmod(crc32(cast(doc_id as string)), 3) != 1")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(tables["documents"], labels).collect()}
    held = [r for r in tables["labels"].collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    toxic = [scores[r.doc_id] for r in held if r.toxic == 1]
    clean = [scores[r.doc_id] for r in held if r.toxic == 0]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.03


def plain_features(t):
    """Words without up to three marks before and behind, and the beginnings of those of five bytes or more, as byte strings."""
    marks = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
    out = set()
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()):
        for _ in range(3):
            w = w[:-1] if len(w) > 1 and w[-1] in marks else w
            w = w[1:] if len(w) > 1 and w[0] in marks else w
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)
        out.add((w, False))
        if len(w) >= 5:
            out.add((w[:5], True))
    return out


def test_chain_against_plain_python(tables, odd_docs, odd_rows):
    """Every link's probability by a loop over features and earlier links."""
    from parlance.llm import text

    odd = odd_docs.select((F.col("doc_id") + 10**7).alias("doc_id"), "text", "lang")
    docs = tables["documents"].select("doc_id", "text", "lang").unionByName(odd)
    model = toxicity.train(docs, tables["labels"])

    def hashed(w, stem):
        h = text.spans_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
        return int((text.mix(h + np.uint64(1)) if stem else h)[0])

    def scored(t):
        has = {hashed(*f) for f in plain_features(t)}
        links = []
        for w in model["chain"]:
            total = w[-1] + sum(x for h, x in zip(model["hashes"], w, strict=False) if h in has)
            total += sum(x * p for x, p in zip(w[len(model["hashes"]) :], links, strict=False))
            links.append(1 / (1 + np.exp(-total)))
        return links

    toxic = [r.doc_id for r in tables["labels"].where("toxic = 1").limit(40).collect()]
    some = lambda df: df.where(F.col("doc_id").isin(toxic) | F.coalesce(F.col("doc_id") >= 10**7, F.lit(True))).collect()
    want = [scored(r.text) for r in some(docs)]
    got = some(toxicity.toxicity(docs, tables["labels"]))
    assert len(got) == len(want) == len(odd_rows) + len(toxic)
    key = lambda x: tuple(round(float(p), 9) for p in x)
    assert Counter(key(r.categories) for r in got) == Counter(map(key, want)) and all(r.score == r.categories[-1] for r in got)


def test_later_links_learn_from_unseen_probabilities(monkeypatch):
    """A first category of pure noise, learnt by heart in-sample: out of fold it says nothing, and the next link sees that."""
    rng = np.random.default_rng(1)
    x = (rng.random((300, 120)) < 0.5).astype(float)
    first = (rng.random(300) < 0.5).astype(float)
    seen = []
    fit = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda a, y: seen.append(a) or fit(a, y))
    chain = toxicity.train_chain(x, [first, first], np.arange(300) % 3, 0.5)
    unseen = seen[-1][:, -1]
    inside = 1 / (1 + np.exp(-(np.c_[x, np.ones(300)] @ np.array(chain[0]))))
    assert seen[-1].shape[1] == 121 and len(chain[1]) == 122
    assert np.corrcoef(inside, first)[0, 1] > 0.5 > 0.25 > abs(np.corrcoef(unseen, first)[0, 1])


def test_toxicity_on_odd_documents(spark, odd_docs, odd_rows, no_docs, tables):
    got = toxicity.toxicity(odd_docs, tables["labels"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert toxicity.toxicity(no_docs, tables["labels"]).count() == 0
    none = toxicity.toxicity(odd_docs, tables["labels"].limit(0)).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)
    assert toxicity.drop_toxic(odd_docs, tables["labels"].limit(0)).count() == len(odd_rows)


def test_quality_on_held_out_documents(tables):
    got = {r.doc_id: r for r in line_crf.quality(tables["documents"], tables["labels"]).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in tables["labels"].collect() if got[r.doc_id].held_out]
    assert np.mean([y == p for y, p in held]) > 0.95


def test_quality_on_odd_documents(odd_docs, odd_rows, no_docs, tables):
    got = line_crf.quality(odd_docs, tables["labels"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert line_crf.quality(no_docs, tables["labels"]).count() == 0
    assert all(r.score == 0.5 for r in line_crf.quality(odd_docs, tables["labels"].limit(0)).collect())


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(5)
    cuts = np.array([0, 1, 5, 8])
    scores, moves = rng.standard_normal((8, 2)), rng.standard_normal((2, 2))
    p, expected, partition = line_crf.forward_backward(scores, moves, cuts)
    total_moves = np.zeros((2, 2))
    for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
        weights, one, pairs = [], np.zeros((e - s, 2)), np.zeros((2, 2))
        for code in range(1 << (e - s)):
            y = [code >> j & 1 for j in range(e - s)]
            w = np.exp(sum(scores[s + j, v] for j, v in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            weights.append(w)
            for j, v in enumerate(y):
                one[j, v] += w
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w
        assert np.allclose(p[s:e], one / sum(weights)) and partition[k] == pytest.approx(np.log(sum(weights)))
        total_moves += pairs / sum(weights)
    assert np.allclose(expected, total_moves)


def test_document_scores_against_all_labellings():
    """A document's score: what all labellings of its lines say of each line, weighted by length."""
    rng = np.random.default_rng(6)
    cuts, x = np.array([0, 3, 4, 9]), rng.standard_normal((9, 4))
    length, field = rng.integers(0, 50, 9), (rng.standard_normal((4, 2)), rng.standard_normal((2, 2)))
    got = line_crf.document_scores(x, length, cuts, field)
    for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
        good, total = np.zeros(e - s), 0.0
        for code in range(1 << (e - s)):
            y = [code >> j & 1 for j in range(e - s)]
            w = np.exp(sum(x[s + j] @ field[0][:, v] for j, v in enumerate(y)) + sum(field[1][a, b] for a, b in zip(y, y[1:], strict=False)))
            good, total = good + w * np.array(y), total + w
        assert got[k] == pytest.approx((good / total * (length[s:e] + 1)).sum() / (length[s:e] + 1).sum())


def test_lines():
    import pyarrow as pa

    from parlance.llm import text

    samples = ["", "a", "a\n", "\n", "b\n\nc", None]
    data, offsets = text.buffer(pa.array(samples))
    starts, ends, cuts = line_crf.lines(data, offsets)
    raw = data.tobytes().decode()
    assert [raw[s:e] for s, e in zip(starts, ends, strict=True)] == [x for t in samples for x in (t or "").split("\n")]
    assert np.diff(cuts).tolist() == [1, 1, 2, 2, 3, 1]


def test_pipeline_stage_by_stage(spark, tables):
    import corpus_pipeline
    from parlance.llm import shared
    from tests.llm.test_pairs import linked_groups, removed

    docs = tables["documents"].where("doc_id < 300")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, shared.table(stage(spark, docs, DATA), name)
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == tables["documents"].columns
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in tables["labels"].collect()}
            left = {r.doc_id for r in docs.collect()}
            gone = {r.doc_id for r in before.collect()} - left
            assert all(labels.get(d, 1) for d in gone) and sum(labels.get(d, 0) for d in left) <= 6
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {d for d, _, c in linked_groups(rows) if d == c}
        if name == "suffix_array_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            cut = {d: gone for d, _, gone, _, _ in removed(rows)}
            now = {r.doc_id: r for r in docs.collect()}
            assert all(len(now[d].text.encode()) == len(t.encode()) - cut[d] or not t.isascii() for d, t in rows if d in now)
            assert all(now[d].n_chars == len(now[d].text) for d in now)
        if name == "source_mixing":
            assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 3
    size = kept["source_mixing"].select(F.count("*").alias("n")).first()["n"]
    assert kept["best_fit_packing"].where("piece = 0").count() == size


def test_pipeline_stages_on_odd_documents(spark, odd_docs, no_docs):
    import corpus_pipeline
    from parlance.llm import shared

    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = shared.table(stage(spark, docs, DATA), name)


def test_only_the_guarded_entry_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for path in (root / "parlance").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"parlance\.llm|corpus_pipeline", path.read_text()), path


def test_repeated_rows_are_learnt_from_once(spark):
    """Documents that are there many times, or with several texts, don't enlarge the fitting task or change a model."""
    good = [(k, f"A calm line about gardens number {k}.\nAnother line follows here.", "en") for k in range(40)]
    bad = [(k, f"zzz buy !!! {k} $$$ 000\nwww now now", "en") for k in range(40, 80)]
    labels = spark.createDataFrame([(k, int(k < 40), int(k >= 40)) for k in range(80)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    often = once.unionByName(once).unionByName(once.limit(5)).unionByName(once.where("doc_id = 3").withColumn("text", F.lit("zzzz")))
    for learn in (line_crf.train, toxicity.train):
        a, b = learn(once, labels), learn(often, labels)
        assert json.dumps(a, default=lambda x: x.tolist()) == json.dumps(b, default=lambda x: x.tolist())
