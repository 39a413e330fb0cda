"""Toxicity by a classifier chain: linear models for one category after the other, each fed the earlier ones' probabilities.

The labels say only whether a text is toxic. Insults are particular to a language, so the chain's categories are toxic
texts of each of the languages with the most of them, and toxic itself comes last, where the others' probabilities help.
A later model is trained on out-of-fold probabilities: what an earlier model says about texts that it hasn't seen.

Features are the presence of words and of word beginnings (slurs take endings), picked for how much more often toxic
texts have them. The models are fitted in one task on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import shared, text
from parlance.llm.linear import fit_logistic, sigmoid

#: At most so many labelled texts of each class are fitted on; features, folds, and languages with a category of their own.
SAMPLE, FEATURES, FOLDS, LANGUAGES = 3_000, 400, 3, 4
#: Bytes of a word's beginning, and in how many toxic texts of the sample a feature must be.
STEM, LEAST = 5, 3
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all words without punctuation around them, and of their beginnings; A-Z lower-cased."""
    starts, ends = text.bounds(data, offsets)
    for _ in range(3):
        ends = ends - ((ends > starts + 1) & _PUNCTUATION[data[ends - 1]])
        starts = starts + ((ends > starts + 1) & _PUNCTUATION[data[np.minimum(starts, len(data) - 1)]])
    low = text.LOWER[data]
    doc = np.searchsorted(offsets, starts, "right") - 1
    long = ends - starts > STEM
    both = text.spans_hash(low, np.r_[starts, starts[long]], np.r_[ends, starts[long] + STEM])
    both[len(starts) :] = text.mix(both[len(starts) :] + np.uint64(1))
    # A word of just a beginning's length counts as one too.
    exact = ends - starts == STEM
    return np.r_[both, text.mix(both[: len(starts)][exact] + np.uint64(1))], np.r_[doc, doc[long], doc[exact]]


def _sample_features(batches):
    for batch in batches:
        for part in text.chunks(batch, "text"):
            h, doc = features(*text.buffer(part.column("text")))
            cuts = np.searchsorted(np.sort(doc), np.arange(part.num_rows + 1))
            h = h[np.argsort(doc, kind="stable")]
            own = [np.unique(h[s:e]).tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("toxic"), pa.array(own, pa.binary())], names=["doc_id", "lang", "toxic", "features"])


def train_chain(x: np.ndarray, labels: list[np.ndarray], folds: np.ndarray, prior: float) -> list[list[float]]:
    """Weights of each category: features, the categories before, intercept. The last one's intercept moves to the prior."""
    chain, before = [], np.zeros((len(x), 0))
    for y in labels:
        known = np.c_[x, before]
        out = np.zeros(len(x))
        for k in range(FOLDS):
            held = folds == k
            out[held] = sigmoid(np.c_[known[held], np.ones(held.sum())] @ fit_logistic(known[~held], y[~held]))
        w = fit_logistic(known, y)
        chain.append(w.tolist())
        before = np.c_[before, out]
    share = np.clip(labels[-1].mean(), 1e-6, 1 - 1e-6)
    chain[-1][-1] += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return chain


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id", ignore_index=True)
    toxic = pdf["toxic"].to_numpy().astype(bool)
    empty = pd.DataFrame({"model": [json.dumps(None)]})
    if not toxic.any() or toxic.all():
        return empty
    own = [np.frombuffer(b, np.uint64) for b in pdf["features"]]
    every, place = np.unique(np.concatenate(own), return_inverse=True)
    doc = np.repeat(np.arange(len(own)), [len(o) for o in own])
    bad = np.bincount(place[toxic[doc]], minlength=len(every))
    good = np.bincount(place[~toxic[doc]], minlength=len(every))
    rate = (bad / toxic.sum()) / ((good + 0.5) / (~toxic).sum())
    worth = np.where((bad >= LEAST) & (rate > 1.5), bad * np.log(np.maximum(rate, 1)), 0)
    pick = np.sort(np.argsort(-worth, kind="stable")[:FEATURES])
    pick = pick[worth[pick] > 0]
    if not len(pick):
        return empty
    at = np.full(len(every), -1)
    at[pick] = np.arange(len(pick))
    x = np.zeros((len(own), len(pick)))
    has = at[place] >= 0
    x[doc[has], at[place[has]]] = 1
    lang = pdf["lang"].fillna("").to_numpy()
    names = pd.Series(lang[toxic]).value_counts().sort_index().sort_values(ascending=False, kind="stable").index[:LANGUAGES].tolist()
    folds = (text.mix(pdf["doc_id"].to_numpy(np.int64).view(np.uint64).copy()) % np.uint64(FOLDS)).astype(int)
    prior = float(np.clip(pdf["prior"].iloc[0], 1e-4, 0.5))
    chain = train_chain(x, [(toxic & (lang == n)).astype(float) for n in names] + [toxic.astype(float)], folds, prior)
    return pd.DataFrame({"model": [json.dumps({"hashes": [int(h) for h in every[pick]], "categories": [*(f"toxic in {n or 'no language'}" for n in names), "toxic"], "chain": chain})]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """A chain learnt from labelled documents: at most sample of each class, those with the smallest hashes of doc_id.

    Null doc_ids and labels take no part; of labels that differ the larger counts; a doc_id with several texts is learnt from
    its smallest one (null first, which is the empty text). None without labelled documents. Other columns are ignored.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    prior = known.agg(F.avg("toxic").alias("p")).first()["p"]
    if prior is None:
        return None
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most 2 * sample rows are broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(F.broadcast(pick(1).unionByName(pick(0))), "doc_id")
    # One row of each doc_id, the smallest text: repeats don't enlarge the task that fits.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "x.text", "x.lang", "toxic")
    rows = rows.mapInArrow(shared.tidy(_sample_features), "doc_id long, lang string, toxic int, features binary")
    fitted = rows.withColumns({"prior": F.lit(float(prior)), "one": F.lit(1)}).groupBy("one").applyInPandas(_fit, "model string").collect()
    return json.loads(fitted[0]["model"]) if fitted else None


def _scores(model: dict | None):
    def run(batches):
        hashes = np.array(model["hashes"] if model else [], np.uint64)
        chain = [np.array(w) for w in (model["chain"] if model else [])]
        for batch in batches:
            for part in text.chunks(batch, "text"):
                n = part.num_rows
                p = np.zeros((n, len(chain)))
                if chain:
                    h, doc = features(*text.buffer(part.column("text")))
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = hashes[at] == h
                    pairs = np.unique(doc[hit] * len(hashes) + at[hit])
                    doc, at = pairs // len(hashes), pairs % len(hashes)
                    for k, w in enumerate(chain):
                        margin = np.bincount(doc, w[at], minlength=n) + w[-1]
                        p[:, k] = sigmoid(margin + p[:, :k] @ w[len(hashes) : len(hashes) + k])
                score = p[:, -1] if chain else np.zeros(n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(p), pa.list_(pa.float64())), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "categories", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, categories (each link's probability), score (the last link's) and predicted (1 from 0.5 on) of every row.

    Null and empty texts have no features and get the intercept's score. Without labels of both classes every score is 0
    and nothing is predicted. Equal rows are scored alike; other columns are ignored; an empty table gives none.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(shared.tidy(_scores(train(docs, labels))), "doc_id long, categories array<double>, score double, predicted int")


def _keep(model: dict | None):
    score = _scores(model)

    def run(batches):
        for batch in batches:
            slim = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"])
            bad = np.concatenate([b.column("predicted").to_numpy() for b in score([slim])] or [np.zeros(0, int)])
            yield batch.filter(pa.array(bad == 0))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the chain predicts as toxic; all columns stay as they are."""
    return docs.mapInArrow(shared.tidy(_keep(train(docs, labels))), docs.schema)
