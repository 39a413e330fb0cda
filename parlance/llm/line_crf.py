"""Quality of documents by a linear-chain conditional random field that labels every line good or bad.

A line's features are shares of its bytes and words (capitals, symbols, digits, repeated words and the like), and the same
of the lines before and after it. The field learns from documents whose lines all carry the document's label. A
document's line marginals come from the forward-backward recursion; their mean, weighted by the lines' lengths, goes
through a logistic curve fitted on the same sample and is the document's score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import shared, text
from parlance.llm.linear import fit_logistic, sigmoid

#: At most so many labelled documents of each class are learnt from; steps of the field's training.
SAMPLE, STEPS = 1_500, 120

_KINDS = np.zeros((256, 6), bool)
_KINDS[65:91, 0] = True  # capitals
_KINDS[97:123, 1] = True  # small letters
_KINDS[128:, 1] = True
_KINDS[48:58, 2] = True  # digits
_KINDS[[*b"#$%&*+/<=>@^_`{}~\\"], 3] = True  # symbols
_KINDS[[*b"|!?"], 4] = True  # bars and exclamation
_KINDS[[*b".,;:'\"()-"], 5] = True  # punctuation
_WIDTH = 14


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, cuts) of every text's lines, empty ones too; a text has one more than it has line breaks."""
    breaks = np.flatnonzero(data == 10)
    doc = np.searchsorted(offsets, breaks, "right") - 1
    # A break of an empty text can't be; those at a boundary belong to the text that holds the byte.
    count = np.bincount(doc, minlength=len(offsets) - 1) + 1
    cuts = np.r_[0, np.cumsum(count)]
    starts, ends = np.empty(cuts[-1], np.int64), np.empty(cuts[-1], np.int64)
    first, last = np.zeros(cuts[-1], bool), np.zeros(cuts[-1], bool)
    first[cuts[:-1]], last[cuts[1:] - 1] = True, True
    starts[first], starts[~first] = offsets[:-1], breaks + 1
    ends[last], ends[~last] = offsets[1:], breaks
    return starts, ends, cuts


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, cuts): a row for each line with its own features and those of its neighbours in the text."""
    starts, ends, cuts = lines(data, offsets)
    length = ends - starts
    own = np.zeros((len(starts), _WIDTH), np.float32)
    size = np.maximum(length, 1)
    for k in range(_KINDS.shape[1]):
        total = np.r_[0, np.cumsum(_KINDS[data, k], dtype=np.int64)]
        own[:, k] = (total[ends] - total[starts]) / size
    own[:, 6] = np.log1p(length) / 5
    begin, end = text.bounds(data, offsets)
    hashes = text.spans_hash(text.LOWER[data], begin, end)
    at = np.searchsorted(begin, starts)
    to = np.searchsorted(begin, ends)
    n = np.maximum(to - at, 1)
    same = np.zeros((3, len(hashes)), bool)
    same[0, 1:] = hashes[1:] == hashes[:-1]
    same[1, 2:] = hashes[2:] == hashes[:-2]
    if len(data):
        same[2] = ~(_KINDS[data[np.maximum(end - 1, 0)], 0] | _KINDS[data[np.maximum(end - 1, 0)], 1])
    for k in range(3):
        total = np.r_[0, np.cumsum(same[k])]
        own[:, 7 + k] = (total[to] - total[at]) / n
    own[:, 10] = np.minimum(length / n / 10, 2)
    upper = own[:, 0] / np.maximum(own[:, 0] + own[:, 1], 1e-6)
    own[:, 11], own[:, 12] = upper, np.minimum(4 * own[:, 3], 1)
    own[:, 13] = to - at > 0
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[cuts[:-1]], after[cuts[1:] - 1] = 0, 0
    return np.c_[own, before, after, np.ones(len(own), np.float32)].astype(np.float64), length, cuts


def _steps(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling number of lines, and how many of them have a line 0, 1, 2, ..."""
    n = np.diff(cuts)
    order = np.argsort(-n, kind="stable")
    return order, np.searchsorted(-n[order], -np.arange(1, (n.max() if len(n) else 0) + 1), "right")


def forward_backward(scores: np.ndarray, moves: np.ndarray, cuts: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of each line's two labels, expected moves between labels, log partition of each text).

    scores: a row of two log potentials for each line; moves: two by two; share: what each text counts in the moves. All
    texts take each step together.
    """
    order, active = _steps(cuts)
    share = (np.ones(len(cuts) - 1) if share is None else share)[order]
    top = scores.max(axis=1, keepdims=True)
    potential, move = np.exp(scores - top), np.exp(moves)
    alpha, scale = np.empty_like(potential), np.ones(len(potential))
    begin = cuts[:-1][order]
    for t, n in enumerate(active):
        at = begin[:n] + t
        a = potential[at] if t == 0 else (alpha[at - 1] @ move) * potential[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    beta = np.ones_like(potential)
    expected = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        ahead = potential[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = ahead @ move.T
        expected += ((alpha[at - 1] * share[: active[t], None]).T @ ahead) * move
    partition = np.log(scale) + top[:, 0]
    total = np.r_[0, np.cumsum(partition)]
    return alpha * beta, expected, total[cuts[1:]] - total[cuts[:-1]]


def train_field(x: np.ndarray, cuts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves) by gradient ascent (Adam) on the log-likelihood; y: each text's label, weight: each text's share.

    A text's lines divide its share among them, so long texts don't count for more.
    """
    n = np.diff(cuts)
    each = weight / weight.sum() / n
    truth = np.eye(2)[np.repeat(y, n)]
    share = np.repeat(each, n)[:, None]
    inner = np.diag([((n - 1) * each)[y == k].sum() for k in (0, 1)])
    params = [np.zeros((x.shape[1], 2)), np.zeros((2, 2))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        p, expected, _ = forward_backward(x @ params[0], params[1], cuts, each)
        for k, grad in enumerate((x.T @ ((truth - p) * share) - 1e-5 * params[0], inner - expected - 1e-3 * params[1])):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.98 * second[k] + 0.02 * grad * grad
            params[k] += 0.1 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-8)
    return params[0], params[1]


def document_scores(x: np.ndarray, length: np.ndarray, cuts: np.ndarray, field: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each text's mean probability of good lines, weighted by length (an empty line counts as one byte)."""
    good = forward_backward(x @ field[0], field[1], cuts)[0][:, 1]
    return np.add.reduceat(good * (length + 1), cuts[:-1]) / np.add.reduceat(length + 1, cuts[:-1])


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id", ignore_index=True)
    y = pdf["quality"].to_numpy(int)
    if y.min() == y.max():
        return pd.DataFrame({"field": [None], "curve": [None]})
    x, length, cuts = line_features(*text.buffer(pa.array(pdf["text"].fillna(""), pa.string())))
    prior = float(np.clip(pdf["prior"].iloc[0], 1e-4, 1 - 1e-4))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    field = train_field(x, cuts, y, weight)
    mean = document_scores(x, length, cuts, field)
    curve = fit_logistic(mean[:, None], y.astype(float), 1e-3)
    curve[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return pd.DataFrame({"field": [np.r_[field[0], field[1]].ravel().tolist()], "curve": [curve.tolist()]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple | None:
    """A field learnt from labelled documents: at most sample of each class, those with the smallest hashes of doc_id.

    Null doc_ids and labels take no part; of labels that differ the larger counts; a doc_id with several texts is learnt from
    its smallest one that isn't null. None without labels of both classes. Other columns are ignored.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    prior = known.agg(F.avg("quality").alias("p")).first()["p"]
    if prior is None:
        return None
    pick = lambda y: known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most 2 * sample rows are broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(pick(1).unionByName(pick(0))), "doc_id")
    # One row of each doc_id, the smallest text: repeats don't enlarge the task that fits.
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = rows.withColumns({"prior": F.lit(float(prior)), "one": F.lit(1)}).groupBy("one").applyInPandas(_fit, "field array<double>, curve array<double>").collect()
    if not got or got[0]["field"] is None:
        return None
    both = np.array(got[0]["field"]).reshape(-1, 2)
    return (both[:-2], both[-2:]), np.array(got[0]["curve"])


def _scores(model: tuple | None):
    def run(batches):
        for batch in batches:
            for part in text.chunks(batch, "text"):
                score = np.full(part.num_rows, 0.5)
                if model:
                    x, length, cuts = line_features(*text.buffer(part.column("text")))
                    score = sigmoid(np.c_[document_scores(x, length, cuts, model[0]), np.ones(part.num_rows)] @ model[1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: good likelier) and predicted (1 from 0.5 on) of every row.

    Held out is a crc32(doc_id) mod 3 of 1; only other documents are learnt from. A null or empty text is one empty
    line. Without labels of both classes every score is 0.5. Equal rows are scored alike; a null doc_id is scored and
    isn't held out; other columns are ignored; an empty table gives an empty result.
    """
    held = lambda df: F.coalesce(F.crc32(df["doc_id"].cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(docs.where(~held(docs)), labels.where(~held(labels)))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held(docs).alias("held_out"), "text")
    return slim.mapInArrow(shared.tidy(_scores(model)), "doc_id long, held_out boolean, score double, predicted int")
