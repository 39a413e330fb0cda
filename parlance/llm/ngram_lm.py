"""Interpolated modified Kneser-Ney bigram model: counted by Spark, kept as sorted hash arrays, memory-mapped by tasks that score.

Counting. A task counts the pairs (context word, word) of a portion of its texts and sends each pair, with its count, to
the bucket of the context. Contexts that follow the corpus everywhere ("the", the start of a text) would fill one bucket,
so those with more than a set share of all tokens are spread by the following word instead; there can only be so many of
them. A bucket adds the counts up, writes its pairs as one sorted array of 64-bit hashes with a parallel array of counts,
and sends on, for each word, its count and how many different words it follows, and for each context how many different
words follow it once, twice, or more often. Buckets of words (ranges of the hash) write those as sorted arrays too.

Scoring. Tasks map the arrays of the shared folder and look up sorted queries; only the pages they touch are read. In a
folder that isn't a file system of the machine, an array is copied once to an unnamed temporary file and mapped there.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import shared, text

_U64 = np.uint64
#: The tokens that end a text, and the context of its first word.
_END, _BEGIN = _U64(0x5851F42D4C957F2D), _U64(0x14057B7EF767814F)
#: A task counts so many tokens before it sends their pairs on.
PORTION = 1_500_000
#: A context is spread over all buckets if it has more than the share 1 / (SPREAD * buckets) of all tokens.
SPREAD = 4
#: Counts of this and more stand in a second, short array.
_MANY = 255


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return text.mix(text.mix(context + _U64(0x9E3779B97F4A7C15)) ^ (word * _U64(0xD1342543DE82EF95)))


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, cuts): each text's words and then the end, each with the token before it."""
    hashes, cuts = text.words(data, offsets)
    ends = cuts[1:] + np.arange(len(cuts) - 1)
    tokens = np.empty(len(hashes) + len(ends), _U64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[is_end], tokens[~is_end] = _END, hashes
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    contexts[starts] = _BEGIN
    return contexts, tokens, np.r_[starts, len(tokens)]


def _portions(batches):
    held, size = [], 0
    for batch in batches:
        for part in text.chunks(batch, "text"):
            contexts, tokens, _ = sequences(*text.buffer(part.column("text")))
            held.append((contexts, tokens))
            size += len(tokens)
            if size >= PORTION:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _hot(buckets: int):
    """Contexts that are frequent in a portion, with their counts; the null word carries the portion's tokens."""

    def run(batches):
        for contexts, _ in _portions(batches):
            every, count = np.unique(contexts, return_counts=True)
            pick = count * 2 * SPREAD * buckets > len(contexts)
            yield pa.RecordBatch.from_arrays([pa.array([*every[pick].view(np.int64).tolist(), None], pa.int64()), pa.array(np.r_[count[pick], len(contexts)])], names=["word", "n"])

    return run


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _pair_bucket(hot: np.ndarray, contexts: np.ndarray, words: np.ndarray, buckets: int) -> np.ndarray:
    key = np.where(_in(hot, contexts), text.mix(words ^ contexts), contexts)
    return _word_bucket(key, buckets)


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that all buckets' arrays in turn are sorted."""
    return ((words >> _U64(32)) * _U64(buckets) >> _U64(32)).astype(np.int32)


def _add_up(contexts, words, counts):
    order = np.lexsort((words, contexts))
    contexts, words, counts = contexts[order], words[order], counts[order]
    cuts = np.flatnonzero(np.r_[True, (contexts[1:] != contexts[:-1]) | (words[1:] != words[:-1])])
    return contexts[cuts], words[cuts], np.add.reduceat(counts, cuts)


def _pairs(buckets: int, hot):
    def run(batches):
        router = shared.Router("u8", "u8", "i8")
        for contexts, words in _portions(batches):
            contexts, words, counts = _add_up(contexts, words, np.ones(len(words), np.int64))
            yield from router.add(_pair_bucket(hot.value, contexts, words, buckets), contexts, words, counts)
            yield from router.flush()

    return run


_STEP = "bucket int, n long, blob binary, totals array<long>"


def _totals(x: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and all of them, and their sum."""
    return [*(int((x == k).sum()) for k in (1, 2, 3, 4)), len(x), int(x.sum())]


def _with_totals(blobs, totals=None):
    for b in blobs:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.list_(pa.int64()))], names=["bucket", "n", "blob", "totals"])
    if totals is not None:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([totals], pa.list_(pa.int64()))], names=["bucket", "n", "blob", "totals"])


def _count_pairs(folder: str, buckets: int):
    """A bucket's pairs: writes their arrays, sends on what words and contexts gain from them."""

    def run(batches):
        from pyspark import TaskContext

        got = shared.gather(batches, "u8", "u8", "i8")
        if got is None:
            return
        contexts, words, counts = _add_up(*got)
        k = TaskContext.get().partitionId()
        keys = pair_hash(contexts, words)
        order = np.argsort(keys)
        keys, small = keys[order], np.minimum(counts[order], _MANY).astype(np.uint8)
        many = counts[order] >= _MANY
        for name, values in (("key", keys), ("count", small), ("many", keys[many]), ("manycount", counts[order][many])):
            shared.save_array(folder, f"pair-{name}-{k}", values)
        router = shared.Router("u8", "i8", "f4", "f4", "f4", "f4")
        by = np.argsort(words, kind="stable")
        cuts = np.flatnonzero(np.r_[True, words[by][1:] != words[by][:-1]])
        zero = np.zeros(len(cuts), np.float32)
        w = words[by][cuts]
        yield from _with_totals(router.add(_word_bucket(w, buckets), w, np.add.reduceat(counts[by], cuts), np.diff(np.r_[cuts, len(by)]), zero, zero, zero))
        cuts = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]])
        u, zero = contexts[cuts], np.zeros(len(cuts), np.float32)
        n1, n2, n3 = (np.add.reduceat(x.astype(np.int64), cuts) for x in (counts == 1, counts == 2, counts > 2))
        # The start of a text isn't a word, but as a context it has a count like one.
        began = np.where(u == _BEGIN, np.add.reduceat(counts, cuts), 0)
        yield from _with_totals(router.add(_word_bucket(u, buckets), u, began, zero, n1, n2, n3))
        yield from _with_totals(router.flush(), _totals(counts))

    return run


_WORD = (("hash", "u8"), ("count", "i8"), ("follows", "f4"), ("once", "f4"), ("twice", "f4"), ("more", "f4"))


def _count_words(folder: str):
    """A bucket's words and contexts: writes their arrays, gives their totals."""

    def run(batches):
        from pyspark import TaskContext

        got = shared.gather(batches, *(d for _, d in _WORD))
        if got is None:
            return
        k = TaskContext.get().partitionId()
        order = np.argsort(got[0], kind="stable")
        cuts = np.flatnonzero(np.r_[True, got[0][order][1:] != got[0][order][:-1]])
        cols = [got[0][order][cuts], *(np.add.reduceat(c[order].astype(np.float64 if c.dtype.kind == "f" else np.int64), cuts) for c in got[1:])]
        for (name, dtype), values in zip(_WORD, cols, strict=True):
            shared.save_array(folder, f"word-{name}-{k}", values.astype(dtype))
        is_word = cols[0] != _BEGIN
        totals = [*_totals(cols[2][is_word].astype(np.int64)), int(is_word.sum()), int(cols[1][is_word].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([totals], pa.list_(pa.int64()))], names=["totals"])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4.

    Where one of these is 0, as in a small corpus, the formula is undefined, and 0.5, 1 and 1.5 stand in.
    """
    n1, n2, n3, n4 = n
    if min(n1, n2, n3, n4) == 0:
        return np.array([0, 0.5, 1, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 1, 2, 3])


class Model:
    """A trained model: where its arrays are, and its few corpus-wide numbers."""

    def __init__(self, folder: str, buckets: int, hot: np.ndarray, pair_totals: list[int], word_totals: list[int]):
        self.folder, self.buckets, self.hot = folder, buckets, hot
        self.pair_discount, self.word_discount = discounts(pair_totals[:4]), discounts(word_totals[:4])
        self.kinds = word_totals[5]  # different pairs
        self.words, self.tokens = word_totals[6], word_totals[7]
        ones, twos = word_totals[:2]
        known = self.word_discount[1:] @ np.array([ones, twos, max(0, self.words - ones - twos)], float)
        self.word_rest = known / self.kinds if self.kinds else 1.0

    def _find(self, kind: str, names: tuple, bucket: np.ndarray, keys: np.ndarray, first: str) -> list[np.ndarray]:
        """Values of each key's row in its bucket's arrays, 0 where there is none."""
        out = [np.zeros(len(keys), d) for _, d in names]
        order = np.lexsort((keys, bucket))
        b = bucket[order]
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
        for s, e in zip(cuts.tolist(), np.r_[cuts[1:], len(b)][: len(cuts)].tolist(), strict=True):
            k = int(b[s])
            have = shared.load_array(self.folder, f"{kind}-{first}-{k}", "u8")
            if len(have):
                asked = keys[order[s:e]]
                at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
                hit = np.asarray(have[at]) == asked
                for o, (name, d) in zip(out, names, strict=True):
                    o[order[s:e][hit]] = shared.load_array(self.folder, f"{kind}-{name}-{k}", d)[at[hit]]
        return out

    def score(self, contexts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's training count and its probability after its context."""
        every, place = np.unique(np.r_[contexts, tokens], return_inverse=True)
        count, follows, once, twice, more = self._find("word", _WORD[1:], _word_bucket(every, self.buckets), every, "hash")
        before, this = place[: len(contexts)], place[len(contexts) :]
        d = self.word_discount
        follows = follows.astype(float)
        single = np.maximum(follows - d[np.minimum(follows, 3).astype(int)], 0) / max(self.kinds, 1) + self.word_rest / (self.words + 1)
        d = self.pair_discount
        rest = d[1] * once.astype(float) + d[2] * twice + d[3] * more
        key = pair_hash(contexts, tokens)
        bucket = _pair_bucket(self.hot, contexts, tokens, self.buckets)
        (n,) = self._find("pair", (("count", "u1"),), bucket, key, "key")
        n = n.astype(np.int64)
        many = np.flatnonzero(n == _MANY)
        if len(many):
            n[many] = self._find("pair", (("manycount", "i8"),), bucket[many], key[many], "many")[0]
        total = count[before].astype(float)
        seen = total > 0
        out = single[this]
        out[seen] = np.maximum(n[seen] - d[np.minimum(n[seen], 3)], 0) / total[seen] + rest[before[seen]] / total[seen] * out[seen]
        return count[this], out


def train(docs: DataFrame, column: str = "text") -> Model:
    """A model of all texts of docs; null counts as the empty text, which is one end token."""
    spark = docs.sparkSession
    texts = docs.select(F.col(column).alias("text"))
    buckets = shared.n_buckets(spark)
    folder = shared.new_folder(spark, "ngram")
    counted = texts.mapInArrow(shared.tidy(_hot(buckets)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.where("word is null").agg(F.sum("n").alias("total"))
    # At most SPREAD * buckets contexts can have that share.
    often = counted.where("word is not null").crossJoin(F.broadcast(total)).where(F.col("n") * SPREAD * buckets > F.col("total")).orderBy(F.desc("n")).limit(SPREAD * buckets)
    hot = np.sort(often.select("word").toPandas()["word"].to_numpy(np.int64).view(_U64))
    pairs = texts.mapInArrow(shared.tidy(_pairs(buckets, spark.sparkContext.broadcast(hot))), shared.BLOB_SCHEMA)
    step = shared.table(shared.route(pairs, buckets).mapInArrow(shared.tidy(_count_pairs(folder, buckets)), _STEP), "words")
    words = shared.route(step.where("bucket is not null").select("bucket", "n", "blob"), buckets).mapInArrow(shared.tidy(_count_words(folder)), "totals array<long>")
    add = lambda rows, n: np.sum([r.totals for r in rows] or [[0] * n], axis=0).tolist()  # noqa: E731  a row for each bucket
    return Model(folder, buckets, hot, add(step.where("totals is not null").select("totals").collect(), 6), add(words.collect(), 8))


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            for part in text.chunks(batch, "text", 4 * text.CHUNK_BYTES):
                contexts, tokens, cuts = sequences(*text.buffer(part.column("text")))
                count, p = model.score(contexts, tokens)
                base = np.log10((count + 1) / (model.tokens + model.words + 1))
                n = np.diff(cuts)
                known, score, base = (np.add.reduceat(x, cuts[:-1]) for x in ((count > 0).astype(np.int64), np.log10(p), base))
                cols = [part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def score(docs: DataFrame, model: Model, doc: str = "doc_id", column: str = "text", held_out: str = "held_out") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(held_out).alias("held_out"), F.col(column).alias("text"))
    return slim.mapInArrow(shared.tidy(_scores(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Every document's score by a model of those whose crc32(doc_id) mod 7 isn't 2 (a null doc_id isn't held out).

    Null and empty texts are one end token. Equal rows count as often as they are there. Other columns are ignored. An
    empty table gives an empty result; with nothing to learn from, every token's probability is 1.
    """
    marked = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"))
    return score(marked, train(marked.where("not held_out")))
