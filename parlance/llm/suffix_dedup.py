"""Removal of repeated byte strings by longest-previous-factor arrays over a sampled, sharded suffix order.

A byte goes when a string of LENGTH bytes that covers it also starts earlier in the corpus (smaller doc_id, or the same
text and an earlier start). That is: the string starting at p has a longest previous factor of LENGTH or more.

All suffixes of a large corpus can't be sorted in one place, so they are dealt by an anchor: among the k-grams of the
LENGTH bytes at p, the leftmost with the smallest hash. Equal strings have equal anchors at equal distances, so suffixes
that can match meet in one shard, and only anchors that occur at least twice need any text moved:

1. every text's anchors go to the bucket of their hash; those that repeat come back as positions of their texts;
2. texts with repeated anchors send, for each, the bytes around it (at most 2 * LENGTH - k) to its bucket;
3. a bucket puts the suffixes that start there into suffix order (by their first LENGTH bytes: whether a common prefix
   reaches LENGTH is all that matters). The previous and the next smaller place in the corpus give each one's longest
   previous factor; where that reaches LENGTH, the string starts earlier too;
4. the spans of each text are merged and cut out.

Equal texts count once (a later copy of LENGTH bytes or more goes as a whole); they are told by a 64-bit hash and their
length, so among m texts about m^2 / 2^65 pairs of one length are taken for equal. Strings are compared byte for byte. In steps 1 and 2 a task settles what
repeats within its own portion and sends on only the first of each, so a passage that everybody quotes reaches its
bucket once for each portion of a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import shared, text

LENGTH, GRAM = 100, 28
_U64 = np.uint64
_LOW = _U64(0xFFFFFFFF)
#: A task settles what repeats within so many anchors, or bytes around them.
ANCHORS, BYTES = 300_000, 1_500_000


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
shared.FORGET.append(_powers.clear)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and of its inverse: fit for windows of one short length whose bytes are compared."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            made = np.full(n, base, _U64)
            made[0] = 1
            _powers.append(np.multiply.accumulate(made))
    return _powers[0][:n], _powers[1][:n]


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the length bytes from each start."""
    power, inverse = _power(len(data) + 1)
    prefix = np.empty(len(data) + 1, _U64)
    prefix[0] = 0
    np.cumsum((data.astype(_U64) + _U64(1)) * power[:-1], out=prefix[1:])
    return text.mix((prefix[length:] - prefix[:-length]) * inverse[: len(data) - length + 1])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, place, first start, last start) of each anchor: the starts are those whose string has this anchor."""
    n_starts = len(data) - length + 1
    if n_starts <= 0:
        return (np.zeros(0, _U64), *(np.zeros(0, np.int64),) * 3)
    grams = window_hashes(data, gram)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=_U64)
    reach, span = length - gram + 1, 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n_starts], least[reach - span : reach - span + n_starts])
    end = np.repeat(offsets[1:], np.diff(offsets))[:n_starts]
    start = np.flatnonzero(end - np.arange(n_starts) >= length)
    place = (least[start] & _LOW).astype(np.int64)
    if not len(place):
        return (np.zeros(0, _U64), *(np.zeros(0, np.int64),) * 3)
    fresh = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return grams[place[fresh]], place[fresh], start[fresh], start[np.r_[fresh[1:] - 1, len(start) - 1]]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a big-endian number, so that numbers are in the order of the bytes."""
    return np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,))


def _steps(length: int) -> np.ndarray:
    """Where the words begin that cover length bytes (8 or more); the last may overlap the one before."""
    return np.minimum(np.arange(0, length, 8), length - 8)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    words, out = _words(data), np.ones(len(a), bool)
    for k in _steps(length):
        out &= words[a + k] == words[b + k]
    return out


def _ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Places of strings in byte order, equal ones at the same: sorted by a word, then those that tie by the next."""
    words = _words(data)
    order, place, open_ = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.arange(len(starts))
    for k in _steps(length):
        w, tied = words[starts[order[open_]] + k].astype(_U64), place[open_]
        by = np.lexsort((w, tied))
        order[open_], w = order[open_][by], w[by]
        new = np.r_[True, (w[1:] != w[:-1]) | (tied[1:] != tied[:-1])][: len(w)]
        place[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        open_ = open_[~(new & np.r_[new[1:], True][: len(new)])]
        if not len(open_):
            break
    out = np.empty(len(starts), np.int64)
    out[order] = place
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts in suffix order (by their first length bytes, equal ones as given), and whose common prefix with the one before reaches the length.

    Only starts whose length bytes occur more than once can have a factor that long, so the others, told by a hash, are
    left out first. Of the rest, those of one hash are compared byte for byte with the first of them, and the different
    strings are sorted by their bytes.
    """
    whole = window_hashes(data, length)[starts]
    order = np.argsort(whole, kind="stable")
    new = np.r_[True, whole[order[1:]] != whole[order[:-1]]][: len(order)]
    many = ~(new & np.r_[new[1:], True][: len(new)])
    order, new = order[many], new[many]
    if not len(order):
        return order, new
    which, first = np.cumsum(new) - 1, order[new]
    if _equal(data, starts[order], starts[first[which]], length).all():
        rank = _ranks(data, starts[first], length)
        # Whole runs of equal strings move to where their first one ranks.
        size = np.bincount(which)
        by = np.argsort(rank)
        begin = np.empty(len(rank), np.int64)
        begin[by] = np.cumsum(size[by]) - size[by]
        out = np.empty_like(order)
        out[begin[which] + np.arange(len(order)) - np.flatnonzero(new)[which]] = order
        same = np.ones(len(order), bool)
        same[begin] = False
        return out, same
    # Different strings of one hash: all are ranked by their bytes instead.
    rank = _ranks(data, starts[order], length)
    by = np.lexsort((order, rank))
    return order[by], np.r_[False, rank[by][1:] == rank[by][:-1]]


def factors(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which suffixes of a suffix order have a longest previous factor that reaches the length.

    It is the longer one of the common prefixes with the previous and the next smaller place in suffix order. Both are
    looked for among neighbours whose common prefixes reach the length (same: with the one before), by pointers that skip
    whatever stands later in the corpus.
    """
    n = len(order)
    found = np.zeros(n, bool)
    for near in (np.where(same, np.arange(n) - 1, -1), np.where(np.r_[same[1:], False][:n], np.arange(n) + 1, -1)):
        open_ = np.flatnonzero(near >= 0)
        while len(open_):
            open_ = open_[order[near[open_]] > order[open_]]
            near[open_] = near[near[open_]]
            open_ = open_[near[open_] >= 0]
        found |= near >= 0
    return found


def _spans_of(doc: np.ndarray, cid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Removed starts to (doc, cid, from, to) runs."""
    order = np.lexsort((start, cid, doc))
    doc, cid, start = doc[order], cid[order], start[order]
    fresh = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (cid[1:] != cid[:-1]) | (start[1:] > start[:-1] + LENGTH)][: len(start)])
    return doc[fresh], cid[fresh], start[fresh], start[np.r_[fresh[1:] - 1, len(start) - 1][: len(fresh)]] + LENGTH


def _runs(n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] numbers each, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


_SCHEMA = "bucket int, kind int, n long, blob binary"


def _rows(bucket: np.ndarray, kind: int, *cols: np.ndarray):
    """Columns as one blob for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order].astype(np.int32), [c[order] for c in cols]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(bucket)][: len(cuts)]
    blobs = [b"".join(c[s:e].tobytes() for c in cols) for s, e in zip(cuts, ends, strict=True)]
    if blobs:
        yield _batch(bucket[cuts], kind, ends - cuts, blobs)


def _batch(bucket, kind: int, n, blobs):
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "n", "blob"])


_U8, _I8, _I4, _U1 = (np.dtype(x) for x in ("u8", "i8", "i4", "u1"))


def _of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key.view(_U64) >> _U64(32)) % _U64(buckets)).astype(np.int32)


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return _of(text.mix(doc.view(_U64).copy()), buckets)


def _anchor_rows(buckets: int):
    """(text, cid) to blobs: kind 0, anchors (hash, cid, place, known to repeat) for their hash's bucket; kind 1, (cid, place) that repeat."""

    def settle(held):
        h, cid, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, cid, h))
        h, cid, place = h[order], cid[order], place[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (cid[1:] != cid[:-1]) | (place[1:] != place[:-1])]
        h, cid, place = h[fresh], cid[fresh], place[fresh]
        first = np.r_[True, h[1:] != h[:-1]]
        known = first & np.r_[~first[1:], False]
        yield from _rows(_of(h[first], buckets), 0, h[first], cid[first], place[first].astype(_I4), known[first].astype(_U1))
        yield from _rows(_doc_bucket(cid[~first], buckets), 1, cid[~first], place[~first].astype(_I4))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in text.chunks(batch, "text"):
                data, offsets = text.buffer(part.column("text"))
                h, place, _, _ = anchors(data, offsets)
                doc = np.searchsorted(offsets, place, "right") - 1
                held.append((h, part.column("cid").to_numpy()[doc], place - offsets[doc]))
                size += len(h)
                if size >= ANCHORS:
                    yield from settle(held)
                    held, size = [], 0
        if size:
            yield from settle(held)

    return run


def _repeated(buckets: int):
    """A bucket's anchors to (cid, place) of those that repeat, for their text's bucket."""

    def run(batches):
        parts = []
        for batch in batches:
            for kind, n, blob in zip(batch.column("kind").to_pylist(), batch.column("n").to_pylist(), batch.column("blob"), strict=True):
                if kind == 1:
                    yield from _rows(_doc_bucket(shared.unpack(n, blob.as_buffer(), [_I8, _I4])[0], buckets), 1, *shared.unpack(n, blob.as_buffer(), [_I8, _I4]))
                else:
                    parts.append(shared.unpack(n, blob.as_buffer(), [_U8, _I8, _I4, _U1]))
        if not parts:
            return
        h, cid, place, known = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, cid, h))
        h, cid, place, known = h[order], cid[order], place[order], known[order]
        cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        which = np.repeat(np.arange(len(cuts)), np.diff(np.r_[cuts, len(h)]))
        fresh = np.r_[True, (h[1:] != h[:-1]) | (cid[1:] != cid[:-1]) | (place[1:] != place[:-1])]
        keep = fresh & ((np.add.reduceat(fresh.astype(np.int64), cuts) > 1) | (np.add.reduceat(known.astype(np.int64), cuts) > 0))[which]
        yield from _rows(_doc_bucket(cid[keep], buckets), 1, cid[keep], place[keep])

    return run


def _by_text(batches):
    """(cid, place) blobs of a bucket to a row for each text: its repeated anchors' places."""
    parts = [shared.unpack(n, blob.as_buffer(), [_I8, _I4]) for batch in batches for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob"), strict=True)]
    if not parts:
        return
    cid, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, cid))
    cid, place = cid[order], place[order]
    cuts = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
    ends = np.r_[cuts[1:], len(cid)]
    for s in range(0, len(cuts), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(cid[cuts[s : s + 4096]]), pa.array([place[a:b].tobytes() for a, b in zip(cuts[s : s + 4096], ends[s : s + 4096], strict=True)], pa.binary())], names=["cid", "places"])


class _Portion:
    """Bytes around anchors: a row for each anchor (hash, doc, cid, first start, number of starts), and its bytes."""

    kinds = [_U8, _I8, _I8, _I4, _U1]

    def __init__(self, cols: list[np.ndarray], raw: np.ndarray):
        self.cols, self.raw = cols, raw
        self.size = cols[4].astype(np.int64) + LENGTH - 1
        self.begin = np.cumsum(self.size) - self.size

    def settle(self) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """(doc, cid, start) of the starts whose string starts earlier within the portion, and which anchors have any other start."""
        _, doc, cid, lo, many = self.cols
        corpus = np.lexsort((lo, cid, doc))
        # A repeated row is the same text, not a copy of it.
        corpus = corpus[np.r_[True, np.any([np.diff(c[corpus]) != 0 for c in (doc, cid, lo)], axis=0)]]
        n = many.astype(np.int64)[corpus]
        row = np.repeat(corpus, n)
        at = _runs(n, lo.astype(np.int64)[corpus])
        order, same = suffix_order(self.raw, _runs(n, self.begin[corpus]))
        later = np.zeros(len(row), bool)
        later[order[factors(order, same)]] = True
        first = np.zeros(len(doc), bool)
        first[row[~later]] = True
        return (doc[row[later]], cid[row[later]], at[later]), first

    def pick(self, keep: np.ndarray) -> _Portion:
        raw = self.raw[_runs(self.size[keep], self.begin[keep])]
        return _Portion([c[keep] for c in self.cols], raw)


def _around_rows(buckets: int):
    """(doc_id, cid, text, places) to blobs: kind 0, bytes around anchors for the hash's bucket; kind 1, spans for the text's."""

    def settle(held):
        portion = _Portion([np.concatenate(x) for x in zip(*(c for c, _ in held), strict=True)], np.concatenate([r for _, r in held]))
        (doc, cid, start), first = portion.settle()
        if len(doc):
            spans = _spans_of(doc, cid, start)
            yield from _rows(_doc_bucket(spans[1], buckets), 1, spans[0], spans[1], spans[2].astype(_I4), spans[3].astype(_I4))
        bucket = _of(portion.cols[0], buckets)
        order = np.argsort(bucket, kind="stable")
        order = order[first[order]]
        portion, bucket = portion.pick(order), bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        ends = np.r_[cuts[1:], len(bucket)][: len(cuts)]
        blobs = [b"".join(c[s:e].tobytes() for c in portion.cols) + portion.raw[portion.begin[s] : portion.begin[e - 1] + portion.size[e - 1]].tobytes() for s, e in zip(cuts, ends, strict=True)]
        if blobs:
            yield _batch(bucket[cuts], 0, ends - cuts, blobs)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in text.chunks(batch, "text"):
                data, offsets = text.buffer(part.column("text"))
                h, place, lo, hi = anchors(data, offsets)
                doc = np.searchsorted(offsets, place, "right") - 1
                wanted = np.concatenate([np.frombuffer(p, _I4) + o for p, o in zip(part.column("places").to_pylist(), offsets[:-1], strict=True)])
                keep = np.isin(place, wanted)
                h, lo, hi, doc = h[keep], lo[keep], hi[keep], doc[keep]
                if len(h):
                    many = hi - lo + 1
                    raw = data[_runs(many + LENGTH - 1, lo)]
                    held.append(([h, part.column("doc_id").to_numpy()[doc], part.column("cid").to_numpy()[doc], (lo - offsets[doc]).astype(_I4), many.astype(_U1)], raw))
                    size += len(raw)
                if size >= BYTES:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    return run


def _factor_rows(buckets: int):
    """A bucket's bytes around anchors to the spans that start earlier; spans settled before pass through."""

    def run(batches):
        cols, raws = [], []
        for batch in batches:
            for kind, n, blob in zip(batch.column("kind").to_pylist(), batch.column("n").to_pylist(), batch.column("blob"), strict=True):
                if kind == 1:
                    spans = shared.unpack(n, blob.as_buffer(), [_I8, _I8, _I4, _I4])
                    yield from _rows(_doc_bucket(spans[1], buckets), 1, *spans)
                else:
                    cols.append(shared.unpack(n, blob.as_buffer(), _Portion.kinds))
                    raws.append(np.frombuffer(blob.as_buffer(), np.uint8)[n * sum(k.itemsize for k in _Portion.kinds) :])
        if not cols:
            return
        every = [np.concatenate(x) for x in zip(*cols, strict=True)]
        raw = np.concatenate(raws)
        # Suffixes of different anchors never agree, so a bucket is worked on in slices of whole anchors' hashes.
        size = every[4].astype(np.int64) + LENGTH - 1
        slices = max(1, len(raw) // BYTES)
        part = (text.mix(every[0].copy()) % _U64(slices)).astype(np.int64)
        portion = _Portion(every, raw)
        for k in range(slices):
            keep = np.flatnonzero(part == k)
            if len(keep):
                (doc, cid, start), _ = portion.pick(keep).settle()
                if len(doc):
                    spans = _spans_of(doc, cid, start)
                    yield from _rows(_doc_bucket(spans[1], buckets), 1, spans[0], spans[1], spans[2].astype(_I4), spans[3].astype(_I4))

    return run


def _merged(batches):
    """Span blobs of a bucket to a row for each text: its removed runs, merged."""
    parts = [shared.unpack(n, blob.as_buffer(), [_I8, _I8, _I4, _I4]) for batch in batches for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob"), strict=True)]
    if not parts:
        return
    doc, cid, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, cid, doc))
    doc, cid, start, end = doc[order], cid[order], start[order], end[order].astype(np.int64)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (cid[1:] != cid[:-1])]
    # The running end within a text: texts are numbered, and a higher one starts above every end before it.
    base = (np.cumsum(new) - 1) * (int(end.max()) + 1)
    top = np.maximum.accumulate(end + base) - base
    fresh = np.flatnonzero(np.r_[True, new[1:] | (start[1:] > top[:-1])])
    last = np.r_[fresh[1:] - 1, len(start) - 1]
    doc, cid, runs = doc[fresh], cid[fresh], np.stack([start[fresh].astype(_I4), top[last].astype(_I4)], axis=1)
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (cid[1:] != cid[:-1])])
    ends = np.r_[cuts[1:], len(doc)]
    for s in range(0, len(cuts), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(doc[cuts[s : s + 4096]]), pa.array(cid[cuts[s : s + 4096]]), pa.array([runs[a:b].tobytes() for a, b in zip(cuts[s : s + 4096], ends[s : s + 4096], strict=True)], pa.binary())], names=["doc_id", "cid", "runs"])


#: A null doc_id stands after all others in the corpus.
_LAST = (1 << 63) - 1


def removed_spans(docs: DataFrame, doc: str = "doc_id", column: str = "text") -> DataFrame:
    """docs with copy__ (all of the text goes) and runs__ (its removed runs of UTF-8 bytes [from, to) as int32 pairs; null if none).

    The order is by doc_id (null last) and start. Rows with the same doc_id and different texts are different texts of
    one place, in ascending order of their hash (Spark's xxhash64 of the UTF-8 bytes, signed); fully equal rows are the same
    text and get the same runs. Whole later copies are told by two 64-bit hashes and their length. Texts under LENGTH
    bytes and empty ones lose nothing. All columns of docs are kept (where one ends in two underscores, the new ones have
    more, see shared.namer()); an empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = shared.n_buckets(spark)
    place, content = F.coalesce(F.col(doc).cast("long"), F.lit(_LAST)), F.xxhash64(F.coalesce(F.col(column), F.lit("")))
    texts = docs.select(place.alias("doc_id"), F.col(column).alias("text"), content.alias("cid")).where(F.octet_length("text") >= LENGTH)
    scratch = shared.Scratch(spark)
    whole = ["cid", "n", "check"]
    heads = scratch.table(texts.select("doc_id", "cid", F.octet_length("text").alias("n"), F.xxhash64(F.lit(LENGTH), "text").alias("check")).distinct(), "heads")
    firsts = scratch.table(heads.groupBy(whole).agg(F.min("doc_id").alias("first")), "firsts")

    found = texts.select("text", "cid").mapInArrow(shared.tidy(_anchor_rows(buckets)), _SCHEMA)
    places = shared.route(shared.route(found, buckets).mapInArrow(shared.tidy(_repeated(buckets)), _SCHEMA), buckets).mapInArrow(shared.tidy(_by_text), "cid long, places binary")
    places = scratch.table(places.join(firsts.select("cid", F.col("first").alias("doc_id")), "cid"), "places")
    around = texts.join(places, ["doc_id", "cid"]).select("doc_id", "cid", "text", "places").mapInArrow(shared.tidy(_around_rows(buckets)), _SCHEMA)
    spans = shared.route(shared.route(around, buckets).mapInArrow(shared.tidy(_factor_rows(buckets)), _SCHEMA), buckets).mapInArrow(shared.tidy(_merged), "doc_id long, cid long, runs binary")
    copies = heads.join(firsts, whole).where("doc_id > first").select("doc_id", "cid", F.lit(True).alias("copy"), F.lit(None).cast("binary").alias("runs"))
    marks = shared.table(spans.select("doc_id", "cid", F.lit(False).alias("copy"), "runs").unionByName(copies), "spans")
    scratch.clear()

    name = shared.namer(docs.columns)
    keyed = docs.select(*(F.col(f"`{c}`") for c in docs.columns), place.alias(name("doc")), content.alias(name("cid")))
    marks = marks.select(F.col("doc_id").alias(name("doc")), F.col("cid").alias(name("cid")), F.col("copy").alias(name("copied")), F.col("runs").alias(name("runs")))
    joined = keyed.join(marks, [name("doc"), name("cid")], "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(name("copied"), F.lit(False)).alias(name("copy")), name("runs"))


def cut(raw: bytes, copy: bool, runs: bytes | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its removed runs."""
    if copy:
        return b"", [(0, len(raw))]
    if not runs:
        return raw, []
    pairs = np.frombuffer(runs, _I4).reshape(-1, 2).tolist()
    kept, at = [], 0
    for s, e in pairs:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]]), [(s, e) for s, e in pairs]


def _digests(batches):
    for batch in batches:
        out = []
        for doc, s, copy, runs in zip(*(batch.column(k) for k in ("doc_id", "text", "copy__", "runs__")), strict=True):
            raw = (s.as_py() or "").encode()
            kept, gone = cut(raw, copy.as_py(), runs.as_py())
            out.append((doc.as_py(), len(raw), sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept).hexdigest()))
        if out:
            doc, *rest, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array(x, pa.int64()) for x in rest), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digests(docs: DataFrame, doc: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; see removed_spans()."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(column).alias("text"))
    return removed_spans(slim).select("doc_id", "text", "copy__", "runs__").mapInArrow(shared.tidy(_digests), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut_texts(column: str, copied: str, spans: str):
    def run(batches):
        for batch in batches:
            kept = []
            for s, copy, runs in zip(batch.column(column), batch.column(copied).to_pylist(), batch.column(spans), strict=True):
                s, runs = s.as_py(), runs.as_py()
                kept.append(cut(s.encode(), copy, runs)[0].decode("utf-8", "ignore") if s and (copy or runs) else s)
            fresh = pa.array(kept, batch.schema.field(column).type)
            names = [c for c in batch.schema.names if c not in (copied, spans)]
            yield pa.RecordBatch.from_arrays([fresh if c == column else batch.column(c) for c in names], names=names)

    return run


def remove_repeats(docs: DataFrame, doc: str = "doc_id", column: str = "text") -> DataFrame:
    """docs with repeated strings cut out of their texts; a code point that loses some of its bytes loses all. Null stays null."""
    name = shared.namer(docs.columns)
    return removed_spans(docs, doc, column).mapInArrow(shared.tidy(_cut_texts(column, name("copy"), name("runs"))), docs.schema)
