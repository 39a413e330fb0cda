"""Best-fit packing of tokenised documents into sequences, with bins certified by dual-feasible-function bounds.

1. A document's ids (and a closing id 0) are cut into pieces only where they exceed the capacity. Full pieces are
   sequences by themselves.
2. The other pieces are dealt to partitions by a hash, so each has a similar mix of lengths, and packed there by best-fit
   decreasing. A lower bound certifies a partition whose bin count equals it: its bins are final (so a partition of
   PIECES pieces may have one bin more than its share of the whole).
3. Partitions with a gap between bins and bound exchange documents: each gives up its least filled bins, groups of
   partitions pool them and run best-fit decreasing again, and keep the new bins if they are fewer. What is certified
   then is final, the rest goes to groups of groups, until one is left or nothing is given up.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import shared, text

CAPACITY = 2048
#: Pieces in a partition, partitions that pool what they give up, and bins that one gives up.
PIECES, POOL, GIVEN = 150_000, 64, 48
#: Words whose ids a task keeps, and bytes of text that it works on at once.
_KEPT_WORDS, _CHUNK = 1_200_000, 2 << 20

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Longer runs of punctuation stay with their word.
_MARKS = 4


class Vocabulary:
    """A tokenizer, and the ids of words that it has seen.

    Tokens of this kind of vocabulary never span white space, nor a letter and the punctuation that ends its word; so a
    text is cut into such words, each different one is encoded once, and ids are gathered from there. Case doesn't
    matter to the vocabulary, so A-Z are one with a-z. Words with "<", where special tokens may be, are left as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # no word comes twice
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        # Sorted hashes of words, where each word's ids begin, and how many they are.
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def _has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, sizes): the words' numbers in the order of their ids, and how many ids each has.

        Words of letters alone are encoded in one string: each has one token that ends a word.
        """
        order, ids, sizes, rest = [], [], [], [k for k, w in enumerate(words) if not w.isalpha()]
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        for s in range(0, len(plain), 4000):
            part = plain[s : s + 4000]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join([words[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[got]) + 1
            if len(last) == len(part) and last[-1] == len(got):
                order += part
                ids.append(got)
                sizes.append(np.diff(last, prepend=0))
            else:
                rest += part
        if rest:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
            order += rest
            sizes.append(np.array([len(x) for x in each]))
            ids.append(np.array([k for x in each for k in x], "<u4"))
        return np.array(order, np.int64), np.concatenate(ids), np.concatenate(sizes).astype(np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts) of texts, each closed by an id 0."""
        starts, ends = text.bounds(data, offsets)
        signs = np.r_[0, np.cumsum(data == 60)]
        plain = signs[ends] == signs[starts]
        run, more = np.zeros(len(starts), np.int64), plain.copy()
        for _ in range(_MARKS + 1):
            more &= (ends - run > starts) & _MARK[data[np.maximum(ends - 1 - run, 0)]]
            run += more
        tail = plain & (run > 0) & (run <= _MARKS) & (ends - run > starts) & _LETTER[data[np.maximum(ends - 1 - run, 0)]]
        doc = np.searchsorted(starts, offsets)
        units = np.r_[0, np.cumsum(1 + tail)]
        first, doc = units[:-1], units[doc]
        begin = np.repeat(starts, 1 + tail)
        end = np.repeat(ends, 1 + tail)
        end[first[tail]] -= run[tail]
        begin[first[tail] + 1] = (ends - run)[tail]
        hashes = text.spans_hash(text.LOWER[data], begin, end)
        special = np.flatnonzero(signs[end] > signs[begin])
        if len(special):
            hashes[special] = text.mix(text.spans_hash(data, begin[special], end[special]) + np.uint64(1))
        every, at, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(every) > _KEPT_WORDS:
            self.forget()
        fresh = np.flatnonzero(~self._has(every))
        if len(fresh):
            raw = data.tobytes()
            order, ids, size = self._encode([raw[s:e].decode("utf-8", "replace") for s, e in zip(begin[at[fresh]].tolist(), end[at[fresh]].tolist(), strict=True)])
            hashes = np.r_[self.hashes, every[fresh[order]]]
            order = np.argsort(hashes, kind="stable")
            self.begin = np.r_[self.begin, len(self.ids) + (np.cumsum(size) - size).astype(np.int32)][order]
            self.hashes, self.size, self.ids = hashes[order], np.r_[self.size, size][order], np.r_[self.ids, ids]
        slot = np.searchsorted(self.hashes, every)[place]
        # A unit's ids, and after a text's last unit its id 0.
        n = self.size[slot].astype(np.int64)
        total = np.r_[0, np.cumsum(n)]
        cuts = total[doc] + np.arange(len(doc))
        ids = np.zeros(cuts[-1], "<u4")
        if len(slot):
            shift = np.repeat(np.searchsorted(doc[1:], np.arange(len(slot)), "right"), n)
            source = np.repeat(self.begin[slot] - total[:-1], n) + np.arange(total[-1])
            ids[np.arange(total[-1]) + shift] = self.ids[source]
        return ids, cuts


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _cut(path: str, capacity: int):
    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for part in text.chunks(batch, "text", _CHUNK):
                ids, cuts = words.encode(*text.buffer(part.column("text")))
                raw, rows = ids.tobytes(), []
                for doc, s, e in zip(part.column("doc_id").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    rows += [(doc, k, a - s, min(capacity, e - a), zlib.crc32(raw[4 * a : 4 * min(a + capacity, e)])) for k, a in enumerate(range(s, e, capacity))]
                doc, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """At least so many bins, by the best of several dual feasible functions (in integers throughout)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(object if len(lengths) > 1 << 40 else np.int64)
    x = np.arange(capacity + 1)
    best = -(-int(count @ x) // capacity)
    for k in range(1, 21):
        # x if (k + 1) x is whole, else the floor of (k + 1) x over k; all times k and the capacity.
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int(count @ value) // (k * capacity)))
    mass, number = np.cumsum(count * x), np.cumsum(count)
    cut = np.arange(capacity // 2 + 1)
    # Below the cut nothing, above its complement a whole bin, between them the length itself.
    between = mass[capacity - cut] - np.where(cut > 0, mass[cut - 1], 0)
    large = number[-1] - number[capacity - cut]
    return max(best, int((large + -(-between // capacity)).max()))


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length by best-fit decreasing, and how full each bin is."""
    order = np.argsort(-lengths, kind="stable")
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps, bins = 0, 0
    where, offset, full = [0] * len(lengths), [0] * len(lengths), []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = gaps >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, b = capacity, bins
            bins += 1
            full.append(0)
        where[i], offset[i] = b, full[b]
        full[b] += n
        if gap - n:
            by_gap[gap - n].append(b)
            gaps |= 1 << (gap - n)
    return np.array(where, np.int64), np.array(offset, np.int64), np.array(full, np.int64)


_PACKED = "part long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, given boolean, certified boolean, bins long, bound long"


def _pack(capacity: int, give: int):
    """A group's pieces packed; bin and offset are the ones that it had before, if any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        where, offset, full = best_fit(lengths, capacity)
        if "old" in pdf and len(full) >= pdf["old"].nunique():
            where, offset = pd.factorize(pdf["old"])[0].astype(np.int64), pdf["offset"].to_numpy()
            full = np.bincount(where, lengths).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        out = pdf.assign(bin=where, offset=offset, certified=len(full) == bound, bins=len(full), bound=bound)
        # The certificate decides: no other packing of these pieces has fewer bins, so they stay.
        loose = np.argsort(full, kind="stable")[: give if len(full) > bound else 0]
        given = np.zeros(len(full), bool)
        given[loose[full[loose] < capacity]] = True
        return out.assign(given=given[where])[[c.split()[0] for c in _PACKED.split(", ")]]

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; tokenizer: the vocabulary file's path on all machines."""
    slim = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(column).alias("text"))
    return slim.mapInArrow(shared.tidy(_cut(tokenizer, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces() with sequence_id, offset, and certified, bins and bound of the last partition that packed the piece: whether it met its lower bound, and both numbers.

    Ties in length go by doc_id and piece. Equal rows are pieces of their own, dealt to partitions by their place in the
    table of pieces, so repeated rows or null doc_ids don't meet in one.
    """
    cut = shared.table(cut, "pieces")
    whole = cut.where(F.col("length") >= capacity)
    rest = cut.where(F.col("length") < capacity)
    # The place of a row in a written table is the same whenever it is read with the same settings.
    parts = max(1, -(-rest.count() // PIECES))
    now = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)))
    done, level = [], 0
    while True:
        last = parts == 1
        schema = _PACKED
        packed = shared.table(now.groupBy("part").applyInPandas(_pack(capacity, 0 if last else GIVEN), schema), "packed")
        done.append(packed.where("not given").withColumn("sequence_id", (F.lit(level << 54) + F.shiftleft("part", 20) + F.col("bin"))))
        if last or shared.empty(packed.where("given")):
            break
        now = packed.where("given").withColumn("old", F.shiftleft("part", 20) + F.col("bin")).withColumn("part", F.floor(F.col("part") / POOL).cast("long"))
        now = now.select("part", "doc_id", "piece", "start", "length", "ids_crc32", "old", "offset")
        parts, level = -(-parts // POOL), level + 1
    out = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "certified": F.lit(True), "bins": F.lit(1).cast("long"), "bound": F.lit(1).cast("long")})
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified", "bins", "bound"]
    out = out.select(cols)
    for d in done:
        out = out.unionByName(d.select(cols))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents packed. A null or empty text is one piece of one id (0); a null doc_id stays null; an empty table gives none."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
