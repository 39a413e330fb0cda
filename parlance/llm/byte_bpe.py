"""Byte-level BPE: distinct words are encoded by a fold of Spark's higher-order functions, texts by looking their words up.

A text is cut into the matches of a byte-level tokenizer's pattern ("words"). Then

1. every task gives the different words of its portions, buckets (ranges of a word's hash) keep each word once;
2. a bucket's words are folded: a word is the array of its bytes, each step merges the leftmost adjacent pair of the
   lowest rank, and ranks come from a literal map in the plan (cells of a map each, as a map's lookup is linear);
3. buckets write words' hashes and ids as sorted arrays to the shared folder, and tasks that encode map them.

A looked-up word's ids are decoded and compared with its bytes, so a word whose hash is another's is noticed. Such words,
and those over LONG bytes, for which a fold would take squared time, are merged where they stand with a heap. Decoding
concatenates the ids' binary pieces.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import shared, text

_U64 = np.uint64
#: Cells of the rank map, and a rank that no pair has.
CELLS, NONE = 4_096, 2**31 - 1
#: Longer words, in bytes, aren't folded. Bytes of text that are cut into words at once, and words that a task holds.
LONG, BLOCK, PORTION = 1_024, 2 << 20, 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


# --- Words of a text ---

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of every code point: letter, number, white space, or other."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            s, e = ord(m[0][0]), ord(m[0][-1])
            kinds[s : e + 1] = kind
    kinds[0xD800:0xE000] = _OTHER
    return kinds


def words(raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some texts begin and end, in bytes: all matches, text by text, of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    raw has the texts' UTF-8 one after the other, edges the n + 1 places where they begin. Matches cover all of a text,
    so a word ends where the next one begins.
    """
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    point = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    at = np.r_[0, np.cumsum(1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))]
    kind, n = _kinds()[point], len(point)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, edges)] = True
    last = first[1:]
    # A word begins where the kind changes, and with every text.
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # The last of a run of white space, if another word of the text follows it, is no longer the run's; a blank begins that word.
    ends_run = space & ~last
    ends_run[:-1] &= ~space[1:]
    begins[ends_run] = True
    begins[1:][(ends_run & (point == 0x20))[:-1]] = False
    # An apostrophe alone, with no blank before it, takes the letters of a contraction.
    lone = np.flatnonzero((point[:-1] == 0x27) & begins[:-1] & (kind[1:] == _LETTER) & ~first[1:n])
    if len(lone):
        far = np.minimum(lone + 2, n - 1)
        one, two = point[lone + 1], np.where((far == lone + 2) & ~first[far], point[far], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(lone), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        begins[lone[short | long] + 1] = False
        for size, which in ((2, short), (3, long)):
            after = lone[which] + size
            begins[after[after < n]] = True
    starts = np.flatnonzero(begins)
    return at[starts], np.r_[at[starts[1:]], len(raw)]


def _blocks(batch: pa.RecordBatch, column: str):
    """(raw, edges, rows) of texts of about BLOCK bytes; a longer text comes in several, cut before white space that follows a word.

    No word reaches over such a place, and none looks at what is before it.
    """
    held, rows, size = [], [], 0
    for row, value in enumerate(batch.column(column)):
        raw = (value.as_py() or "").encode()
        while raw:
            part, cut = raw, BLOCK
            if len(raw) > 2 * BLOCK and (m := _CUT.search(raw, BLOCK)):
                part, cut = raw[: m.start() + 1], m.start() + 1
            raw = raw[len(part) :]
            held.append(part)
            rows.append(row)
            size += len(part)
            if size >= BLOCK:
                yield b"".join(held), np.cumsum([0, *map(len, held)]), np.array(rows)
                held, rows, size = [], [], 0
    if held:
        yield b"".join(held), np.cumsum([0, *map(len, held)]), np.array(rows)


_CUT = regex.compile(rb"[!-~](?=[ \t\n\r])")


# --- The fold ---


def rank_map(ranks: dict[bytes, int]) -> Column:
    """Ranks by the hexadecimal digits of a token, as a literal: CELLS maps, of which a checksum tells the token's."""
    cells: list[dict] = [{} for _ in range(CELLS)]
    for token, rank in ranks.items():
        digits = token.hex().upper()
        cells[zlib.crc32(digits.encode()) % CELLS][digits] = rank
    return F.from_json(F.lit(json.dumps(cells)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merge(word: Column, ranks: Column) -> Column:
    """The ids of a word (binary): its own if it is a token, else those of its bytes after all merges."""

    def folded(table: Column) -> Column:
        rank = lambda x: F.element_at(F.element_at(table, (F.crc32(x.cast("binary")) % CELLS + 1).cast("int")), x)
        pair = lambda x, y: F.coalesce(rank(F.concat(x, y)), F.lit(NONE))
        none = F.array().cast("array<int>")

        def step(state: Column, k: Column) -> Column:
            """The state after merging its pieces k and k + 1."""
            p, r = state["p"], state["r"]
            joined = F.concat(F.element_at(p, k), F.element_at(p, k + 1))
            left = F.when(k > 1, F.array(pair(F.element_at(p, k - 1), joined))).otherwise(none)
            right = F.when(k < F.size(r), F.array(pair(joined, F.try_element_at(p, k + 2)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), k - 1), F.array(joined), F.slice(p, k + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, F.size(p))).alias("r"),
            )

        def next_state(state: Column) -> Column:
            low = F.coalesce(F.array_min(state["r"]), F.lit(NONE))
            place = _let(low, lambda x: F.when(x < NONE, F.array_position(state["r"], x).cast("int")).otherwise(0))
            return _let(place, lambda k: F.when(k > 0, step(state, k)).otherwise(state))

        def pieces_merged(pieces: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: pair(F.element_at(pieces, k), F.element_at(pieces, k + 1)))
            done = F.aggregate(F.sequence(F.lit(2), F.size(pieces)), F.struct(pieces.alias("p"), pairs.alias("r")), lambda state, _: next_state(state))
            return F.transform(done["p"], rank)

        digits = F.hex(word)
        merged = _let(F.regexp_extract_all(digits, F.lit(".."), F.lit(0)), pieces_merged)
        return _let(rank(digits), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(merged))

    return _let(ranks, folded)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() of one word in time n log n: pairs wait in a heap by rank and place, pieces are linked."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone, heap = [False] * n, []

    def wait(a: int):
        if (b := end[a]) < n and (r := ranks.get(word[a : end[b]])) is not None:
            heap.append((r, a, b, end[b])) if start else heapq.heappush(heap, (r, a, b, end[b]))

    start = True
    for a in range(n - 1):
        wait(a)
    start = False
    heapq.heapify(heap)
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if gone[a] or end[a] != b or gone[b] or end[b] != stop:
            continue
        end[a], gone[b] = stop, True
        if stop < n:
            before[stop] = a
        wait(a)
        if before[a] >= 0:
            wait(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


# --- The dictionary of words ---

_ASKED = "bucket int, hash long, word binary"


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U64(32)) * _U64(buckets) >> _U64(32)).astype(np.int32)


def _word_rows(hashes: np.ndarray, all_words: list[bytes], buckets: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_bucket(hashes, buckets)), pa.array(hashes.view(np.int64)), pa.array(all_words, pa.binary())], names=["bucket", "hash", "word"])


def _spans(raw: bytes, edges: np.ndarray):
    data = np.frombuffer(raw, np.uint8)
    starts, ends = words(raw, edges)
    return data, starts, ends, text.spans_hash(data, starts, ends)


def _different(column: str, buckets: int):
    """Texts to the different words of a portion, those over LONG bytes left out."""

    def run(batches):
        held: dict[int, bytes] = {}
        for batch in batches:
            for raw, edges, _ in _blocks(batch, column):
                _, starts, ends, hashes = _spans(raw, edges)
                few, first = np.unique(hashes, return_index=True)
                for h, s, e in zip(few.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True):
                    if h not in held and e - s <= LONG:
                        held[h] = raw[s:e]
                if len(held) >= PORTION:
                    yield _word_rows(np.array([*held], _U64), [*held.values()], buckets)
                    held = {}
        if held:
            yield _word_rows(np.array([*held], _U64), [*held.values()], buckets)

    return run


def _once(batches):
    """A bucket's words, one of each hash, in order of it."""
    held: dict[int, bytes] = {}
    for batch in batches:
        for h, w in zip(batch.column("hash").to_numpy().view(_U64).tolist(), batch.column("word").to_pylist(), strict=True):
            # Of two words of one hash the smaller, so that a task that runs again gives the same.
            held[h] = min(held.get(h, w), w)
    order = sorted(held)
    for s in range(0, len(order), 2_000):
        some = order[s : s + 2_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(some, _U64).view(np.int64)), pa.array([held[h] for h in some], pa.binary())], names=["hash", "word"])


def _saved(folder: str):
    """A bucket's words and ids as arrays of the shared folder; gives their number."""

    def run(batches):
        hashes, sizes, ids = [], [], []
        for batch in batches:
            column = batch.column("ids")
            hashes.append(batch.column("hash").to_numpy().view(_U64))
            sizes.append(np.diff(column.offsets.to_numpy()))
            ids.append(column.flatten().to_numpy())
        if not hashes:
            return
        k = TaskContext.get().partitionId()
        hashes = np.concatenate(hashes)
        shared.save_array(folder, f"hash-{k}", hashes)
        shared.save_array(folder, f"cut-{k}", np.cumsum(np.r_[0, np.concatenate(sizes)]).astype(np.int64))
        shared.save_array(folder, f"ids-{k}", np.concatenate(ids).astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array([len(hashes)], pa.int64())], names=["n"])

    return run


class Vocabulary:
    """Tokens of a rank file: ranks by bytes, and the bytes of ids one after the other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([*map(len, pieces)], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.data[text.ragged(self.start[ids], self.size[ids])]


class Dictionary:
    """The arrays of a folder that words are looked up in."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets = folder, buckets

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of ascending hashes: size 0 where there is none."""
        cuts = np.searchsorted(_bucket(hashes, self.buckets), np.arange(self.buckets + 1))
        sizes, found = np.zeros(len(hashes), np.int64), [np.zeros(0, np.uint32)]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[b], cuts[b + 1])
            keys, cut, ids = (shared.load_array(self.folder, f"{name}-{b}", kind) for name, kind in (("hash", "u8"), ("cut", "i8"), ("ids", "u4")))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes[own]), len(keys) - 1)
                has = keys[at] == hashes[own]
                sizes[own] = np.where(has, cut[at + 1] - cut[at], 0)
                found.append(ids[text.ragged(cut[at], sizes[own])])
        return np.concatenate(found), sizes


def _ids_of(raw: bytes, edges: np.ndarray, dictionary: Dictionary, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts one after the other, and their n + 1 cuts."""
    data, starts, ends, hashes = _spans(raw, edges)
    few, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    ids, sizes = dictionary.find(few)
    # Right are those whose ids decode to the word.
    at = np.cumsum(sizes) - sizes
    width = np.r_[0, np.cumsum(vocabulary.size[ids])]
    long = ends[first] - starts[first]
    right = (width[at + sizes] - width[at] == long) & (sizes > 0)
    ids, at, sizes = ids[text.ragged(at[right], sizes[right])], None, np.where(right, sizes, 0)
    same = vocabulary.decode(ids) == data[text.ragged(starts[first][right], long[right])]
    if not same.all():
        right[np.flatnonzero(right)[~np.logical_and.reduceat(same, np.cumsum(long[right]) - long[right])]] = False
    at, more = np.cumsum(sizes) - sizes, len(ids)
    others = [np.array(merge_long(raw[starts[first[k]] : ends[first[k]]], vocabulary.ranks), np.uint32) for k in np.flatnonzero(~right)]
    at[~right] = more + np.cumsum([0, *map(len, others)])[:-1]
    sizes[~right] = [len(x) for x in others]
    ids = np.concatenate([ids, *others])
    of_word = sizes[which]
    total = np.r_[0, np.cumsum(of_word)]
    return ids[text.ragged(at[which], of_word)], total[np.searchsorted(starts, edges)]


def _encoded(column: str, out: str, dictionary: Dictionary, vocabulary):
    def run(batches):
        for batch in batches:
            parts: list[list] = [[] for _ in range(batch.num_rows)]
            for raw, edges, rows in _blocks(batch, column):
                ids, cuts = _ids_of(raw, edges, dictionary, vocabulary.value)
                for row, s, e in zip(rows.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    parts[row].append(ids[s:e].astype("<u4").tobytes())
            rest = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([b"".join(x) for x in parts], pa.binary())], names=[*rest, out])

    return run


def encode(docs: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each text instead of it, as binary: unsigned 32-bit numbers, little-endian, in the column out.

    path is a rank file that the driver reads (it holds all 256 bytes). A null text counts as empty, and has no ids.
    Every row is encoded by itself, so nulls, repeats and ties in other columns change nothing; those columns are kept as
    they are, but for one that is named as out, which is replaced. An empty table gives an empty result. A text of any
    length is worked on in blocks; its ids are one value, so at most 2 GB.
    """
    spark = docs.sparkSession
    ranks = load_ranks(path)
    buckets, folder = shared.n_buckets(spark), shared.new_folder(spark, "bpe")
    found = docs.select(F.col(f"`{column}`").alias("text")).mapInArrow(shared.tidy(_different("text", buckets)), _ASKED)
    once = shared.route(found, buckets).mapInArrow(shared.tidy(_once), "hash long, word binary")
    folded = once.select("hash", merge(F.col("word"), rank_map(ranks)).alias("ids"))
    folded.mapInArrow(shared.tidy(_saved(folder)), "n long").agg(F.sum("n")).collect()
    kept = [c for c in docs.columns if c not in (column, out)]
    slim = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`"))
    schema = T.StructType([*slim.drop(column).schema.fields, T.StructField(out, T.BinaryType())])
    return slim.mapInArrow(shared.tidy(_encoded(column, out, Dictionary(folder, buckets), spark.sparkContext.broadcast(Vocabulary(ranks)))), schema)


def _decoded(column: str, out: str, vocabulary):
    def run(batches):
        for batch in batches:
            texts = [None if x is None else vocabulary.value.decode(np.frombuffer(x, "<u4")).tobytes() for x in batch.column(column).to_pylist()]
            rest = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.binary())], names=[*rest, out])

    return run


def decode(coded: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the bytes of each row's ids (as encode() gives them) in the column out; null stays null."""
    spark = coded.sparkSession
    slim = coded.select(*(F.col(f"`{c}`") for c in coded.columns if c != out))
    return slim.mapInArrow(shared.tidy(_decoded(column, out, spark.sparkContext.broadcast(Vocabulary(load_ranks(path))))), T.StructType([*slim.schema.fields, T.StructField(out, T.BinaryType())]))


def coding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: its text encoded, and decoded again."""
    coded = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)
    back = decode(coded, path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
