"""Vectorised work on Arrow text columns: word boundaries, word hashes and shingles over many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from parlance.llm import shared

U64 = np.uint64
#: Bytes of text that are worked on at once, unless one text is longer.
CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Two prime moduli under 2^31 with a base each: unlike a polynomial modulo 2^64, these tell Thue-Morse words apart.
_FIELDS = ((2_147_483_647, 1_190_494_759), (2_147_483_629, 1_606_938_045))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
shared.FORGET.append(_powers.clear)
#: Longer spans have their bytes' products reduced first: sums of this many products of 8 and 31 bits fit 64.
_EXACT = 1 << 24


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _series(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo prime, by doubling."""
    out = np.ones(n, np.uint32)
    made = 1
    while made < n:
        more = min(made, n - made)
        out[made : made + more] = out[:more].astype(U64) * U64(pow(base, made, prime)) % U64(prime)
        made += more
    return out


def powers(field: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a field's base, and of its inverse."""
    prime, base = _FIELDS[field]
    made = _powers.get(field)
    if made is None or len(made[0]) < n:
        size = n + (n >> 4)
        made = _series(base, prime, size), _series(pow(base, -1, prime), prime, size)
        if n <= 8 * CHUNK_BYTES:  # those of a very long text aren't kept
            _powers[field] = made
    return made[0][:n], made[1][:n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes (UTF-8) and its n + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text."""
    if not batch.num_rows:
        return
    offsets = buffer(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that aren't white space; no word crosses two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: its polynomials over two prime fields (62 bits), mixed with its length.

    Two different spans of n bytes meet for about (n / 2^31)^2 of all pairs of bases; the bases are fixed.
    """
    if not len(starts):
        return np.zeros(0, U64)
    size, value = (ends - starts).astype(U64), np.zeros(len(starts), U64)
    long = int(size.max()) > _EXACT
    prefix = np.zeros(len(data) + 1, U64)
    for field, (prime, _) in enumerate(_FIELDS):
        power, inverse = powers(field, len(data) + 1)
        product = (data.astype(U64) + U64(1)) * power[:-1]
        # Sums wrap, but the difference of two is right as long as a span's own sum fits.
        np.cumsum(product % U64(prime) if long else product, out=prefix[1:])
        value = value << U64(32) | (prefix[ends] - prefix[starts]) % U64(prime) * inverse[starts] % U64(prime)
    return mix(value + size * U64(0xD6E8FEB86659FD93))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans in turn: starts[0], starts[0] + 1, ... of sizes[0] places, then those of the next."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z lower-cased, and where each text's words begin (n + 1 cuts)."""
    starts, ends = bounds(data, offsets)
    return spans_hash(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


_SHINGLE = 5
_TURN = [U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3), U64(0x1D8E4E27C47D124F)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes of five words in ascending order, and where its set begins (n + 1 cuts).

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    hashes, cuts = words(data, offsets)
    n_words = np.diff(cuts)
    n_docs = len(n_words)
    whole = np.zeros(max(0, len(hashes) - _SHINGLE + 1), U64)
    for j, turn in enumerate(_TURN):
        whole += hashes[j : j + len(whole)] * turn
    whole = mix(whole)
    first = np.repeat(cuts[:-1], n_words)[: len(whole)]
    size = np.repeat(n_words, n_words)[: len(whole)]
    keep = np.arange(len(whole)) - first <= size - _SHINGLE
    doc = np.repeat(np.arange(n_docs), n_words)[: len(whole)][keep]
    values = whole[keep]
    counts = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((n_words > 0) & (n_words < _SHINGLE))
    if len(short):
        one = np.zeros(len(short), U64)
        for j in range(_SHINGLE - 1):
            has = n_words[short] > j
            one[has] += hashes[cuts[short[has]] + j] * _TURN[j]
        one = mix(one + n_words[short].astype(U64) * U64(0xD1B54A32D192ED03))
        values = np.insert(values, np.cumsum(counts)[short], one)
        counts[short] = 1
    at = np.r_[0, np.cumsum(counts)]
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s > 1:
            values[s:e].sort()
    fresh = np.ones(len(values), bool)
    if len(values):
        fresh[1:] = values[1:] != values[:-1]
        fresh[at[:-1][counts > 0]] = True
    return values[fresh], np.r_[0, np.cumsum(fresh)][at]
