"""N-gram Jaccard self-join of documents: size-banded tiles of hashed bitmap signatures, then exact intersection.

A document's set is its distinct five-word shingles. Two documents link when 100 * |A & B| >= 80 * |A | B|. How links
between unequal sets are found, with none lost:

1. Every shingle is counted. A task settles portions of about PORTION hashes: equal sets post once, and a shingle goes to
   its bucket once for a portion, however many of its texts hold it. The buckets reply with those that at least two
   sets hold, and how many do (as a power of two). A shared element is always such a *repeated* one, so from here on a
   set is its size and its repeated elements; nothing reads the texts again.
2. Under any fixed order of shingles two linked sets share one among the first n - ceil(0.8 n) + 1 of each. The order is by
   frequency, then by hash, so a set with many elements of its own has no repeated one among its first and takes no
   further part. The others post the repeated ones among their first elements.
3. Postings of one shingle form a tile (a frequent one's several, by a hash of the member). A pair is looked at only in
   the tile of its first common shingle: where two members have the same predecessor, an earlier tile has them; and the
   elements from there on must suffice for a link. Small tiles give their pairs; larger ones first give stars, all
   members of a band of sizes against the few whose elements are the most frequent. Only members that still belong to
   different components are then compared with each other.
4. A pair is dropped when bit counts of its bitmaps bound the overlap below the threshold: a bit that only one of them
   has is a repeated element that the other lacks. What is left is settled by intersecting the two sorted arrays.

Shingles and sets are told apart by 64-bit hashes: among m different ones of either kind about m^2 / 2^65 pairs are taken
for equal. One such shingle changes an overlap by one; one such set merges two documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import shared, text
from parlance.llm.components import components

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A tile of up to so many sets gives its pairs at once; a larger one begins with stars around so many members.
SMALL_TILE, CENTRES = 8, 3
#: A shingle of more sets than this has several tiles, by a hash of the set: stars stay within a tile, and crossing pairs
#: of two tiles are compared in a cell of their own, so no task holds more than two tiles of about so many members.
PART = 4_096
#: A task counts shingles in portions of about so many hashes, and of at most so many sets: they are numbered by 16 bits.
PORTION, SETS = 1 << 20, 0xFFFF


def _need(n: np.ndarray) -> np.ndarray:
    """ceil(0.8 n): the least overlap of a set of n with any set that it links to."""
    return (n * PERCENT + 99) // 100


def linked(both: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * (n_a + n_b - both)


def _sets(batches, column: str):
    for batch in batches:
        for part in text.chunks(batch, column):
            for s in range(0, part.num_rows, SETS):
                few = part.slice(s, SETS)
                values, cuts = text.shingle_sets(*text.buffer(few.column(column)))
                yield few, values, cuts


def _node_ids(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(text.mix(values + np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
    return text.mix(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(np.uint64)).view(np.int64)


def bitmap(values: np.ndarray) -> bytes:
    """A bit for each hash, in a width of four to eight times their number: most of what two sets don't share shows."""
    width = max(64, 1 << int(4 * len(values) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(raw: bytes, width: int) -> np.ndarray:
    """A bitmap narrowed to so many bits, as 64-bit words: shingles that shared a bit still do."""
    words = np.frombuffer(raw, np.uint64)
    return np.bitwise_or.reduce(words.reshape(-1, width // 64), axis=0)


# --- Counting: portions of tasks, buckets of shingles, and back to the portion ---

_COUNT_SCHEMA = "bucket int, kind int, portion long, n long, blob binary"
#: Kinds of rows: shingles for their bucket; a portion's documents, its shingles held more than once, and replies for its home.
_ASK, _DOCS, _LATER, _REPLY = range(4)


def _packed(h: np.ndarray) -> bytes:
    """Ascending 64-bit hashes as the byte planes of their differences: the high ones are zeros, which shuffles compress."""
    return np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(n: int, blob: pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, 8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _after(n: int, blob: pa.Buffer, *dtypes: str) -> list[np.ndarray]:
    """The columns behind n packed hashes."""
    return shared.unpack(n, blob.slice(8 * n), [np.dtype(d) for d in dtypes])


def _count_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "portion", "n", "blob"])


def _shingle_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so ascending hashes are in order of their buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _asked(doc: str, column: str, buckets: int):
    """Texts to rows of _COUNT_SCHEMA: each portion's shingles for their buckets, and its documents for its home."""

    def settle(held: list[tuple], portion: int):
        doc_id, known, n, sid, values = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(n) > 0xFFFF:
            raise ValueError(f"a portion of {len(n)} sets can't be numbered by 16 bits")
        home = int(text.mix(np.array([portion], np.uint64))[0] % np.uint64(buckets))
        # Equal sets post once: the first of them.
        _, first, local = np.unique(sid, return_index=True, return_inverse=True)
        posts = np.zeros(len(sid), bool)
        posts[first] = True
        posts &= n > 0
        whose = np.repeat(local.astype(np.uint16), n)
        mine = np.repeat(posts, n)
        values, whose = values[mine], whose[mine]
        order = np.argsort(values, kind="stable")
        values, whose = values[order], whose[order]
        fresh = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
        count = np.minimum(np.diff(np.r_[fresh, len(values)]), 0xFFFF).astype(np.uint16)
        later = np.ones(len(values), bool)
        later[fresh] = False
        rows = [(home, _DOCS, portion, len(sid), b"".join(x.tobytes() for x in (doc_id, known, n, sid, local.astype(np.uint16), posts)))]
        if later.any():
            rows.append((home, _LATER, portion, int(later.sum()), _packed(values[later]) + whose[later].tobytes()))
        h, whose = values[fresh], whose[fresh]
        cuts = np.searchsorted(_shingle_bucket(h, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            s, e = cuts[b], cuts[b + 1]
            rows.append((b, _ASK, portion, int(e - s), _packed(h[s:e]) + whose[s:e].tobytes() + count[s:e].tobytes()))
        return _count_rows(rows)

    def run(batches):
        held, size, sets, number = [], 0, 0, TaskContext.get().partitionId() << 32
        for part, values, cuts in _sets(batches, column):
            if held and sets + part.num_rows > SETS:
                yield settle(held, number)
                held, size, sets, number = [], 0, 0, number + 1
            ids = part.column(doc).cast(pa.int64())
            known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
            held.append((ids.fill_null(0).to_numpy(), known, np.diff(cuts), _node_ids(values, cuts), values))
            size, sets = size + len(values), sets + len(ids)
            if size >= PORTION:
                yield settle(held, number)
                held, size, sets, number = [], 0, 0, number + 1
        if held:
            yield settle(held, number)

    return run


def _counted(buckets: int):
    """A bucket's shingles to replies: those that at least two sets hold, with the power of two of their number."""

    def run(batches):
        asked = []
        for batch in batches:
            for bucket, kind, portion, n, blob in zip(*(batch.column(k) for k in ("bucket", "kind", "portion", "n", "blob")), strict=True):
                kind, portion, n, blob = kind.as_py(), portion.as_py(), n.as_py(), blob.as_buffer()
                if kind == _ASK:
                    asked.append((portion, n, _unpacked(n, blob), *_after(n, blob, "u2", "u2")))
                else:
                    yield _count_rows([(bucket.as_py(), kind, portion, n, blob.to_pybytes())])
        if not asked:
            return
        h, count = np.concatenate([x[2] for x in asked]), np.concatenate([x[4] for x in asked])
        order = np.argsort(h, kind="stable")
        fresh = np.r_[True, h[order[1:]] != h[order[:-1]]]
        total = np.add.reduceat(count[order], np.flatnonzero(fresh), dtype=np.int64)
        power = np.empty(len(h), np.uint8)
        power[order] = (np.frexp(total)[1] - 1)[np.cumsum(fresh) - 1]
        at = 0
        for portion, n, own, whose, _ in asked:
            kept = np.flatnonzero(power[at : at + n])
            if len(kept):
                home = int(text.mix(np.array([portion], np.uint64))[0] % np.uint64(buckets))
                yield _count_rows([(home, _REPLY, portion, len(kept), _packed(own[kept]) + whose[kept].tobytes() + power[at : at + n][kept].tobytes())])
            at += n

    return run


#: A row for each document: sid names its set (null for the empty one). Of each portion's equal sets one has the rest:
#: how many repeated elements lead, all repeated elements in order, their powers, and the mean power of all elements.
_SET_SCHEMA = "doc_id long, n long, sid long, lead int, weight double, elements binary, powers binary"


def _home(batches):
    """A home's portions to rows of _SET_SCHEMA."""
    portions: dict[int, list] = {}
    for batch in batches:
        for kind, portion, n, blob in zip(*(batch.column(k) for k in ("kind", "portion", "n", "blob")), strict=True):
            portions.setdefault(portion.as_py(), [None, [], []])
            kind, n, blob, got = kind.as_py(), n.as_py(), blob.as_buffer(), portions[portion.as_py()]
            if kind == _DOCS:
                got[0] = shared.unpack(n, blob, [np.dtype(d) for d in ("i8", "?", "i8", "i8", "u2", "?")])
            else:
                got[kind - 1].append((_unpacked(n, blob), *_after(n, blob, *(("u2",) if kind == _LATER else ("u2", "u1")))))
    for docs, later, replies in portions.values():
        yield from _rows_of(docs, later, replies)


def _rows_of(docs, later, replies):
    doc_id, known, n, sid, local, posts = docs
    h, whose, power = (np.concatenate(x) for x in zip(*replies, strict=True)) if replies else (np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint8))
    if later:
        more, theirs = (np.concatenate(x) for x in zip(*later, strict=True))
        order = np.argsort(h)
        h, whose, power = np.r_[h, more], np.r_[whose, theirs], np.r_[power, power[order[np.searchsorted(h[order], more)]]]
    order = np.lexsort((h, power, whose))
    h, whose, power = h[order], whose[order], power[order]
    cuts = np.searchsorted(whose, np.arange(int(local.max()) + 2))
    held = np.diff(cuts)[local]
    lead = np.where(posts, np.maximum(0, n - _need(n) + 1 - (n - held)), 0)
    total = np.r_[0, np.cumsum(power, dtype=np.int64)]
    weight = (total[cuts[1:]] - total[cuts[:-1]])[local] / np.maximum(n, 1)
    for s in range(0, len(n), 4096):
        at = range(s, min(s + 4096, len(n)))
        span = [(cuts[int(local[k])], cuts[int(local[k]) + 1]) if lead[k] else None for k in at]
        part = slice(s, s + 4096)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc_id[part], mask=~known[part]), pa.array(n[part]), pa.array(sid[part], mask=n[part] == 0), pa.array(lead[part].astype(np.int32)), pa.array(weight[part]),
                pa.array([x and h[x[0] : x[1]].tobytes() for x in span], pa.binary()), pa.array([x and power[x[0] : x[1]].tobytes() for x in span], pa.binary()),
            ],
            names=["doc_id", "n", "sid", "lead", "weight", "elements", "powers"],
        )


# --- Tiles ---

_POSTING = ("u8", "i8", "i8", "i8", "u8", "f4", "i4", "i4")


def _leads(buckets: int):
    """Rows of _SET_SCHEMA with leading elements to postings for the tiles' buckets: (h, sid, n, rank, predecessor, weight, part, parts)."""

    def run(batches):
        router = shared.Router(*_POSTING)
        for batch in batches:
            for sid, n, lead, weight, raw, powers in zip(*(batch.column(k).to_pylist() for k in ("sid", "n", "lead", "weight", "elements", "powers")), strict=True):
                h = np.frombuffer(raw, np.uint64)
                rank = n - len(h) + np.arange(lead)
                before = np.r_[np.int64(sid).view(np.uint64), h[: lead - 1]]
                # A shingle's power is the same wherever it occurs, and so is the number of its tiles.
                parts = np.maximum(1, (2 << np.frombuffer(powers, np.uint8)[:lead].astype(np.int64)) // PART)
                part = int(text.mix(np.array([sid]).view(np.uint64))[0] >> np.uint64(33)) % parts
                bucket = text.mix(h[:lead] + part.astype(np.uint64)) % np.uint64(buckets)
                same = lambda x, t=lead: np.full(t, x)
                yield from router.add(bucket, h[:lead], same(sid), same(n), rank, before, same(weight), part, parts)
        yield from router.flush()

    return run


def _responsible(n_a, rank_a, before_a, n_b, rank_b, before_b):
    """Which pairs this tile has to look at: no earlier common element shows, and those from here on suffice for a link."""
    need = (PERCENT * (n_a + n_b) + 179) // 180
    return (before_a != before_b) & (n_a - rank_a >= need) & (n_b - rank_b >= need)


def _banded(n: np.ndarray):
    """Rows of a tile by size: (rows of one band of sizes within 5/4, rows of that band and the one above)."""
    order = np.argsort(n, kind="stable")
    band = (np.log(np.maximum(n[order], 1)) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)
    for k in np.unique(band):
        yield order[band == k], order[(band == k) | (band == k + 1)]


_TILE_SCHEMA = "x long, y long, kind int, home long, n long, rank long, before long, part int, parts int"


def _tiles(batches):
    """A bucket's postings to (x, y, home): pairs of small tiles and of stars (kind 0); and (tile, sid, ...): members of larger tiles (kind 1)."""
    got = shared.gather(batches, *_POSTING)
    if got is None:
        return
    order = np.lexsort((got[1], got[2], got[6], got[0]))
    h, sid, n, rank, before, weight, part, parts = (x[order] for x in got)
    fresh = np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (sid[1:] != sid[:-1]) | (n[1:] != n[:-1])]
    h, sid, n, rank, before, weight, part, parts = (x[fresh] for x in (h, sid, n, rank, before, weight, part, parts))
    cuts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.r_[cuts, len(h)])
    which = np.repeat(np.arange(len(cuts)), size)
    big = (size[which] > SMALL_TILE) | (parts > 1)
    at = np.flatnonzero(~big)
    found = []
    for gap in range(1, SMALL_TILE):
        i = at[at + gap < len(h)]
        i = i[which[i] == which[i + gap]]
        j = i + gap
        i, j = (x[_responsible(n[i], rank[i], before[i], n[j], rank[j], before[j])] for x in (i, j))
        found.append(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j]), np.minimum(sid[i], sid[j])], axis=1))
    for t in np.unique(which[big]):
        s = slice(cuts[t], cuts[t] + size[t])
        for core, reach in _banded(n[s]):
            for c in core[np.argsort(-weight[s][core], kind="stable")[:CENTRES]] + cuts[t]:
                rest = reach + cuts[t]
                rest = rest[(rest != c) & _responsible(n[rest], rank[rest], before[rest], n[c], rank[c], before[c])]
                found.append(np.stack([np.minimum(sid[rest], sid[c]), np.maximum(sid[rest], sid[c]), np.full(len(rest), sid[c])], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    zero = np.zeros(len(pairs), np.int64)
    yield _tile_rows(pairs[:, 0], pairs[:, 1], 0, pairs[:, 2], zero, zero, zero, zero, zero)
    yield _tile_rows(h[big].view(np.int64), sid[big], 1, sid[big], n[big], rank[big], before[big].view(np.int64), part[big], parts[big])


def _tile_rows(x, y, kind: int, home, n, rank, before, part, parts):
    cols = [x, y, np.full(len(x), kind, np.int32), home, n, rank, before, part.astype(np.int32), parts.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["x", "y", "kind", "home", "n", "rank", "before", "part", "parts"])


# --- Bitmaps, crossing pairs and exact intersection ---


def _signed(batches):
    """(sid, n, elements in order) to (sid, n, held, bits, elements): the bitmap, and the elements as a sorted array."""
    for batch in batches:
        values = [np.sort(np.frombuffer(x, np.uint64)) for x in batch.column("elements").to_pylist()]
        if values:
            cols = [pa.array([len(v) for v in values], pa.int64()), pa.array([bitmap(v) for v in values], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), *cols], names=["sid", "n", "held", "bits", "elements"])


def overlap_bound(bits_a: np.ndarray, bits_b: np.ndarray, held_a: np.ndarray, held_b: np.ndarray) -> np.ndarray:
    """At most how many elements rows of two bitmap matrices can share, from bit counts alone."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(held_a - only_a, held_b - only_b)


def _matrix(bits: list[bytes], most: int = 1 << 14) -> np.ndarray:
    width = min(most, min(len(b) for b in bits) * 8)
    return np.stack([fold(b, width) for b in bits])


_CELL = ("tile", "low", "high")
_MEMBER = ("sid", "n", "rank", "before", "part", "comp", "held")


def _by_cell(batches):
    """(low, high, columns by name) of each run of rows of one cell: a shingle, and the two of its tiles that are compared."""
    names, tail = (*_CELL, *_MEMBER), None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {k: batch.column(k).to_numpy() for k in names} | {"bits": np.array(batch.column("bits").to_pylist(), object)}
        tail = now if tail is None else {k: np.concatenate([tail[k], now[k]]) for k in now}
        cuts = np.flatnonzero(np.r_[True, np.any([tail[k][1:] != tail[k][:-1] for k in _CELL], axis=0)])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield tail["low"][s], tail["high"][s], {k: x[s:e] for k, x in tail.items()}
        tail = {k: x[cuts[-1] :] for k, x in tail.items()}
    if tail is not None:
        yield tail["low"][0], tail["high"][0], tail


def _crossing(best: bool):
    """Members, a cell's rows next to each other, to the pairs of different components that their bitmaps let pass; best: for each member and other component, the likeliest one."""

    def run(batches):
        for low, high, cell in _by_cell(batches):
            sid, n, rank, before, part, comp, held = (cell[k] for k in _MEMBER)
            if (comp == comp[0]).all():
                continue
            out = []
            for core, reach in _banded(n):
                if (comp[reach] == comp[reach[0]]).all():
                    continue
                rows = _matrix(cell["bits"][reach].tolist())
                place = {r: k for k, r in enumerate(reach.tolist())}
                for c in core.tolist():
                    # A pair of one band is looked at from its first row, a pair of two bands from the smaller one.
                    other = (comp[reach] != comp[c]) & ((n[reach] > n[c]) | (n[reach] == n[c]) & (sid[reach] > sid[c]))
                    other &= _responsible(n[reach], rank[reach], before[reach], n[c], rank[c], before[c])
                    if low != high:
                        other &= part[reach] != part[c]
                    other = np.flatnonzero(other)
                    if not len(other):
                        continue
                    far = reach[other]
                    bound = overlap_bound(rows[place[c]][None, :], rows[other], held[c], held[far])
                    fit = linked(bound, n[far], n[c])
                    far, bound = far[fit], bound[fit]
                    if best:
                        far = far[np.lexsort((n[far] - 2 * bound, comp[far]))]
                        far = far[np.unique(comp[far], return_index=True)[1]]
                    out.append(np.stack([np.minimum(sid[far], sid[c]), np.maximum(sid[far], sid[c]), np.minimum(comp[far], comp[c])], axis=1))
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], names=["a", "b", "home"])

    return run


#: Pairs of two sets, and the set or component around which they are verified; so many of one home make another bucket.
_PAIRS, HOME = "a long, b long, home long", 2_000


def _verify(batches):
    """A bucket's pairs and the sets they name to the pairs that link, by intersection of the sorted arrays."""
    sets: dict[int, tuple[int, np.ndarray]] = {}
    pairs = []
    for batch in batches:
        for a, b, n, raw in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "n", "elements")), strict=True):
            if raw is None:
                pairs.append((a, b))
            else:
                sets[a] = n, np.frombuffer(raw, np.uint64)
    links = [(a, b) for a, b in pairs if _intersects(*sets[a], *sets[b])]
    if links:
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


def _intersects(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return bool(linked(both, n_a, n_b))


def _bounded(batches):
    """Pairs with both bitmaps to those whose bit counts allow a link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n_a, n_b, held_a, held_b = (batch.column(k).to_numpy() for k in ("n_a", "n_b", "held_a", "held_b"))
        bits_a, bits_b = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
        width = np.array([min(len(x), len(y)) * 8 for x, y in zip(bits_a, bits_b, strict=True)])
        keep = np.zeros(batch.num_rows, bool)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            for s in range(0, len(at), max(1, (1 << 24) // int(w))):
                i = at[s : s + max(1, (1 << 24) // int(w))]
                bound = overlap_bound(np.stack([fold(bits_a[k], int(w)) for k in i]), np.stack([fold(bits_b[k], int(w)) for k in i]), held_a[i], held_b[i])
                keep[i] = linked(np.maximum(bound, 0), n_a[i], n_b[i])
        yield batch.filter(pa.array(keep)).select(["a", "b", "home"])


class _Join:
    """The tables of one join; clear() drops them once its result has been used or written."""

    def __init__(self, docs: DataFrame, doc: str, column: str):
        self.spark, self.buckets = docs.sparkSession, shared.n_buckets(docs.sparkSession)
        self.scratch = shared.Scratch(self.spark)
        docs = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(column).alias("text"))
        asked = docs.mapInArrow(shared.tidy(_asked("doc_id", "text", self.buckets)), _COUNT_SCHEMA)
        counted = shared.route(asked, self.buckets).mapInArrow(shared.tidy(_counted(self.buckets)), _COUNT_SCHEMA)
        #: A row for each document, see _SET_SCHEMA.
        self.rows = shared.table(shared.route(counted, self.buckets).mapInArrow(shared.tidy(_home), _SET_SCHEMA), "sets")

    def candidates(self) -> DataFrame:
        leads = self.rows.where("lead > 0").select("sid", "n", "lead", "weight", "elements", "powers").mapInArrow(shared.tidy(_leads(self.buckets)), shared.BLOB_SCHEMA)
        return self.scratch.table(shared.route(leads, self.buckets).mapInArrow(shared.tidy(_tiles), _TILE_SCHEMA), "tiles")

    def signed(self, tiles: DataFrame) -> DataFrame:
        """(sid, n, held, bits, elements) of every set that is in a tile with another one."""
        named = tiles.select(F.explode(F.when(F.col("kind") == 0, F.array("x", "y")).otherwise(F.array("y"))).alias("sid")).distinct()
        one = self.rows.where("lead > 0").select("sid", "n", "elements").join(named, "sid", "left_semi").dropDuplicates(["sid"])
        return self.scratch.table(one.mapInArrow(shared.tidy(_signed), "sid long, n long, held long, bits binary, elements binary"), "signed")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, home) of sids that link, as (u, v)."""
        side = lambda k: self.nodes.select(F.col("sid").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "held", "bits")))
        pairs = pairs.groupBy("a", "b").agg(F.min("home").alias("home"))
        near = self.scratch.table(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(shared.tidy(_bounded), _PAIRS), "pairs")
        # Pairs of one home meet in one bucket, so a set travels there once; homes of many pairs have several buckets.
        homes = near.groupBy("home").agg(F.ceil(F.count("*") / HOME).alias("spread"))
        near = near.join(homes, "home").withColumn("bucket", F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("b"), F.col("spread"))), F.lit(self.buckets)).cast("int"))
        needed = near.select(F.col("a").alias("sid"), "bucket").unionByName(near.select(F.col("b").alias("sid"), "bucket"))
        sets = self.nodes.join(needed.distinct(), "sid").select("bucket", F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "n", "elements")
        asked = near.select("bucket", "a", "b", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("elements"))
        return self.scratch.table(sets.unionByName(asked).repartitionById(self.buckets, F.col("bucket")).mapInArrow(shared.tidy(_verify), "u long, v long"), "links")

    def by_cell(self, members: DataFrame) -> DataFrame:
        """Members with their bitmaps, a cell for each two tiles of a shingle, each cell's rows in one partition and next to each other."""
        rows = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
        rows = rows.join(self.nodes.select("sid", "held", "bits"), "sid").select(*_CELL, *_MEMBER, "bits")
        return rows.repartition(self.buckets, *_CELL).sortWithinPartitions(*_CELL)

    def components(self) -> DataFrame:
        """(sid, comp) of every set that links to another one."""
        tiles = self.candidates()
        self.nodes = self.signed(tiles)
        members = tiles.where("kind = 1").select(F.col("x").alias("tile"), F.col("y").alias("sid"), "n", "rank", "before", "part", "parts")
        found = components(self.links(tiles.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"), "home")), scratch=self.scratch)
        for best in (True, False) if not shared.empty(members) else ():
            now = members.join(found.select(F.col("node").alias("sid"), F.col("component").alias("comp")), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
            now = self.scratch.table(now, "labelled")
            mixed = now.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("tile")
            more = self.links(self.by_cell(now.join(mixed, "tile")).mapInArrow(shared.tidy(_crossing(best)), _PAIRS))
            if not shared.empty(more):
                found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), scratch=self.scratch)
        found = shared.table(found.select(F.col("node").alias("sid"), F.col("component").alias("comp")), "found")
        self.scratch.clear()
        return found


def jaccard_components(docs: DataFrame, doc: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: its set's size and the smallest doc_id that links reach.

    Nulls and texts without words: n_shingles 0 and a component of their own (component_id is the doc_id, null if that
    is null). Rows with the same text, or the same doc_id and different texts, are rows of their own; a component's
    number is the smallest doc_id of all its rows that isn't null. Other columns are ignored, whatever their names. An
    empty table gives an empty result. A task that is run again must see the same rows in the same order, as scans of
    files do: write what a shuffle without order made first.
    """
    join = _Join(docs, doc, column)
    comp = join.components()
    nodes = join.rows.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("doc_id"))
    labelled = nodes.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_set = labelled.join(least, "comp").select("sid", "n", "component_id")
    full = join.rows.where("n > 0").join(of_set, ["sid", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    none = join.rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none)
