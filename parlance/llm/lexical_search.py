"""Ranked lexical search by variable-block-max postings: block bounds, chosen by dynamic programming, let whole blocks be skipped.

Queries come in blocks of a bounded size, each held against all documents:

1. Every document becomes its number of terms and its postings of the queries' terms, written to the shared folder. What
   a score needs of the whole table (N, L, and each term's df) is added up from those.
2. A task takes shards of its documents. For every term of a shard, dynamic programming cuts the postings into blocks so
   that the bounds' error, the sum over a block's documents of its largest contribution less their own, is least; a block
   costs COST of the list's largest contribution. A gap between two postings is error too, so a rare term's blocks are short.
3. For a query, the bounds of its terms' blocks are added up by windows of documents. Windows are taken from the highest
   bound on; once the next bound is below the k-th best score, all windows left are skipped. Those taken are scored exactly.
4. A shard gives at most k documents a query; a rank over these gives the result.

Scores are integers, so results don't depend on shards or on the order of sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import shared, text

_U64 = np.uint64
#: Text of queries, in bytes, that a run over all documents takes; its different terms go to every task.
QUERY_BYTES = 32 << 20
#: A shard ends at so many documents or postings. Windows are of WINDOW documents, and so many are scored at a time.
SHARD_DOCS, SHARD_POSTINGS, WINDOW, TAKEN = 1 << 16, 4_000_000, 64, 16
#: A block's cost, in largest contributions of its list; most postings of a block, and of a stretch that is cut by itself.
COST, BLOCK, STRETCH = 4, 32, 256
#: Bytes of text worked on at once.
TEXT_BYTES = 1 << 20

_TERM = np.ones(256, bool)
_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def term_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of term bytes (digits, letters and all bytes beyond ASCII) of some texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.r_[False, _TERM[data], False]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends


def _blocks(batch: pa.RecordBatch, column: str):
    """(data, edges, rows): lower-cased bytes of some texts and the rows they belong to; a long text comes in several parts, cut between terms."""
    held, rows, size = [], [], 0

    def give():
        return text.LOWER[np.frombuffer(b"".join(held), np.uint8)], np.cumsum([0, *map(len, held)]), np.array(rows)

    for row, value in enumerate(batch.column(column)):
        raw = np.frombuffer((value.as_py() or "").encode(), np.uint8)
        at = 0
        while at < len(raw):
            to = len(raw)
            if to - at > 2 * TEXT_BYTES:
                for look in range(at + TEXT_BYTES, to, 1 << 16):
                    outside = np.flatnonzero(~_TERM[raw[look : look + (1 << 16)]])
                    if len(outside):
                        to = look + int(outside[0])
                        break
            held.append(raw[at:to].tobytes())
            rows.append(row)
            size, at = size + to - at, to
            if size >= TEXT_BYTES:
                yield give()
                held, rows, size = [], [], 0
    if held:
        yield give()


# --- Queries ---


class Terms:
    """The different terms of some queries, found by hash and then by their bytes."""

    def __init__(self, terms: list[bytes]):
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.size = np.array([*map(len, terms)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        hashes = text.spans_hash(self.data, self.start, self.start + self.size)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if len(terms) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of the queries have one hash")  # of 62 bits, among a bounded number of terms

    def __len__(self):
        return len(self.size)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, or -1."""
        if not len(self) or not len(starts):
            return np.full(len(starts), -1)
        hashes = text.spans_hash(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        term = self.order[at]
        near = np.flatnonzero((self.hashes[at] == hashes) & (self.size[term] == ends - starts))
        if len(near):
            size = self.size[term[near]]
            same = data[text.ragged(starts[near], size)] == self.data[text.ragged(self.start[term[near]], size)]
            near = near[np.logical_and.reduceat(same, np.cumsum(size) - size)]
        out = np.full(len(starts), -1)
        out[near] = term[near]
        return out


def _queries(items: DataFrame) -> tuple[Terms, list[tuple[int, np.ndarray]]]:
    """The terms of some queries, and each query's id with the numbers of its terms; rows with one id are one query."""
    found: dict[int, set[bytes]] = {}
    for item, value in items.select("item_id", "text").toLocalIterator():
        data = text.LOWER[np.frombuffer((value or "").encode(), np.uint8)]
        raw = data.tobytes()
        starts, ends = term_spans(data, np.array([0, len(data)]))
        found.setdefault(item, set()).update(raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
    every = sorted(set().union(*found.values()))
    number = {t: k for k, t in enumerate(every)}
    return Terms(every), [(item, np.array(sorted(number[t] for t in own), np.int64)) for item, own in sorted(found.items()) if own]


# --- Postings of documents ---

_POSTINGS = "doc_id long, n long, terms binary, counts binary"


def _postings(terms):
    """Documents with terms: their number with repeats, and which of the queries' terms they hold how often."""

    def run(batches):
        for batch in batches:
            n, held = np.zeros(batch.num_rows, np.int64), []
            for data, edges, rows in _blocks(batch, "text"):
                starts, ends = term_spans(data, edges)
                cuts = np.searchsorted(starts, edges)
                np.add.at(n, rows, np.diff(cuts))
                term = terms.value.find(data, starts, ends)
                has = np.flatnonzero(term >= 0)
                row = rows[np.searchsorted(cuts, has, "right") - 1]
                key, count = np.unique(row * len(terms.value) + term[has], return_counts=True)
                held.append((key, count))
            key, count = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
            key, which = np.unique(key, return_inverse=True)  # parts of one text are added up
            count = np.bincount(which, count, len(key)).astype(np.int32)
            row, term = np.divmod(key, max(1, len(terms.value)))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            term = term.astype(np.int32)
            stay = np.flatnonzero(n > 0)
            blob = lambda x: pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in stay.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(stay)), pa.array(n[stay]), blob(term), blob(count)], names=["doc_id", "n", "terms", "counts"])

    return run


def _frequencies(size: int):
    """Postings to (term, df) of a task."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=size)
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has])], names=["term", "df"])

    return run


# --- Blocks ---


def block_bounds(place: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each block, its largest value) of postings in order of list and place; first marks where lists begin.

    Of all cuts into blocks of at most BLOCK postings, that with the least sum of (last place - first place + 1) * largest
    value, and COST times the list's largest value for each block. All stretches of STRETCH postings are cut side by side.
    """
    n = len(place)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(first)
    lists = np.cumsum(first) - 1
    cost = COST * np.maximum.reduceat(value, heads)[lists].astype(np.float64)
    within = np.arange(n) - heads[lists]
    begin = np.flatnonzero(within % STRETCH == 0)
    size = np.diff(np.r_[begin, n])
    begins = np.zeros(n, bool)
    for longest in (8, 64, STRETCH):  # stretches of like sizes, so that little is padded
        own = np.flatnonzero((size <= longest) & (size > {8: 0, 64: 8, STRETCH: 64}[longest]))
        for s in range(0, len(own), 65_536 // longest * 8):
            _cut_stretches(begin[own[s : s + 65_536 // longest * 8]], size[own[s : s + 65_536 // longest * 8]], place, value, cost, begins)
    starts = np.flatnonzero(begins)
    return starts, np.maximum.reduceat(value, starts)


def _cut_stretches(begin, size, place, value, cost, begins) -> None:
    """Marks in begins where the blocks of these stretches begin."""
    longest = int(size.max())
    at = np.minimum(begin[:, None] + np.arange(longest), (begin + size - 1)[:, None])
    x, v, c = place[at].astype(np.float64), value[at].astype(np.float64), cost[begin]
    best = np.full((len(begin), longest + 1), np.inf)
    best[:, 0] = 0
    back = np.zeros((len(begin), longest + 1), np.int32)
    for j in range(longest):
        most = np.zeros(len(begin))
        for i in range(j, max(-1, j - BLOCK), -1):
            most = np.maximum(most, v[:, i])
            total = best[:, i] + (x[:, j] - x[:, i] + 1) * most + c
            less = total < best[:, j + 1]
            best[less, j + 1] = total[less]
            back[less, j + 1] = i
    rows, to = np.arange(len(begin)), size.copy()
    while len(rows):
        to = back[rows, to]
        begins[begin[rows] + to] = True
        rows, to = rows[to > 0], to[to > 0]


class Shard:
    """Postings of some documents by term, their blocks, and the bounds that these give windows of documents."""

    def __init__(self, doc: np.ndarray, known: np.ndarray, term: np.ndarray, place: np.ndarray, value: np.ndarray, n_terms: int):
        self.doc, self.known = doc, known
        order = np.lexsort((place, term))
        term, self.place, self.value = term[order], place[order], value[order]
        first = np.r_[True, term[1:] != term[:-1]][: len(term)]
        starts, most = block_bounds(self.place, self.value, first)
        # The windows that a block reaches from its first document to its last, and the largest bound of a term there.
        ends = np.r_[starts[1:], len(term)] - 1 if len(starts) else starts
        low, high = self.place[starts] // WINDOW, self.place[ends] // WINDOW
        window, owner = text.ragged(low, high - low + 1), np.repeat(np.arange(len(starts)), high - low + 1)
        self.windows = -(-len(doc) // WINDOW)
        key = term[starts][owner] * self.windows + window
        by = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        self.bound = np.maximum.reduceat(most[owner], by) if len(by) else np.zeros(0, np.int64)
        of_term, self.window = np.divmod(key[by], max(1, self.windows))
        self.cuts = np.searchsorted(of_term, np.arange(n_terms + 1))
        full = term * self.windows + self.place // WINDOW
        self.low, self.high = np.searchsorted(full, key[by]), np.searchsorted(full, key[by], "right")

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents with a score, best first, equal ones by doc_id (null last)."""
        sizes = self.cuts[terms + 1] - self.cuts[terms]
        own, weight = text.ragged(self.cuts[terms], sizes), np.repeat(weights, sizes)
        window = self.window[own]
        bound = np.zeros(self.windows, np.int64)
        np.add.at(bound, window, self.bound[own] * weight)
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.full(self.windows, -1)
        for s in range(0, len(order), TAKEN):
            # A document whose score may equal the k-th can still stand before it.
            if len(score) >= k and bound[order[s]] < score[k - 1]:
                break
            taken = order[s : s + TAKEN]
            slot[taken] = np.arange(len(taken))
            mine = np.flatnonzero(slot[window] >= 0)
            n = self.high[own[mine]] - self.low[own[mine]]
            at = text.ragged(self.low[own[mine]], n)
            total = np.zeros(len(taken) * WINDOW, np.int64)
            np.add.at(total, np.repeat(slot[window[mine]], n) * WINDOW + self.place[at] % WINDOW, self.value[at] * np.repeat(weight[mine], n))
            slot[taken] = -1
            has = np.flatnonzero(total)
            best = np.r_[best, taken[has // WINDOW] * WINDOW + has % WINDOW]
            score = np.r_[score, total[has]]
            top = np.lexsort((self.doc[best], ~self.known[best], -score))[:k]
            best, score = best[top], score[top]
        return best, score


def norms(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """100 - 50 + (50 * n * docs) div terms, for documents of n of all the table's terms."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return np.array([50 + 50 * x * docs // terms for x in n.tolist()], np.int64)
    return 50 + 50 * n * docs // terms


def _found(queries, n_terms: int, docs: int, total: int, k: int):
    """Postings to (item_id, doc_id, score) of each shard's k best."""

    def settle(held):
        doc, known, n, terms, counts = zip(*held, strict=True)
        doc, known, n = np.concatenate(doc), np.concatenate(known), np.concatenate(n)
        sizes = np.array([len(x) // 4 for part in terms for x in part], np.int64)
        term, count = (np.frombuffer(b"".join(x for part in parts for x in part), np.int32).astype(np.int64) for parts in (terms, counts))
        place = np.repeat(np.arange(len(doc)), sizes)
        value = 1_000_000_000 * count // (1_000 * count + 20 * norms(n, docs, total)[place])
        shard = Shard(doc, known, term, place, value, n_terms)
        out = [(item, *shard.search(own, weights, k)) for item, own, weights in queries.value]
        item = np.repeat([x[0] for x in out], [len(x[1]) for x in out])
        at, score = (np.concatenate([x[j] for x in out]) for j in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(doc[at], mask=~known[at]), pa.array(score)], names=["item_id", "doc_id", "score"])

    def run(batches):
        held, size, postings = [], 0, 0
        for batch in batches:
            for s in range(0, batch.num_rows, 8_192):
                part = batch.slice(s, 8_192)
                ids, terms = part.column("doc_id"), part.column("terms").to_pylist()
                held.append((ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid().to_numpy(zero_copy_only=False)), part.column("n").to_numpy(), terms, part.column("counts").to_pylist()))
                size, postings = size + len(terms), postings + sum(map(len, terms)) // 4
                if size >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield settle(held)
                    held, size, postings = [], 0, 0
        if held:
            yield settle(held)

    return run


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, ranks from 1, equal scores by ascending doc_id.

    docs has doc_id and text, items item_id and text. Null and empty texts have no terms: such a document isn't counted
    and isn't found, such an item finds nothing; nor does one with a null item_id. Rows of items with one item_id are one item. Every row of docs is a
    document: repeated ones are all ranked, a null doc_id after the others of its score. Other columns are ignored. Empty
    tables give an empty result. Items are taken QUERY_BYTES of text at a time, whatever their number.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES)
    parts = [_search_block(texts, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in parts:
        out = out.unionByName(part)
    return out


def _search_block(texts: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = texts.sparkSession
    terms, queries = _queries(items)
    postings = shared.table(texts.mapInArrow(shared.tidy(_postings(spark.sparkContext.broadcast(terms))), _POSTINGS), "postings")
    docs, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for term, n in postings.select("terms").mapInArrow(_frequencies(len(terms)), "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    weights = np.array([weight(docs, n) for n in df.tolist()], np.int64)
    weighed = spark.sparkContext.broadcast([(item, own, weights[own]) for item, own in queries])
    found = postings.mapInArrow(shared.tidy(_found(weighed, len(terms), docs, total, k)), "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: search() of the table benchmark over documents, k 50.
SEARCH_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
x AS (
  SELECT q.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * d.n * s.docs) // s.terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d ON d.doc_id = tf.doc_id, s GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 50
"""
