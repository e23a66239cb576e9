"""Ranked lexical search over inverted treaps.

Documents are indexed block by block: for each term a treap, in which doc_id is the search
order and the impact (what the term adds to a document's score) the heap order. A query
goes down the treaps of its terms at once, over intervals of documents. The impacts at the
tops of an interval's subtrees add up to a bound of every score in it; an interval whose
bound cannot enter the ten best goes with all that lies below. Of what remains, the
document of the largest impact is scored and splits its interval in two.

The first pass counts terms, the second one builds treaps and searches them; only the best
documents of each task and query are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import mix, texts
from .common import checkpointed, table

#: Documents that a query returns.
K = 10
#: Postings in a block, intervals that are worked on at once, and bytes of a text that are split into terms at once, about.
BLOCK_POSTINGS, CHUNK, PIECE = 1 << 20, 2048, 1 << 20
#: Queries are sent to tasks in lots of so many bytes and rows on average; each lot is a pass over the documents.
LOT_BYTES, LOT_ROWS = 4 << 20, 1 << 12

#: Bytes of terms: digits, letters and all that is not ASCII; A to Z are lower-cased, all else separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, piece by piece."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(d, n, terms, tfs)`` of each document with terms: its id, number of terms, and which of ``vocabulary`` it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one lot of queries

    def count(batches):
        number = shared.value
        for batch in batches:
            codes, offsets = texts(batch.column(1))
            rows, sizes, ends, terms, tfs = [], [], [0], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                counts: Counter[bytes] = Counter()
                for words in term_lists(codes[a:b].tobytes()):
                    counts.update(words)
                if not counts:
                    continue
                rows.append(k)
                sizes.append(counts.total())
                for word in counts.keys() & number.keys():
                    terms.append(number[word])
                    tfs.append(counts[word])
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["d", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(count, "d bigint, n bigint, terms array<bigint>, tfs array<bigint>")


@dataclass
class Treaps:
    """Treaps of all terms of a block. Postings lie by term and document; ``left`` and ``right`` lead to subtrees, -1 where there is none."""

    key: np.ndarray  # term * documents + document
    doc: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    order: np.ndarray  # impact, then a hash: equal impacts do not make a list of a tree
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray  # of each term, -1 if it has no posting


def build(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int) -> Treaps:
    """Treaps of postings with distinct ``(term, doc)``, in one pass with a stack."""
    by = np.lexsort((doc, term))
    term, doc, impact = term[by], doc[by], impact[by]
    order = (impact << 20) | (mix(doc.astype(np.uint64) + np.uint64(1)) & np.uint64(0xFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    left, right, root = [-1] * len(term), [-1] * len(term), np.full(n_terms, -1, np.int64)
    heap, first = order.tolist(), {*starts.tolist()}
    path: list[int] = []  # from the root along right children
    for i, high in enumerate(heap):
        if i in first:
            if path:
                root[term[path[0]]] = path[0]
            path = []
        below = -1
        while path and heap[path[-1]] < high:
            below = path.pop()
        left[i] = below
        if path:
            right[path[-1]] = i
        path.append(i)
    if path:
        root[term[path[0]]] = path[0]
    return Treaps(term * n_docs + doc, doc, term, impact, order, np.array(left), np.array(right), root)


class Best:
    """The ``k`` best documents of each query so far: by score, then null id, then id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)
        self.known = np.zeros((queries, k), bool)  # whether the id is not null

    def worse(self, query: np.ndarray, score: np.ndarray, known: np.ndarray, id_: np.ndarray) -> np.ndarray:
        """Whether documents from ``id_`` on with at most ``score`` cannot enter."""
        s, i, known_ = self.score[query, -1], self.id[query, -1], self.known[query, -1]
        later = (known & ~known_) | ((known == known_) & (id_ > i))
        return (score < s) | (score <= 0) | ((score == s) & later)

    def add(self, query: np.ndarray, score: np.ndarray, known: np.ndarray, id_: np.ndarray) -> None:
        new = ~self.worse(query, score, known, id_)
        if not new.any():
            return
        touched, back = np.unique(query[new], return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), back])
        s, i, n = (np.concatenate([have[touched].ravel(), got[new]]) for have, got in ((self.score, score), (self.id, id_), (self.known, known)))
        by = np.lexsort((i, n, -s, q))
        place = np.arange(len(q)) - np.searchsorted(q[by], q[by])
        by = by[place < self.k].reshape(len(touched), self.k)
        self.score[touched], self.id[touched], self.known[touched] = s[by], i[by], n[by]


@dataclass
class _Intervals:
    """Intervals ``[low, high)`` of a block's documents, each with its query and the tops of the subtrees that reach into it."""

    query: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bound: np.ndarray
    owner: np.ndarray  # of each top, rising
    top: np.ndarray

    def taken(self, which: np.ndarray) -> _Intervals:
        """The intervals at ``which``, in that order."""
        sizes = np.bincount(self.owner, minlength=len(self.query))
        starts, n = np.cumsum(sizes) - sizes, sizes[which]
        tops = np.repeat(starts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return _Intervals(self.query[which], self.low[which], self.high[which], self.bound[which], np.repeat(np.arange(len(which)), n), self.top[tops])


def _settled(t: Treaps, x: _Intervals) -> _Intervals:
    """Each top moved down to the first node within its interval, or dropped; bounds summed anew."""
    top, low, high = x.top.copy(), x.low[x.owner], x.high[x.owner]
    open_ = np.arange(len(top))
    while len(open_):
        at = top[open_]
        before, after = t.doc[at] < low[open_], t.doc[at] >= high[open_]
        out = before | after
        open_, at = open_[out], at[out]
        top[open_] = at = np.where(before[out], t.right[at], t.left[at])
        open_ = open_[at >= 0]
    live = top >= 0
    owner, top = x.owner[live], top[live]
    bound = np.bincount(owner, t.impact[top], len(x.query)).astype(np.int64)  # sums stay below 2^53
    return _Intervals(x.query, x.low, x.high, bound, owner, top)


def search(t: Treaps, known: np.ndarray, ids: np.ndarray, queries: list[np.ndarray], best: Best) -> int:
    """Take the documents of a block (``ids`` ascending, null first) into ``best``; returns how many scores were computed."""
    n_docs, scored = len(ids), 0
    roots = [r[r >= 0] for r in (t.root[q] for q in queries)]
    some = np.array([k for k, r in enumerate(roots) if len(r)], np.int64)
    if not len(some):
        return 0
    n = np.array([len(roots[k]) for k in some])
    full = np.zeros(len(some), np.int64)
    stack = [_settled(t, _Intervals(some, full, full + n_docs, full, np.repeat(np.arange(len(some)), n), np.concatenate([roots[k] for k in some])))]
    while stack:
        x = stack.pop()
        x = x.taken(np.flatnonzero(~best.worse(x.query, x.bound, known[x.low], ids[x.low])))
        if not len(x.query):
            continue
        firsts = np.searchsorted(x.owner, np.arange(len(x.query)))
        most = np.maximum.reduceat(t.order[x.top], firsts)
        at = np.flatnonzero(t.order[x.top] == most[x.owner])
        middle = np.zeros(len(x.query), np.int64)
        middle[x.owner[at]] = t.doc[x.top[at]]
        want = t.term[x.top] * n_docs + middle[x.owner]
        place = np.minimum(np.searchsorted(t.key, want), len(t.key) - 1)
        score = np.bincount(x.owner, np.where(t.key[place] == want, t.impact[place], 0), len(x.query)).astype(np.int64)
        scored += len(score)
        best.add(x.query, score, known[middle], ids[middle])
        m, two = len(x.query), np.tile(x.query, 2)
        halves = _Intervals(two, np.concatenate([x.low, middle + 1]), np.concatenate([middle, x.high]), np.tile(x.bound, 2), np.concatenate([x.owner, x.owner + m]), np.tile(x.top, 2))
        halves = _settled(t, halves.taken(np.flatnonzero(halves.low < halves.high)))
        left = np.flatnonzero(~best.worse(halves.query, halves.bound, known[np.minimum(halves.low, n_docs - 1)], ids[np.minimum(halves.low, n_docs - 1)]))
        left = left[np.argsort(halves.bound[left], kind="stable")]  # the most promising come last, and off the stack first
        stack += [halves.taken(left[a : a + CHUNK][::-1]) for a in range(0, len(left), CHUNK)]
    return scored


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What terms with ``weight`` add to the scores of documents of ``n`` terms that hold them ``tf`` times; whole numbers, rounded down."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        m = np.array([10 + 90 * x * documents // length for x in n.tolist()], np.int64)
    else:
        m = 10 + 90 * n * documents // length
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _searched(counted: DataFrame, queries: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``(q, d, score)``: the best documents of each query and task."""
    shared = counted.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = shared.value
        best, held, size = Best(len(queries), k), [], 0

        def settle():
            rows = pa.Table.from_batches(held).combine_chunks()
            d, n = rows.column("d").combine_chunks(), rows.column("n").to_numpy()
            known, ids = d.is_valid().to_numpy(zero_copy_only=False), d.fill_null(0).to_numpy()
            by = np.lexsort((ids, known))
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            lists = rows.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(by)), np.diff(lists.offsets.to_numpy()))
            term, tf = lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy()
            impact = impacts(tf, n[doc], weights[term], documents, length)
            if len(term):
                search(build(term, place[doc], impact, len(weights), len(by)), known[by], ids[by], queries, best)

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= BLOCK_POSTINGS:
                settle()
                held, size = [], 0
        if held:
            settle()
        q, at = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best.id[q, at], mask=~best.known[q, at]), pa.array(best.score[q, at])], ["q", "d", "score"])

    return counted.mapInArrow(run, "q int, d bigint, score bigint")


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("d").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each query the ``k`` documents of the highest score above 0, equal scores by doc_id (null first).

    All rows are ranked over whole texts: a repeated row is a document of its own, a null or empty
    text has no terms, counts nowhere and is never found. Queries that are equal in id
    and text are one; a query without terms has no rows; equal ids with different texts are ranked apart.
    An empty table on either side gives an empty result. Other columns are not looked at.

    Memory: a task holds one block of postings (``BLOCK_POSTINGS``, or one batch of documents) and the best
    documents of one lot of queries. Lots are cut by hash so that their mean size is at most ``LOT_BYTES`` and ``LOT_ROWS``.
    """
    spark = docs.sparkSession
    kind = queries.schema[item_id].dataType.simpleString()
    wanted = queries.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t IS NOT NULL").distinct()
    wanted = checkpointed(wanted.withColumn("h", F.xxhash64("item_id", "t")))
    n, size = wanted.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    lots = max(1, ceil(n / LOT_ROWS), ceil((size or 0) / LOT_BYTES))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for lot in range(lots):
        rows = wanted.where(F.pmod("h", F.lit(lots)) == lot).select("item_id", "t").toArrow()
        vocabulary: dict[bytes, int] = {}
        terms = []
        for t in rows.column("t").to_pylist():
            words = {w for part in term_lists(t.encode()) for w in part}
            terms.append(np.array(sorted(vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64))
        if not vocabulary:
            continue
        counted = checkpointed(_counted(docs, doc_id, text, vocabulary))
        documents, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
        for r in holding.toLocalIterator():  # a number for each term of the lot
            weights[r["term"]] = floor(1000 * log((2 * documents + 2) / (2 * r["count"] + 1)))
        found = _searched(counted, terms, weights, documents, length, k)
        found = _ranked(found.withColumn("part", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))), k, "q", "part")
        found = _ranked(found, k, "q")
        items = spark.createDataFrame(pa.table({"q": pa.array(range(len(terms)), pa.int32()), "item_id": rows.column("item_id")}))  # of one lot
        out = out.unionByName(found.join(F.broadcast(items), "q").select("item_id", "rank", F.col("d").alias("doc_id"), "score"))
    return out


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL_OP12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_TERMS} AS t FROM documents),
     x AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM d WHERE len(t) > 0),
     s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM x),
     q AS (SELECT DISTINCT item_id, text, unnest({_SQL_TERMS}) AS term FROM benchmark),
     p AS (SELECT r, doc_id, n, unnest(t) AS term FROM x),
     f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
     w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, nn),
     y AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
           FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, text, r, doc_id),
     z AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM y WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM z WHERE rank <= {K}
"""
