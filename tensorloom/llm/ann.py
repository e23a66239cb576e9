"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every row is filed under a leaf. Leaves that
hold too many rows get a subtree each, fitted on the executors on a bounded sample of
the leaf's own rows, so the number of leaves grows with the table. A query walks the
tree through a priority queue of nodes, best first, and visits leaves in that order. How many it visits is calibrated: some queries are answered
exactly, and visits are widened until those would reach the wanted recall.
Leaves are searched in blocks of bounded size, so a leaf with a third of all
rows is many tasks' work. Matrix products only make a short list, with room for
their rounding; scores are then added up component by component, so they and
the order of ties depend on the two vectors alone.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, table

#: Rows that the tree is fitted on, at most: those with the smallest hashes of their ids. About as many for each subtree.
SAMPLE_ROWS = 8192
#: Leaves with more rows get a subtree.
LEAF_MOST = 16384
#: Bytes of the tree at most, as all tasks get it, and nodes of a subtree, about; beyond that the smaller ones of the large leaves stay whole.
TREE_BYTES, SUBTREE_NODES = 256 << 20, 1024
#: Children of a node; sample rows of a leaf, at most, if they differ.
BRANCHES, LEAF_ROWS = 8, 48
#: Queries that are answered exactly for calibration, at most, and the mean recall that they must reach.
CALIBRATION, RECALL = 128, 0.95
#: Rows and queries that meet in one task's block, about.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
NEAREST = 20


@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root. ``leaf`` numbers the leaves, -1 for inner nodes."""

    centre: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    held: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: from the root to the nearest child's centre, again and again."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centre[self.children[node]]
            near = np.argmax(x[rows] @ c.T - (c * c).sum(axis=1) / 2, axis=1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def graft(self, subtrees: dict[int, Tree]) -> Tree:
        """The tree with subtrees in the place of leaves; leaves are numbered anew."""
        centre, spread, children, leaf = [self.centre], [self.spread], [list(c) for c in self.children], self.leaf.tolist()
        for node in np.flatnonzero(self.leaf >= 0).tolist():
            sub = subtrees.get(int(self.leaf[node]))
            if sub is None or sub.leaves < 2:
                continue
            base = len(children) - 1  # the subtree's root is the leaf itself
            children[node] = [base + c for c in sub.children[0]]
            leaf[node] = -1
            centre.append(sub.centre[1:])
            spread.append(sub.spread[1:])
            children += [[base + c for c in cs] for cs in sub.children[1:]]
            leaf += sub.leaf[1:].tolist()
        number = np.array(leaf)
        number[number >= 0] = np.arange((number >= 0).sum())
        return Tree(np.concatenate(centre), np.concatenate(spread), children, number)

    def order(self, q: np.ndarray, visits: int, least: int, wanted: list[set[int]] | None = None) -> list[list[int]]:
        """Leaves that each query visits, best bin first: ``visits`` of them, and on until they hold ``least`` rows; with
        ``wanted``, until these leaves are among them. Only children of nodes that are taken from the queue are scored."""
        inside = [np.array(c, np.int64) for c in self.children]
        out = []
        for i, x in enumerate(q):
            length = float(np.linalg.norm(x))
            queue, got, rows, missing = [(0.0, 0)], [], 0, set(wanted[i]) if wanted else None
            while queue and (missing if wanted else len(got) < visits or rows < least):
                _, node = heappop(queue)
                if self.children[node]:
                    at = inside[node]
                    for hope, child in zip((self.centre[at] @ x + length * self.spread[at]).tolist(), self.children[node]):
                        heappush(queue, (-hope, child))
                else:
                    got.append(int(self.leaf[node]))
                    if wanted:
                        missing.discard(got[-1])
                    else:
                        rows += self.held[got[-1]]
            out.append(got)
        return out


def _kmeans(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centre.T - (centre * centre).sum(axis=1) / 2, axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return near


def grow(x: np.ndarray, seed: int = 0) -> Tree:
    """A tree over the rows of ``x``; rows that are all equal are not parted."""
    random = np.random.default_rng(seed)
    centre, spread, children, leaf, todo, leaves = [], [], [], [], [(np.arange(len(x)), -1)], 0
    while todo:
        rows, parent = todo.pop()
        node = len(centre)
        mean = x[rows].mean(axis=0)
        centre.append(mean)
        # the spread along one direction, twice: what a good row of the node may gain over its centre
        spread.append(2 * float(np.sqrt(((x[rows] - mean) ** 2).sum(axis=1).mean() / x.shape[1])))
        children.append([])
        leaf.append(-1)
        if parent >= 0:
            children[parent].append(node)
        parts = []
        if len(rows) > LEAF_ROWS:
            near = _kmeans(x[rows], min(BRANCHES, len(rows)), random)
            parts = [rows[near == k] for k in range(BRANCHES) if (near == k).any()]
        if len(parts) > 1:
            todo += [(p, node) for p in parts]
        else:
            leaf[node] = leaves
            leaves += 1
    return Tree(np.array(centre), np.array(spread), children, np.array(leaf))


def usable(vector: str) -> Column:
    """Neither null, zero nor with null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of ``q`` with the rows of ``x``, added up from the first component to the last, whatever the number of rows."""
    out = np.zeros(len(x))
    for k in range(len(q)):
        out += q[k] * x[:, k]
    return out


class Rows:
    """Rows that queries are compared with: distinct or repeated ids, vectors, and the longest vector's length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.distinct = len(np.unique(ids)) == len(ids)
        self.longest = float(np.sqrt((x * x).sum(axis=1).max())) if len(x) else 0.0

    def best(self, q: np.ndarray, guess: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (id, score) among ``rows``: by score, ties to the smaller id; an id that repeats counts with its best score.

        ``guess`` are the products up to rounding, which is below width * 2^-52 * |q| * |x| each.
        """
        if len(rows) > 2 * k:
            near = guess[rows]
            per_id = near if self.distinct else _once(self.ids[rows], near)[1]
            if len(per_id) > k:
                slack = 4 * len(q) * 2.0**-52 * float(np.linalg.norm(q)) * self.longest
                rows = rows[near >= np.partition(per_id, len(per_id) - k)[len(per_id) - k] - slack]
        ids, score = self.ids[rows], dots(q, self.x[rows])
        if not self.distinct:
            ids, score = _once(ids, score)
        first = np.lexsort((ids, -score))[:k]
        return ids[first], score[first]


_FOUND = "query_id bigint, vec_id bigint, score double"


def _table(query: list, ids: list, score: list) -> pa.Table:
    flat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
    return pa.table({"query_id": flat(query, np.int64), "vec_id": flat(ids, np.int64), "score": flat(score, np.float64)})


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, recall: float = RECALL, seed: int = 0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product found for each query row, its own id left out.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do null ids and vectors of another length than most have. An id
    that repeats counts once, with its best score. If fewer than ``k`` other rows
    exist, all are found. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).where("id IS NOT NULL").where(usable("v"))
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if widths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = widths[0]
    rows = rows.where(F.size("v") == width)
    pick = lambda df, n: df.orderBy(F.xxhash64("id"), "id").limit(n)
    sample = pick(rows.select("id", "v"), SAMPLE_ROWS).toArrow()
    tree = grow(_matrix(sample.column("v"), width), seed)

    schema = "id bigint, v array<double>, q boolean, leaf int"

    def filing(tree: Tree):
        shared = spark.sparkContext.broadcast(tree)  # at most TREE_BYTES

        def filed(batches):
            for batch in batches:
                leaf = shared.value.file(_matrix(batch.column(1), width)) if batch.num_rows else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leaf, pa.int32())], ["id", "v", "q", "leaf"])

        return filed

    def counted(rows: DataFrame, tree: Tree) -> np.ndarray:
        held = np.zeros(tree.leaves, np.int64)
        for r in rows.groupBy("leaf").count().collect():  # one row a leaf
            held[r[0]] = r[1]
        return held

    rows = checkpointed(rows.mapInArrow(filing(tree), schema))
    held = counted(rows, tree)
    if held.max() > LEAF_MOST:
        # as many subtrees as the tree has room for, for the largest leaves first; the other leaves stay large
        room = max(1, TREE_BYTES // (8 * (width + 1) * SUBTREE_NODES))
        split = np.where((held > LEAF_MOST) & (np.argsort(np.argsort(-held, kind="stable"), kind="stable") < room), held, 0)
        whole, tree = rows, tree.graft(_subtrees(rows, split, width, seed))
        rows = checkpointed(whole.mapInArrow(filing(tree), schema))
        discard(whole)
        held = counted(rows, tree)
    tree.held = held.tolist()
    visits = calibrate(rows, tree, width, k, recall)

    # small leaves share a block of rows, large ones have several
    group, row_blocks = _blocks(held)
    group_of = np.array(group)

    shared = spark.sparkContext.broadcast(tree)

    def visited(batches):
        tree = shared.value
        for batch in batches:
            q = _matrix(batch.column(1), width)
            row, block, leaves = [], [], []
            for i, got in enumerate(tree.order(q, visits, k + 1) if len(q) else []):
                own = group_of[got]
                for g in np.unique(own):
                    row.append(i)
                    block.append(g)
                    leaves.append([x for x, y in zip(got, own) if y == g])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(block, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["id", "v", "block", "leaves"])

    queries = rows.where("q").select("id", "v").mapInArrow(visited, "id bigint, v array<double>, block int, leaves array<int>")
    queries = checkpointed(queries)
    asked = np.zeros(len(row_blocks), np.int64)
    for r in queries.groupBy("block").count().collect():  # one row a block
        asked[r[0]] = r[1]
    query_blocks = np.maximum(-(-asked // BLOCK_QUERIES), 1).tolist()
    block_of = F.broadcast(spark.createDataFrame(list(enumerate(group)), "leaf int, block int"))  # one row a leaf
    parts = [(g, r, q) for g, (r, q) in enumerate(zip(row_blocks, query_blocks))]
    parts = F.broadcast(spark.createDataFrame(parts, "block int, row_parts long, query_parts long"))  # one row a block
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    left = queries.join(parts, "block").withColumn("j", own("query_parts")).withColumn("i", each("row_parts"))
    right = rows.select("id", "v", "leaf").join(block_of, "leaf").join(parts, "block")
    right = right.withColumn("i", own("row_parts")).withColumn("j", each("query_parts"))
    left, right = left.drop("row_parts", "query_parts"), right.drop("row_parts", "query_parts")

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            ids, leaf = b.column("id").to_numpy(), b.column("leaf").to_numpy()
            asking, held_here = _matrix(a.column("v"), width), Rows(ids, _matrix(b.column("v"), width))
            guess = asking @ held_here.x.T
            # leaves by number, so a query's own leaves are looked up at once
            numbers, leaf = np.unique(leaf, return_inverse=True)
            for q, v, s, leaves in zip(a.column("id").to_numpy(), asking, guess, a.column("leaves").to_pylist()):
                open_ = np.flatnonzero(np.isin(numbers, leaves)[leaf] & (ids != q))
                found = held_here.best(v, s, open_, k)
                for got, y in zip(out, (np.full(len(found[0]), q), *found)):
                    got.append(y)
        return _table(*out)

    found = left.groupBy("block", "i", "j").cogroup(right.groupBy("block", "i", "j")).applyInArrow(met, _FOUND)
    return _ranked(found, k)


def _subtrees(rows: DataFrame, held: np.ndarray, width: int, seed: int) -> dict[int, Tree]:
    """A tree for each leaf with too many rows, fitted where its sample is: about ``SAMPLE_ROWS`` of its ids, by their hashes."""
    large = [(int(n), int(-(-held[n] // SAMPLE_ROWS))) for n in np.flatnonzero(held > LEAF_MOST)]
    large = F.broadcast(rows.sparkSession.createDataFrame(large, "leaf int, one_in long"))  # leaves of the first tree
    sample = rows.join(large, "leaf").where(F.pmod(F.xxhash64(F.lit(1), "id"), F.col("one_in")) == 0)
    sample = sample.groupBy("leaf", "id").agg(F.min("v").alias("v"))

    def fit(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        tree = grow(_matrix(t.column("v"), width)[order], seed)
        packed = pickle.dumps((tree.centre.astype(np.float32), tree.spread.astype(np.float32), tree.children, tree.leaf))
        return pa.table({"leaf": t.column("leaf").slice(0, 1), "tree": pa.array([packed], pa.binary())})

    out = {}
    for leaf, packed in sample.groupBy("leaf").applyInArrow(fit, "leaf int, tree binary").collect():  # bounded by samples, some 100 KB each
        centre, spread, children, number = pickle.loads(packed)  # noqa: S301  written by the tasks above
        out[leaf] = Tree(centre.astype(float), spread.astype(float), children, number)
    return out


def _blocks(held: np.ndarray) -> tuple[list[int], list[int]]:
    """A block number for each leaf and the parts of each block, so that a part has ``BLOCK_ROWS`` rows, about."""
    group, parts, room = [], [], 0
    for n in held.tolist():
        if not parts or n > room:
            parts.append(max(1, -(-n // BLOCK_ROWS)))
            room = BLOCK_ROWS * parts[-1]
        group.append(len(parts) - 1)
        room -= n
    return group, parts


def _once(ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An id that repeats stands once, with its best score."""
    unique = np.unique(ids)
    if len(unique) == len(ids):
        return ids, score
    order = np.argsort(ids, kind="stable")
    return unique, np.maximum.reduceat(score[order], np.searchsorted(ids[order], unique))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, queries: list[tuple[int, np.ndarray]], width: int, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries among all ``rows(id, v)``: partial results of each batch, then the best."""
    ids = np.array([q[0] for q in queries], np.int64)
    matrix = np.array([q[1] for q in queries]).reshape(len(queries), width)

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                out: tuple[list, list, list] = ([], [], [])
                rows_ = Rows(own, _matrix(batch.column(1), width))
                for q, v, guess in zip(ids, matrix, matrix @ rows_.x.T):
                    best = rows_.best(v, guess, np.flatnonzero(own != q), k)
                    for got, y in zip(out, (np.full(len(best[0]), q), *best)):
                        got.append(y)
                yield from _table(*out).to_batches()

    return _ranked(rows.select("id", "v").mapInArrow(partial, _FOUND), k)


def calibrate(rows: DataFrame, tree: Tree, width: int, k: int, recall: float) -> int:
    """The smallest number of leaf visits with which the calibration queries reach ``recall``."""
    some = rows.where("q").select("id", "v").orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toArrow()
    if not some.num_rows:
        return 1
    q = _matrix(some.column("v"), width)
    queries = list(zip(some.column("id").to_pylist(), q))
    true = exact(rows, queries, width, k)
    # leaves of the true neighbours: the neighbours are few, so they are sent to the rows
    near = rows.select(F.col("id").alias("vec_id"), "leaf").join(F.broadcast(checkpointed(true)), "vec_id").select("query_id", "leaf").toPandas()
    wanted = {i: g.to_numpy() for i, g in near.groupby("query_id")["leaf"]}
    at = []
    for (i, _), order in zip(queries, tree.order(q, tree.leaves, 0, [{*wanted.get(i, [])} for i, _ in queries])):
        place = {leaf: n + 1 for n, leaf in enumerate(order)}
        at += [place[x] for x in wanted.get(i, [])]
    return int(np.sort(at)[max(0, int(np.ceil(recall * len(at))) - 1)]) if at else 1


def op5_ann_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
