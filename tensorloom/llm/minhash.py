"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation scatters a text's shingles over 2^32 places; a second one,
shifted by k places for the k-th coordinate, ranks them. So two permutations
give all coordinates of a signature. Texts that agree in a band of coordinates
are candidates, and every link is confirmed on the full shingle sets.

Texts with equal sets form one class first. Within a bucket, candidates are
tested against the smallest class (a star, not all pairs). Only buckets whose
other members are still in several components afterwards are looked at again.
Members meet in blocks of bounded size, and each block reports a spanning forest of its
confirmed links. Members of very large buckets may meet where they share a rare
shingle instead: with shingles ordered by how many of these members have them,
rarest first, two sets of a similarity of s share one among their first (1 - s) of
shingles, so pages of a template that have texts of their own do not meet at all.
Both ways find the same links; the one that brings fewer members together is taken.
No link between components is lost, and none of the pairs that are already
connected are made.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, chunks, mix, spans_hash, texts, words
from .common import checkpointed, components, discard, fresh, reshuffled, table

#: Bands and coordinates in each. A pair at similarity 0.85 stays unseen with a chance of 6e-9, at 0.8 of 6e-7.
BANDS, ROWS = 20, 3
#: Members of a block in the second look, and shingles of its members, about; two blocks meet in one task.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Buckets of more blocks are looked at by rare shingles too.
LARGE_BLOCKS = 16
_U, _W = np.uint64, np.uint32


#: Words of so many bytes are hashed by a digest: for a polynomial there are long words of equal hash, whatever its base.
LONG_WORD = 256


def shingles(codes: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text, A-Z lower-cased; fewer words form one shingle."""
    starts, ends, first = words(codes, offsets)
    if not len(starts):
        return [np.zeros(0, _U)] * (len(offsets) - 1)
    low = LOWER[codes]
    h = spans_hash(low, starts, ends)
    for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        h[k] = int.from_bytes(blake2b(low[starts[k] : ends[k]].tobytes(), digest_size=8).digest())
    count = max(len(h) - n + 1, 0)
    run = h[:count].copy()
    for i in range(1, n):
        run = mix(run * _U(0x9E3779B97F4A7C15) + h[i : i + count])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(run[a : b - n + 1]))
        elif b > a:
            x = h[a : a + 1]
            for i in range(a + 1, b):
                x = mix(x * _U(0x9E3779B97F4A7C15) + h[i : i + 1])
            out.append(mix(x + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def _rank(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 2^32 places."""
    x = x ^ (x >> _W(16))
    x = x * _W(0x7FEB352D)
    x ^= x >> _W(15)
    x *= _W(0x846CA68B)
    x ^= x >> _W(16)
    return x


_SHIFTS = np.arange(BANDS * ROWS, dtype=_W)[:, None] * _W(0x9E3779B1)


def signature(s: np.ndarray) -> np.ndarray:
    """Coordinate k: the smallest rank of any shingle's place under the second permutation, shifted by the k-th step."""
    place = (mix(s + _U(0xA0761D6478BD642F)) >> _U(32)).astype(_W)  # the first permutation
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, _W)
    for a in range(0, len(place), 4096):
        np.minimum(out, _rank(place[None, a : a + 4096] - _SHIFTS).min(axis=1), out=out)
    return out


_BAND = mix(np.arange(1, BANDS + 1, dtype=_U))


def bands(s: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, distinct between bands."""
    sig = signature(s).astype(_U).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for k in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, k])
    return key


def _signed(batches, n: int):
    """(doc_id, text) to doc_id, set size, 128-bit hash of the set and band keys."""
    for batch in batches:
        codes, offsets = texts(batch.column(1))
        for a, b in chunks(offsets):
            sets = shingles(codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
            with np.errstate(over="ignore"):
                s1 = np.array([mix(s).sum(dtype=_U) for s in sets], _U).view(np.int64)
                s2 = np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) for s in sets], _U).view(np.int64)
            keys = [bands(s) if len(s) else np.zeros(0, _U) for s in sets]
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "n", "s1", "s2", "bands"],
            )


def _alike(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _confirmed(batches, n: int, percent: int):
    """(a, b, text of a, text of b) to the (a, b) that are alike."""
    last, known = None, None
    for batch in batches:
        ids_a, ids_b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        codes_a, at_a = texts(batch.column(2))
        codes_b, at_b = texts(batch.column(3))
        good = np.zeros(len(ids_a), bool)
        for x, y in chunks(at_b):
            sets = shingles(codes_b[at_b[x] : at_b[y]], at_b[x : y + 1] - at_b[x], n)
            for i in range(x, y):
                text = codes_a[at_a[i] : at_a[i + 1]]
                if last is None or len(text) != len(last) or not np.array_equal(text, last):
                    last, known = text.copy(), shingles(text, np.array([0, len(text)]), n)[0]
                s = sets[i - x]
                good[i] = bool(len(s)) and _alike(_common(known, s), len(known), len(s), percent)
        yield pa.RecordBatch.from_arrays([pa.array(ids_a[good], pa.int64()), pa.array(ids_b[good], pa.int64())], ["a", "b"])


def _forest(n_words: int, percent: int):
    """Per block: confirmed links between different labels, as a spanning forest."""

    def links(t: pa.Table) -> pa.Table:
        ids, labels = t.column("rep").to_numpy(), t.column("label").to_numpy()
        codes, offsets = texts(t.column("text"))
        sets = []
        for a, b in chunks(offsets):
            sets += shingles(codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n_words)
        root = {x: x for x in [*labels.tolist(), *ids.tolist()]}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(ids.tolist(), labels.tolist()):
            root[find(x)] = find(y)
        size = np.array([len(s) for s in sets])
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        counts = np.diff(np.append(head, len(token)))
        column = np.repeat(np.arange(len(head)), counts)
        shared = counts[column] > 1
        _, column = np.unique(column[shared], return_inverse=True)
        owner = owner[shared]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
            here = (column >= a) & (column < a + 4096)
            x = np.zeros((len(sets), 4096), np.float32)
            x[owner[here], column[here] - a] = 1
            common += x @ x.T
        common = common.astype(np.int64)
        like = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        out = []
        for i, j in zip(*np.nonzero(np.triu(like, 1))):
            a, b = find(ids[i]), find(ids[j])
            if a != b and size[i] and size[j]:
                root[a] = b
                out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return links


def links(docs: DataFrame, sigs: DataFrame, n: int, percent: int) -> DataFrame:
    """``(node, component)`` for every id that is linked with another, from ids, texts and signatures."""
    named = sigs.where("n > 0 AND doc_id IS NOT NULL")
    classes = checkpointed(named.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("n", "s1", "s2", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")))
    copies = named.join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    each = classes.select("rep", "n", F.explode("bands").alias("key"))
    hubs = each.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # members of buckets with company, and the class that each is tested against first
    members = checkpointed(each.join(hubs.select(reshuffled("key").alias("k"), "hub", "size"), F.col("key") == F.col("k")).where("rep != hub.rep").select("key", "rep", "n", "size", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")))
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    pairs = members.where(near(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    text = docs.select("doc_id", "text")
    right = pairs.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    found = checkpointed(both.mapInArrow(lambda it: _confirmed(it, n, percent), "a bigint, b bigint").unionByName(copies))
    joined = components(found)
    # Second look: members other than the hub that ended in different components.
    labelled = members.where("size > 2").join(joined, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label"))
    open_ = checkpointed(_undecided(labelled))
    more = None
    if open_.limit(1).count():
        large, rare = open_.where(F.col("blocks") > LARGE_BLOCKS), None
        brought = large.agg(F.sum("blocks")).first()[0]  # each member comes once for every block
        if brought:
            rare = checkpointed(_undecided(_rare(large, text, n, percent)))
            if (rare.agg(F.sum("blocks")).first()[0] or 0) < brought:
                large = rare
        more = _meet(open_.where(F.col("blocks") <= LARGE_BLOCKS), text, n, percent)
        more = more.unionByName(_meet(large, text, n, percent)) if brought else more
        more = checkpointed(more)
        if more.limit(1).count():
            joined = components(found.unionByName(more))
        discard(more, *([rare] if rare is not None else []))
    discard(classes, members, found, open_)
    return joined


def _undecided(labelled: DataFrame) -> DataFrame:
    """Of groups ``(key, rep, n, label)`` those with several labels, once for groups of the same members: ``(key, rep, label, blocks)``."""
    split = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("c")).where("l < h")
    once = split.groupBy("m", F.col("n").alias("total"), "c").agg(F.min("key").alias("k"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    return labelled.join(once, F.col("key") == F.col("k")).select("key", "rep", "label", blocks.alias("blocks"))


def _meet(open_: DataFrame, text: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links between different labels of each group, whose members meet block by block."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = open_.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "rep", "label", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    met = met.join(text.withColumnRenamed("doc_id", "rep"), "rep")
    return met.groupBy("key", "i", "j").applyInArrow(_forest(n, percent), "a bigint, b bigint")


def _rare(large: DataFrame, text: DataFrame, n: int, percent: int) -> DataFrame:
    """Members of large groups by shingle, ``(key, rep, n, label)``: for each its rarest ones, as many as any partner must share one of."""
    def sets(batches):
        for batch in batches:
            codes, offsets = texts(batch.column(2))
            for a, b in chunks(offsets):
                got = shingles(codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in got])]).astype(np.int32))
                flat = np.concatenate(got).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.ListArray.from_arrays(ends, pa.array(flat))], ["rep", "label", "s"])

    members = large.select("rep", "label").distinct().join(text.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "label", "text")
    # rows that share an id are one member with the shingles of all
    each = members.mapInArrow(sets, "rep bigint, label bigint, s array<bigint>").select("rep", "label", F.explode("s").alias("token")).distinct()
    each = checkpointed(each)
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("held")).select(reshuffled("token").alias("t"), "held")
    ranked = each.join(common, F.col("token") == F.col("t")).groupBy("rep", "label").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("s"))  # a text's shingles
    first = F.expr(f"size(s) - CAST(ceil(size(s) * {percent} / 100) AS INT) + 1")
    rare = ranked.select("rep", "label", F.size("s").alias("n"), F.inline(F.slice("s", F.lit(1), first)))
    return rare.where("held > 1").select(F.col("token").alias("key"), "rep", "n", "label")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    Texts are linked if ``100 * |A and B| >= percent * |A or B|`` for their sets of
    ``n``-word shingles. Null, empty and wordless texts have an empty set and
    are linked with nothing. Rows that share an id are one document, linked if
    any of its texts is. A row without id is linked with nothing; its
    component is null and it is kept. Columns besides are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = checkpointed(docs.mapInArrow(lambda it: _signed(it, n), "doc_id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"))
    joined = links(docs, sigs, n, percent)
    out = sigs.join(joined, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest id; rows that repeat an id stay."""
    (drop,) = fresh(docs, "near_drop")
    gone = near_duplicates(docs, n, percent).where("NOT kept").select(F.col("doc_id").alias(drop)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(drop), "left_anti")


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
