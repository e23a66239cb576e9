"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt by hash to shards of bounded size, and each shard packs on
its own. Its open bins lie ordered by residual capacity and carry two bitmaps:
the sources and the duplicate clusters they hold. A piece takes the tightest
bin that it fits and shares no bit with; the search goes from its successor
among the residuals upwards and opens a new bin only if none is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, word_list

#: Words in a bin.
CAPACITY = 2048
#: Documents in a shard, about.
SHARD_DOCS = 8192
_SCHEMA = "doc_id bigint, piece int, doc_offset bigint, size bigint, bin_id bigint, bin_offset bigint"


#: Bins that a search looks at one after the other before it turns to the lists of bins with equal sources.
WALK = 32


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece, in the given order. Sources and clusters are bit numbers; a negative one conflicts with nothing.

    Open bins are kept in one list and again by their sources. Where most bins
    conflict, the lists whose sources are free of the piece's give their tightest
    bins, so bins that hold the source are not walked through.
    """
    open_: list[tuple[int, int]] = []  # (residual, bin), ordered
    alike: dict[int, list[tuple[int, int]]] = {}  # the same by bitmap of sources
    held: list[tuple[int, int]] = []  # bitmaps of each bin
    out = []

    def first(bins: list[tuple[int, int]], size: int, s: int, c: int, most: int) -> tuple[int, int]:
        """The place of the tightest compatible bin, -1 if there is none, and whether the search ended by itself."""
        at = bisect_left(bins, (size, -1))
        for k in range(at, min(len(bins), at + most)):
            have = held[bins[k][1]]
            if not (have[0] & s or have[1] & c):
                return k, 1
        return -1, at + most >= len(bins)

    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at, ended = first(open_, size, s, c, WALK)
        if not ended:
            places = ((bins, first(bins, size, s, c, len(bins))[0]) for mask, bins in alike.items() if not mask & s)
            best = min((bins[k] for bins, k in places if k >= 0), default=None)
            at = -1 if best is None else bisect_left(open_, best)
        if at >= 0:
            residual, b = open_.pop(at)
            bins = alike[held[b][0]]
            bins.pop(bisect_left(bins, (residual, b)))
            held[b] = (held[b][0] | s, held[b][1] | c)
        else:
            residual, b = capacity, len(held)
            held.append((s, c))
        out.append((b, capacity - residual))
        if residual > size:
            insort(open_, (residual - size, b))
            insort(alike.setdefault(held[b][0], []), (residual - size, b))
    return out


def _pack_shard(capacity: int):
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def pack(t: pa.Table) -> pa.Table:
        ids, named = t.column("doc_id").fill_null(0).to_numpy(), t.column("doc_id").is_valid().to_numpy()
        size, cluster = t.column("size").to_numpy(), t.column("cluster").to_numpy()
        # numbers of the distinct sources; null is a source
        source = t.column("source").combine_chunks().dictionary_encode().indices
        source = source.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        first = np.lexsort((source, cluster, ids, named, -size))
        first = np.repeat(first, t.column("copies").to_numpy()[first])
        ids, named, size, cluster, source = (x[first] for x in (ids, named, size, cluster, source))
        # an overlong document fills whole bins; only its rest competes for room
        pieces = np.maximum(-(-size // capacity), 1)
        row = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        part = np.minimum(size[row] - piece * capacity, capacity)
        # a cluster with one row here cannot conflict
        cluster, n = np.unique(cluster, return_inverse=True, return_counts=True)[1:]
        bit = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[cluster]
        order = np.lexsort((row, -part))
        order = order[part[order] > 0]
        bins, offset = np.full(len(row), -1, np.int64), np.zeros(len(row), np.int64)
        placed = best_fit(part[order].tolist(), source[row[order]].tolist(), bit[row[order]].tolist(), capacity)
        if placed:
            bins[order], offset[order] = np.array(placed, np.int64).T
        bin_id = pa.array((t.column("shard")[0].as_py() << 32) + bins, mask=bins < 0)
        return pa.table([pa.array(ids[row], mask=~named[row]), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(part), bin_id, pa.array(offset)], names)

    return pack


def pack(docs: DataFrame, size: Column, cluster: Column, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row a piece: ``(doc_id, piece, doc_offset, size, bin_id, bin_offset)``.

    No bin exceeds ``capacity`` or holds two pieces of one source (null is a
    source) or of one ``cluster``. A document above the capacity is split into
    pieces that cover it without gap. One without size has one piece of size 0
    and a null bin. Rows that repeat are packed as often as they stand, each in
    another bin. Only ids, sources, clusters and sizes are shuffled. Equal rows
    are counted first and dealt in lots of ``shard_docs`` at most, so an id that
    repeats without end fills no shard, and the shard of a row depends on rows alone.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), cluster.cast("long").alias("cluster"), size.cast("long").alias("size"))
    shards = max(1, -(-docs.count() // shard_docs))
    same = ["doc_id", "source", "cluster", "size"]
    counted = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    lots = counted.select(*same, "n", F.explode(F.expr(f"sequence(0L, (n - 1) DIV {shard_docs})")).alias("lot"))
    copies = F.least(F.lit(shard_docs), F.col("n") - F.col("lot") * shard_docs).cast("int")
    lots = lots.select(*same, copies.alias("copies"), F.pmod(F.xxhash64(*same, "lot"), F.lit(shards)).alias("shard"))
    return lots.groupBy("shard").applyInArrow(_pack_shard(capacity), _SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents packed by words, no two exact duplicates or two documents of a source in a bin.

    Texts of the same words in lower case are one cluster: the hash of the word list.
    """
    (words,) = fresh(docs, "pack_words")
    split = docs.select("doc_id", "source", word_list(F.lower(F.col("text"))).alias(words))
    return pack(split, F.size(words), F.xxhash64(words), capacity)


def packed_texts(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """One row a bin: ``(bin_id, doc_ids, text)`` with the words of its pieces in order, for ids that do not repeat."""
    (words,) = fresh(docs, "pack_words")
    split = docs.select("doc_id", word_list(F.col("text")).alias(words))
    part = F.array_join(F.slice(words, (F.col("doc_offset") + 1).cast("int"), F.greatest(F.col("size"), F.lit(0)).cast("int")), " ")
    joined = packed.where("bin_id IS NOT NULL").join(split, "doc_id").select("bin_id", "bin_offset", "doc_id", part.alias("part"))
    rows = joined.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id", "part"))).alias("p"))  # at most ``capacity`` words
    return rows.select("bin_id", F.col("p.doc_id").alias("doc_ids"), F.array_join("p.part", " ").alias("text"))


def op4_bestfit_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
