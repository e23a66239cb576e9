"""Removal of long byte strings that repeat from documents with smaller ids, by threshold-bounded interval expansion.

Strings of ``length`` bytes meet where their texts put them: each has a minimizer,
the least hash of its short substrings, so equal strings have equal minimizers.
A document falls apart into pieces, runs of string starts with one minimizer.

1. Documents are stored in chunks, and each chunk names its minimizers.
2. Minimizers are compared in buckets; each chunk learns which occur in several documents.
3. Chunks send the pieces of those minimizers to buckets, equal pieces of a chunk once.
   Pieces of a minimizer that stands in very many contexts are cut into single strings
   first, which go to buckets by their own hashes, so no bucket grows with one
   minimizer. As such a string may stand in every chunk, its smallest document is
   found in two steps: among some thousand chunks each, then among what these found.
4. Each bucket builds the Burrows-Wheeler transform of its distinct pieces and
   extends intervals backwards, breadth first, so common prefixes are derived by
   increasing value, up to ``length``. What is then still undivided shares a string
   of ``length`` bytes; its smallest document keeps it.
5. Chunks turn the answers into removed ranges.

Chunks and buckets have bounded bytes; their numbers grow with the input.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import _VALUE, chunks, powers, spans_hash, texts
from .common import checkpointed, table

#: Bytes of a string in the query.
LENGTH = 50
#: Bytes of text in a chunk and behind a bucket, about.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 3 << 20
#: A minimizer is hot if it has so many units, each of up to four different pieces of one chunk (some 300 bytes):
#: its strings are dealt to buckets one by one, by their own hashes.
HOT_UNITS, UNIT_PIECES = 20_000, 4
#: Chunks whose hot strings meet first; bytes of text behind a partition, about, where the session's shuffle partitions are
#: too few, and the most partitions that are asked for (a task takes one group after the other, so larger ones only take longer).
FAN_IN, PARTITION_BYTES, MOST_PARTITIONS = 2048, 64 << 20, 50_000
#: Lots of a bucket that are settled together.
LOTS_AT_ONCE = 64
#: Starts that are hashed at once, and the bits that hold a place among them.
_BLOCK, _LOW = 1 << 15, (1 << 16) - 1
_U = np.uint64
_ROW = "chunk bigint, bucket int, data binary"
_BITS = "chunk bigint, bucket int, data binary, hot boolean"
_NONE = np.iinfo(np.int64).max


def _gram(length: int) -> int:
    """Bytes of the substrings whose least hash is the minimizer."""
    return max(1, min(length - 1, length * 22 // 50))


@lru_cache(maxsize=4)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def _press(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64)
    return _compressor(level).compress(b"".join(x.tobytes() for x in (head, *arrays)))


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _unpress(data: bytes, *kinds) -> list[np.ndarray]:
    raw = _decompressor().decompress(data)
    sizes = np.frombuffer(raw, np.int64, len(kinds), 8)
    at, out = 8 * (len(kinds) + 1), []
    for kind, n in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _minimizers(codes: np.ndarray, length: int) -> np.ndarray:
    """For each start of ``length`` bytes, the least hash of its grams, with the gram's place (modulo a block) in the low bits.

    Of equal hashes the first gram counts. Blocks are small enough for the cache.
    """
    k, n = _gram(length), len(codes) - length + 1
    width, low = length - k + 1, _U(_LOW)
    out = np.empty(n, _U)
    for a in range(0, n, _BLOCK):
        b = min(a + _BLOCK, n)
        part = codes[a : b + length - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(_VALUE[part] * up[: len(part)], dtype=_U, out=total[1:])
        h = (total[k:] - total[:-k]) * down[: len(part) - k + 1]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h &= ~low
        h |= np.arange(len(h), dtype=_U)
        span = 1
        while 2 * span <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if rest := width - span:
            h = np.minimum(h[:-rest], h[rest:])
        out[a:b] = h
    return out


def pieces(codes: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and minimizer hash of each piece, in order; at most ``length - gram + 1`` starts each."""
    if len(codes) < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    least = _minimizers(codes, length)
    inside = np.ones(len(least), bool)
    for end in offsets[1:].tolist():
        inside[max(0, end - length + 1) : end] = False
    # a text shorter than a string may lie inside the mark of the one before; its own mark covers it as well
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = least[1:] != least[:-1]
    new[1:] |= ~inside[:-1]
    new[_BLOCK::_BLOCK] = True  # places count anew
    new &= inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    ends = np.sort(np.concatenate([first[1:], stop]))
    ends = ends[np.searchsorted(ends, first, side="right")]
    h = (least[first] & ~_U(_LOW)) * _U(0x9E3779B97F4A7C15)
    return first, ends - first, h ^ (h >> _U(31))


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...``, ``count`` of them, for each row on end."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def _packed_words(text: np.ndarray) -> np.ndarray:
    """The first eight symbols of each suffix as one number."""
    n = len(text)
    wide = np.zeros(n + 8, _U)
    wide[:n] = text
    word = wide[:n].copy()
    for i in range(1, 8):
        word <<= _U(8)
        word |= wide[i : i + n]
    return word


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols (8 or more), the symbol before each (0 before the
    first), and their first eight symbols as numbers. Only suffixes that are still tied are sorted again."""
    n = len(text)
    word = _packed_words(text)
    order = np.argsort(word)
    word = word[order]
    rank = np.zeros(n + 1, np.int64)
    tied, part, key, at = np.arange(n), order, word, 8
    while True:
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        rank[part] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        open_ = ~new
        open_[:-1] |= ~new[1:]
        tied = tied[open_]
        if at >= depth or not len(tied):
            break
        step = min(at, depth - at)
        part = order[tied]
        key = (rank[part] << 32) | rank[np.minimum(part + step, n)]
        again = np.argsort(key)
        part, key = part[again], key[again]
        order[tied] = part
        at += step
    return order, np.concatenate([text[:1] * 0, text])[order], word


def expand(bwt: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, if below ``depth``; else ``depth``.

    Prefixes below eight are read off the packed words, eight levels in one. From
    there, breadth first: level L holds the intervals of words of L symbols whose
    upper bound was first found at the level before. Extending a word backwards by
    each symbol in its interval gives bounds of common prefix L; those not found
    before go on to the next level. Symbol 0 parts texts and is never crossed.
    """
    n = len(bwt)
    psi = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[psi] = np.arange(n)
    # the next and the last place before with the same symbol
    after, before = np.empty(n, np.int64), np.empty(n, np.int64)
    after[psi[:-1]], before[psi[1:]] = psi[1:], psi[:-1]
    heads = np.concatenate([[0], np.cumsum(np.bincount(bwt))])
    after[psi[heads[1:] - 1]], before[psi[heads[:-1][np.diff(heads) > 0]]] = n, -1
    prefix = np.full(n + 1, depth, np.int32)
    prefix[0] = prefix[n] = 0
    differ = words[1:] ^ words[:-1]
    found = differ != 0
    equal = np.zeros(n - 1, np.int32)
    for k in range(1, 8):
        equal += differ < _U(1 << (64 - 8 * k))
    prefix[1:n][found] = equal[found]
    low = np.concatenate([[0], np.flatnonzero(found) + 1])
    high = np.append(low[1:], n)
    word = words[low]
    ones = _U(0x0101010101010101)
    whole = ((word - ones) & ~word & (ones << _U(7))) == 0  # no symbol 0 among the eight
    go = whole & (prefix[high] == 7)
    low, high = low[go], high[go]
    for level in range(8, depth):
        if not len(low):
            break
        single = high - low == 1
        r = low[single]
        r = r[bwt[r] != 0]
        lows, highs = [lf[r]], [lf[r] + 1]
        wide_low, wide_high = low[~single], high[~single]
        size = wide_high - wide_low
        r = _spread(wide_low, size)
        ok = bwt[r] != 0
        begins = ok & (before[r] < np.repeat(wide_low, size))
        finishes = ok & (after[r] >= np.repeat(wide_high, size))
        # children are disjoint, so first and last places pair up in order
        lows.append(np.sort(lf[r[begins]]))
        highs.append(np.sort(lf[r[finishes]]) + 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = prefix[high] == depth
        low, high = low[fresh], high[fresh]
        prefix[high] = level
    return prefix[:n]


def keepers(text: np.ndarray, owner: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """For each start of ``length`` bytes in ``text`` (symbols from 1, each piece ended by a 0), the smallest owner of an equal string.

    ``owner`` and ``stop`` have for each symbol the owner and the end of its piece.
    Starts with fewer symbols before that end get the largest integer.
    """
    out = np.full(len(text), _NONE)
    order, bwt, words = transform(text, length)
    edge = expand(bwt, words, length) < length
    short = (stop - np.arange(len(text)) < length)[order]
    edge |= short
    edge[1:] |= short[:-1]
    edge[0] = True
    heads = np.flatnonzero(edge)
    least = np.minimum.reduceat(np.where(short, _NONE, owner[order]), heads)
    out[order] = np.repeat(least, np.diff(np.append(heads, len(text))))
    return out


_TEXTS = (np.int64, np.bool_, np.int64, np.uint8)


def _rows(chunk: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _stored(batches):
    """Step 1: (doc_id, text) to chunks of texts, bucket -1."""
    made = TaskContext.get().partitionId() << 32
    for batch in batches:
        codes, offsets = texts(batch.column(1))
        named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy()
        for a, b in chunks(offsets, CHUNK_BYTES):
            part, at = codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield from _rows(made, [(-1, _press(ids[a:b], named[a:b], at, part, level=3))]).to_batches()
            made += 1


def _named(buckets: int, length: int):
    """Step 1: chunks of texts to a row for each chunk and bucket of its distinct minimizers."""

    def name(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                ids, named, at, codes = _unpress(data.as_py(), *_TEXTS)
                start, count, h = pieces(codes, at, length)
                good = named[np.searchsorted(at, start, side="right") - 1]
                key, _, units = _counted(codes, start[good], count[good], _keys(h[good], buckets)[0], length)
                key = np.repeat(key, units)
                if len(key):
                    cut = np.flatnonzero(np.diff((key >> _U(32)).astype(np.int64))) + 1
                    low = (key & _U(0xFFFFFFFF)).astype(np.uint32)
                    rows = [(int(key[a] >> _U(32)), low[a:b].tobytes()) for a, b in zip([0, *cut], [*cut, len(key)])]
                    yield from _rows(chunk, rows).to_batches()

    return name


def _counted(codes: np.ndarray, start: np.ndarray, count: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct minimizers by key, which of them each piece has, and their units: different pieces, by fours. Few pieces are not compared."""
    key, back, pieces_ = np.unique(keys, return_inverse=True, return_counts=True)
    many = np.flatnonzero(pieces_[back] > 16 * UNIT_PIECES)
    if len(many):
        name = spans_hash(codes, start[many], start[many] + count[many] + length - 1)
        order = np.lexsort((name, back[many]))
        own, name = back[many][order], name[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (name[1:] != name[:-1])
        pieces_[np.unique(own)] = 0
        np.add.at(pieces_, own[new], 1)
    return key, back, -(-pieces_ // UNIT_PIECES)


def _keys(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 further bits of a minimizer as one number, and the bucket."""
    bucket = (h >> _U(32)) % _U(buckets)
    return bucket << _U(32) | h & _U(0xFFFFFFFF), bucket.astype(np.int64)


def _compared(t: pa.Table, most: int) -> pa.Table:
    """Step 2: for each chunk of a bucket, a bit for each minimizer, set if another chunk has it too, and one set if it is
    hot, as it has more than ``most`` units. Minimizers stand once for each unit; all but the first bits of one are idle."""
    blobs = [np.frombuffer(x.as_py(), np.uint32) for x in t.column("data")]
    ends = np.cumsum([0, *map(len, blobs)])
    _, back, units = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    once = np.concatenate([np.concatenate([[True], x[1:] != x[:-1]]) for x in blobs])
    shared, hot = np.bincount(back[once], minlength=len(units))[back] > 1, (units > most)[back]
    data = [np.packbits(shared[a:b]).tobytes() + np.packbits(hot[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "data": pa.array(data, pa.binary()), "hot": pa.array([bool(hot[a:b].any()) for a, b in zip(ends[:-1], ends[1:])])})


def _sent(buckets: int, length: int):
    """Step 3: a chunk's texts and bits to rows of distinct pieces by bucket, and a row, bucket -1, of where they stand."""

    def send(stored: pa.Table, bits: pa.Table) -> pa.Table:
        empty = _rows(0, [])
        if not stored.num_rows:
            return empty
        ids, named, at, codes = _unpress(stored.column("data")[0].as_py(), *_TEXTS)
        start, count, h = pieces(codes, at, length)
        doc = np.searchsorted(at, start, side="right") - 1
        good = named[doc]
        start, count, h, doc = start[good], count[good], h[good], doc[good]
        if not len(start):
            return empty
        key, bucket = _keys(h, buckets)
        unique, back, units = _counted(codes, start, count, key, length)
        by = {int(b.as_py()): d.as_py() for b, d in zip(bits.column("bucket"), bits.column("data"))}
        edges = np.flatnonzero(np.diff((unique >> _U(32)).astype(np.int64), prepend=-1, append=-1))
        told = [np.frombuffer(by[int(unique[a] >> _U(32))], np.uint8) for a in edges[:-1]]
        total = np.concatenate([[0], np.cumsum(units)])
        sizes = np.diff(total[edges]).tolist()
        first = total[:-1]  # where each minimizer's bits begin
        shared = np.concatenate([np.unpackbits(x[: len(x) // 2], count=n) for x, n in zip(told, sizes)]).astype(bool)[first]
        hot = np.concatenate([np.unpackbits(x[len(x) // 2 :], count=n) for x, n in zip(told, sizes)]).astype(bool)[first]
        low, high = np.full(len(unique), _NONE), np.full(len(unique), -_NONE)
        np.minimum.at(low, back, ids[doc])
        np.maximum.at(high, back, ids[doc])
        take = np.flatnonzero((shared | (low < high))[back])
        if not len(take):
            return empty
        start, count, doc, bucket, hot = start[take], count[take], doc[take], bucket[take], hot[back[take]]
        if hot.any():  # cut into single strings
            n = np.where(hot, count, 1)
            start, count, doc, bucket, hot = _spread(start, n), np.repeat(np.where(hot, 1, count), n), np.repeat(doc, n), np.repeat(bucket, n), np.repeat(hot, n)
            bucket[hot] = buckets + _keys(spans_hash(codes, start[hot], start[hot] + length), buckets)[1]
        end = start + count + length - 1
        name = spans_hash(codes, start, end)
        order = np.lexsort((ids[doc], name, bucket))
        start, count, doc, bucket, end, name = start[order], count[order], doc[order], bucket[order], end[order], name[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])
        head = np.flatnonzero(new)  # the piece of the smallest document
        rows = [(-1, _press(doc.astype(np.uint32), start.astype(np.uint32), count.astype(np.uint16), (np.cumsum(new) - 1).astype(np.uint32), ids[doc[head]]))]
        for x in np.split(head, np.flatnonzero(np.diff(bucket[head])) + 1):
            sizes = end[x] - start[x]
            rows.append((int(bucket[x[0]]), _press(sizes.astype(np.uint16), ids[doc[x]], codes[_spread(start[x], sizes)])))
        return _rows(stored.column("chunk")[0].as_py(), rows)

    return send


def _distinct(rows: pa.ChunkedArray):
    """Pieces of all rows: sizes, owners, bytes and ends; those that differ, each of its smallest owner, by hash; and which of these each is."""
    blobs = [_unpress(x.as_py(), np.uint16, np.int64, np.uint8) for x in rows]
    size = np.concatenate([x[0] for x in blobs]).astype(np.int64)
    first = np.concatenate([x[1] for x in blobs])
    body = np.concatenate([x[2] for x in blobs])
    ends = np.cumsum(size)
    name = spans_hash(body, ends - size, ends)
    order = np.lexsort((first, name))
    new = np.ones(len(order), bool)
    new[1:] = name[order][1:] != name[order][:-1]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return size, first, body, ends, order[new], back, np.cumsum([len(x[0]) for x in blobs])[:-1]


def _least(size, first, body, ends, head, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start in the pieces ``head`` the smallest owner of its string, by the transform, and where each piece begins."""
    long = size[head] + 1
    # symbols from 1: the bytes that occur, numbered in order; fewer than 256 as UTF-8 never has them all
    symbol = np.cumsum(np.bincount(body, minlength=256) > 0).astype(np.uint8)
    text = np.zeros(long.sum(), np.uint8)
    at = np.cumsum(long) - long
    text[_spread(at, size[head])] = symbol[body[_spread(ends[head] - size[head], size[head])]]
    return keepers(text, np.repeat(first[head], long), np.repeat(at + size[head], long), length), at


def _answered(length: int):
    """Step 4: a bucket's pieces to a mask of starts for each, set where a smaller document has the string. Places pass."""

    def answer(t: pa.Table) -> pa.Table:
        t = t.select(["chunk", "bucket", "data"])
        if t.column("bucket")[0].as_py() < 0:
            return t
        size, first, body, ends, head, back, cut = _distinct(t.column("data"))
        least, at = _least(size, first, body, ends, head, length)
        mask = np.zeros(len(size), _U)
        starts = size - length + 1
        for k in range(int(starts.max())):
            rows = np.flatnonzero(starts > k)
            mask[rows] |= (least[at[back[rows]] + k] < first[rows]).astype(_U) << _U(k)
        data = [_press(x) for x in np.split(mask, cut)]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "data": pa.array(data, pa.binary())})

    return answer


_HOT = "chunk bigint, bucket int, data binary, lot bigint"


def _met(t: pa.Table) -> pa.Table:
    """Step 4, hot strings of one bucket in a lot of chunks: the different ones in one row, each with its smallest owner."""
    size, first, body, ends, head, _, _ = _distinct(t.column("data"))
    data = _press(size[head].astype(np.uint16), first[head], body[_spread(ends[head] - size[head], size[head])])
    return pa.table({"chunk": pa.array([-1], pa.int64()), "bucket": t.column("bucket").slice(0, 1), "data": pa.array([data], pa.binary()), "lot": t.column("lot").slice(0, 1)})


def _settled(length: int):
    """Step 4, what the lots of a bucket found: for each string of each lot its smallest owner among all."""

    def settle(t: pa.Table) -> pa.Table:
        size, first, body, ends, head, back, cut = _distinct(t.column("data"))
        least, at = _least(size, first, body, ends, head, length)
        data = [_press(x) for x in np.split(least[at[back]], cut)]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "data": pa.array(data, pa.binary()), "lot": t.column("lot")})

    return settle


def _handed(asked: pa.Table, found: pa.Table) -> pa.Table:
    """Step 4, lots of a group and what was settled for the group's different strings: for each string of each lot its smallest owner."""
    _, _, _, _, _, back, cut = _distinct(asked.column("data"))
    (least,) = _unpress(found.column("data")[0].as_py(), np.int64)
    data = [_press(x) for x in np.split(least[back], cut)]
    return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "data": pa.array(data, pa.binary()), "lot": asked.column("lot")})


def _owners(met: DataFrame, lots: int, length: int) -> DataFrame:
    """Step 4, the rows of ``_met`` with the smallest owner among all lots of each string: in a tree, so that at most
    ``LOTS_AT_ONCE`` lots of a bucket come together, however many there are."""
    if lots <= LOTS_AT_ONCE:
        return met.groupBy("bucket").applyInArrow(_settled(length), _HOT)
    grouped = met.withColumn("up", F.expr(f"lot DIV {LOTS_AT_ONCE}"))
    above = grouped.select("chunk", "bucket", "data", F.col("up").alias("lot")).groupBy("bucket", "lot").applyInArrow(_met, _HOT)
    above = _owners(above, -(-lots // LOTS_AT_ONCE), length)
    return grouped.groupBy("bucket", "up").cogroup(above.groupBy("bucket", "lot")).applyInArrow(_handed, _HOT)


def _returned(asked: pa.Table, found: pa.Table) -> pa.Table:
    """Step 4, hot strings of a lot and their smallest owners: masks as from ``_answered``, of one start each."""
    if not asked.num_rows:
        return _rows(0, [])
    _, first, _, _, _, back, cut = _distinct(asked.column("data"))
    (least,) = _unpress(found.column("data")[0].as_py(), np.int64)  # in the order of the lot's different strings
    data = [_press(x) for x in np.split((least[back] < first).astype(_U), cut)]
    return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "data": pa.array(data, pa.binary())})


_OUT = "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"


def _removed(length: int):
    """Step 5: a chunk's texts, places and masks to the removed ranges and the rest of each document."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def remove(stored: pa.Table, told: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in ("doc_id x", "n_bytes x", "spans x", "kept x")]
        if not stored.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind), pa.array([], pa.binary())], names)
        ids, named, at, codes = _unpress(stored.column("data")[0].as_py(), *_TEXTS)
        gone = np.zeros(len(codes) + 1, bool)
        rows = sorted((b.as_py(), i) for i, b in enumerate(told.column("bucket")))
        if rows:
            data = told.column("data")
            doc, start, count, piece, first = _unpress(data[rows[0][1]].as_py(), np.uint32, np.uint32, np.uint16, np.uint32, np.int64)
            mask = np.concatenate([_unpress(data[i].as_py(), _U)[0] for _, i in rows[1:]])
            own = np.where(ids[doc] > first[piece], ~_U(0), mask[piece])
            hit = np.zeros(len(codes) + 1, np.int64)
            start = start.astype(np.int64)
            for k in range(int(count.max())):
                hit[start[(count > k) & ((own >> _U(k)) & _U(1) == 1)] + k] = 1
            total = np.cumsum(hit)
            gone = total > 0
            gone[length:] = total[length:] > total[:-length]
            gone[-1] = False
        inside = gone[:-1]
        turn = np.diff(inside.astype(np.int8), prepend=0)
        cut = at[(at > 0) & (at < len(codes))]
        begin = np.zeros(len(codes) + 1, bool)
        begin[:-1] = turn == 1
        begin[cut] |= inside[cut]  # a range that goes on in the next document begins anew
        last = np.zeros(len(codes) + 1, bool)
        last[1:][np.flatnonzero(inside & ~np.append(inside[1:], False))] = True
        last[cut] |= inside[cut - 1]
        begin, end = np.flatnonzero(begin[: len(codes)]), np.flatnonzero(last)
        owner = np.searchsorted(at, begin, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begin - at[owner]), pa.array(end - at[owner])], ["begin", "end"])
        per = np.searchsorted(begin, at)
        per[-1] = len(begin)
        rest = codes[~inside].tobytes()
        left = np.concatenate([[0], np.cumsum(~inside)])[at].tolist()
        return pa.table(
            [
                pa.array(ids, pa.int64(), mask=~named),
                pa.array(np.diff(at)),
                pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), spans),
                pa.array([rest[a:b] for a, b in zip(left[:-1], left[1:])], pa.binary()),
            ],
            names,
        )

    return remove


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every row: the removed byte ranges ``[begin, end)`` and the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller id. Texts are taken as UTF-8, null as empty; strings do
    not cross documents and are judged on the input. Rows that share an id do not
    remove each other's strings, even if they are equal. A row without id neither
    loses nor takes anything. ``length`` is 8 to 100.
    """
    if not 8 <= length <= 100:
        raise ValueError("length must be 8 to 100")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(1, -(-total // BUCKET_BYTES)))
    parts = min(-(-total // PARTITION_BYTES), MOST_PARTITIONS)

    def by(df: DataFrame, *keys: str) -> DataFrame:
        """``df`` dealt by ``keys``, to more partitions than the session's where these would be too large."""
        return df.repartition(int(parts), *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df

    stored = checkpointed(rows.mapInArrow(_stored, _ROW))
    held = by(stored, "chunk").groupBy("chunk")
    most = HOT_UNITS

    def compared(t: pa.Table) -> pa.Table:
        return _compared(t, most)

    bits = checkpointed(by(stored.mapInArrow(_named(buckets, length), _ROW), "bucket").groupBy("bucket").applyInArrow(compared, _BITS))
    hot = bits.where("hot").limit(1).count() > 0
    sent = held.cogroup(by(bits.drop("hot"), "chunk").groupBy("chunk")).applyInArrow(_sent(buckets, length), _ROW)
    sent = checkpointed(sent) if hot else sent
    # pieces go to their bucket, places to a slot of their own, in one exchange
    slot = F.when(F.col("bucket") < 0, -1 - F.col("chunk")).otherwise(F.col("bucket").cast("long"))
    told = by(sent.where(F.col("bucket") < buckets).withColumn("slot", slot), "slot").groupBy("slot").applyInArrow(_answered(length), _ROW)
    if hot:
        lots = max(1, -(-total // (CHUNK_BYTES * FAN_IN)))
        single = sent.where(F.col("bucket") >= buckets).withColumn("lot", F.pmod(F.xxhash64("chunk"), F.lit(lots)))
        lot = single.groupBy("bucket", "lot")
        owners = _owners(lot.applyInArrow(_met, _HOT), lots, length)
        told = told.unionByName(lot.cogroup(owners.groupBy("bucket", "lot")).applyInArrow(_returned, _ROW))
    return held.cogroup(by(told, "chunk").groupBy("chunk")).applyInArrow(_removed(length), _OUT)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
