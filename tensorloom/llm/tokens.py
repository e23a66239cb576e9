"""Token ids packed into fixed-length rows: best-fit-decreasing with a segment tree over capacities.

Texts are encoded by a public vocabulary, overlong documents are split without
loss, and the segments are packed into rows of ``length`` ids. A row carries the
cumulative segment lengths and the position of each id within its segment.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Vocabulary file and the split pattern that belongs to it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids in a row; id of the padding; ids that are packed together.
LENGTH, PAD, WINDOW_IDS = 2048, 50256, 1 << 21

_PACKED = "row_id bigint, n_ids int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<bigint>, doc_offsets array<bigint>"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


#: Characters that a text is encoded by at once, about; blank runs of this length are encoded apart.
CUT, LONG_BLANKS = 1 << 20, 1 << 10
#: White space as the split pattern's engine knows it.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD_END, _RUN = re.compile(f"(?<=[^{_BLANK}])[{_BLANK}]"), re.compile(f"[{_BLANK}]{{{LONG_BLANKS},}}")
_TWO = re.compile(f"[{_BLANK}]{{2}}")


def _has_run(text: str) -> bool:
    """Whether ``text`` may have a long run of blanks: such a run holds two neighbours of every ``LONG_BLANKS / 2``-th character."""
    step = LONG_BLANKS // 2
    return _TWO.search(text[step - 1 :: step]) is not None


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """``text`` in parts that ``PATTERN`` never reaches across, and whether a part is one match, for which no engine is needed.

    No match goes on from another character into blanks, so a part may end where blanks begin. A run of
    blanks is one match, up to its last blank if more text follows: that one belongs to what comes.
    """
    at, runs = 0, _has_run(text)
    while at < len(text):
        cut = _WORD_END.search(text, at + CUT)
        end = cut.start() if cut else len(text)
        for run in _RUN.finditer(text, at, end) if runs else ():
            stop = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > at:
                yield text[at : run.start()], False
            yield text[run.start() : stop], True
            at = stop
        if end > at:
            yield text[at:end], False
        at = end


def token_ids(encoding, text: str, pattern: str = PATTERN) -> np.ndarray:
    """The ids of ``text``, as the encoding gives them for the whole of it. The engine of the split pattern keeps a frame
    for each blank of a run and has no room for some hundred thousand, so it gets neither long runs nor very long texts."""
    if pattern != PATTERN:  # where other patterns may be cut is not known; their splits are found by another engine
        long_run = _RUN.search(text) is not None
        return np.array(encoding._encode_only_native_bpe(text) if long_run else encoding.encode_ordinary(text), np.int32)
    ids = [np.array(encoding._encode_single_piece(part) if whole else encoding.encode_ordinary(part), np.int32) for part, whole in _parts(text)]
    return np.concatenate(ids) if ids else np.zeros(0, np.int32)


class Capacities:
    """Open rows by remaining capacity, under a segment tree that counts them; finds the least capacity that suffices."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.rows[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        node, count = capacity + self.width, self.count
        while node:
            count[node] += by
            node >>= 1

    def least(self, need: int) -> int:
        """The smallest capacity of an open row that is ``need`` or more; -1 if there is none."""
        count, node = self.count, need + self.width
        if count[node]:
            return need
        while node > 1:  # up to the first subtree on the right with rows
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.width:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.width


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` in each row, longest first; equal sizes in the given order."""
    open_, rows = Capacities(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = open_.least(sizes[i])
        if at < 0:
            rows.append([i])
            row, at = len(rows) - 1, capacity
        else:
            row = open_.take(at)
            rows[row].append(i)
        if at > sizes[i]:
            open_.add(at - sizes[i], row)
    return rows


def _packed(segments: list[tuple[int | None, int, np.ndarray]], first: int, length: int, pad: int):
    """Batches of rows from segments ``(doc_id, offset, ids)``."""
    rows = best_fit_decreasing([len(s[2]) for s in segments], length)
    for a in range(0, len(rows), 512):
        part = rows[a : a + 512]
        ids = np.full((len(part), length), pad, np.int32)
        positions = np.zeros((len(part), length), np.int32)
        ends = []
        for k, members in enumerate(part):
            at, cu = 0, [0]
            for i in members:
                n = len(segments[i][2])
                ids[k, at : at + n] = segments[i][2]
                positions[k, at : at + n] = np.arange(n)
                at += n
                cu.append(at)
            ends.append(cu)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(first + a, first + a + len(part)), pa.int64()),
                pa.array([x[-1] for x in ends], pa.int32()),
                pa.array([x.astype("<i4").tobytes() for x in ids], pa.binary()),
                pa.array([x.astype("<i4").tobytes() for x in positions], pa.binary()),
                pa.array(ends, pa.list_(pa.int32())),
                pa.array([[segments[i][0] for i in m] for m in part], pa.list_(pa.int64())),
                pa.array([[segments[i][1] for i in m] for m in part], pa.list_(pa.int64())),
            ],
            [c.split()[0] for c in _PACKED.split(", ")],
        )


def pack_tokens(docs: DataFrame, length: int = LENGTH, pad: int = PAD, vocabulary: str = VOCABULARY, pattern: str = PATTERN, window: int = WINDOW_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a packed row: ``row_id``, ``n_ids``, little-endian int32 ``ids`` (padded) and ``positions`` (from 0 in
    each segment), ``cu_seqlens``, and for each segment its document and the offset of its first id there.

    Every id of every text is in one row. A document of more than ``length`` ids is
    cut at multiples of it. Null and empty texts have no ids and are in no row; a
    null id stays null in ``doc_ids``; rows that repeat are packed as often as they
    stand. Runs of blanks, letters or signs of any length have the ids of the whole text; bytes that are not UTF-8
    become replacement characters. Each task packs its own documents, some ``window`` ids at a time, so
    nothing is shuffled and memory does not grow with the input; rows are
    numbered by task and place, alike for the same files and split sizes.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # one vocabulary file

    def pack(batches):
        encoding = _encoding(ranks.value, pattern)
        made, segments, held = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                t = t.as_py()
                if not t:
                    continue
                d = d.as_py()
                ids = token_ids(encoding, t.decode("utf-8", "replace"), pattern)
                for a in range(0, len(ids), length):
                    segments.append((d, a, ids[a : a + length]))
                held += len(ids)
                if held >= window:
                    for out in _packed(segments, made, length, pad):
                        made += out.num_rows
                        yield out
                    segments, held = [], 0
        for out in _packed(segments, made, length, pad):
            made += out.num_rows
            yield out

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(pack, _PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows to ``path``: one Parquet part a task, with ids and positions as binary."""
    packed.write.parquet(path)


def matrix(ids: list[bytes]) -> np.ndarray:
    """Rows of ids read back as one matrix."""
    return np.frombuffer(b"".join(ids), "<i4").reshape(len(ids), -1) if ids else np.zeros((0, 0), np.int32)


def op3_token_pack(spark, sf_dir: str) -> DataFrame:
    packed = pack_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("row_id", "n_ids", F.size("doc_ids").alias("n_segments"), "doc_ids", "doc_offsets", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.crc32("positions").alias("positions_crc32"))
