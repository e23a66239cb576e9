"""Large matrices as tiles, and arrays that are added up.

A tile table has a row for each square of a matrix: ``(op_id, bi, bj, re array, im array)``, row by row, those at the
edges smaller. Batch items are cut into panels: the same columns of many items, side by side in one
array. Panels and tiles meet on the tile column, a pair is one NumPy product, and partial
products are added up where they arise and once more by panel. So rows are counted in tiles and panels, never in elements,
and a task holds one pair, its open sums, or one panel.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import leaves as L
from ..operators import nodes as N
from ..operators.base import OperatorError
from .types import is_complex

#: Rows and columns of a tile.
TILE = 512
#: Bytes of a panel's arrays over the whole axis, and of the sums that a task keeps open, at most; fibres in a panel at most.
PANEL_BYTES, OPEN_BYTES, FIBRES = 16 << 20, 64 << 20, 1024
#: Tiles of one column that a row of panels meets at once.
TILES_AT_ONCE = 16

_TILE = "op_id string, bi int, bj int, re array<double>, im array<double>"


def tile_size(tiles: DataFrame) -> int:
    """Rows and columns of a whole tile, which the table keeps beside its column ``bi``."""
    return tiles.schema["bi"].metadata["tile"]


def is_tiled(params: DataFrame) -> bool:
    return "bi" in params.columns


def _marked(tiles: DataFrame, tile: int) -> DataFrame:
    return tiles.select("op_id", F.col("bi").alias("bi", metadata={"tile": tile}), "bj", "re", "im")


def _grid(spark: SparkSession, leaf: L.Matrix, tile: int) -> DataFrame:
    """``(bi, bj, h, w)`` of each tile."""
    down, across = -(-leaf.m // tile), -(-leaf.n // tile)
    at = spark.range(0, down * across, 1, max(1, min(down * across, 1 << 14)))
    at = at.select(F.expr(f"CAST(id DIV {max(across, 1)} AS INT)").alias("bi"), F.expr(f"CAST(id % {max(across, 1)} AS INT)").alias("bj"))
    return at.select("bi", "bj", F.least(F.lit(tile), F.lit(leaf.m) - F.col("bi") * tile).alias("h"), F.least(F.lit(tile), F.lit(leaf.n) - F.col("bj") * tile).alias("w"))


def generated_tiles(spark: SparkSession, leaf: L.Matrix, re, im=None, tile: int = TILE) -> DataFrame:
    """The parameter of a matrix from column functions of ``(i, j)``, tile by tile, made on the executors."""
    cells = lambda f: F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda k: f(F.col("bi") * tile + F.floor(k / F.col("w")).cast("int"), F.col("bj") * tile + k % F.col("w")).cast("double"))
    values = [cells(f) if f else F.array_repeat(F.lit(0.0), F.col("h") * F.col("w")) for f in (re, im)] if is_complex(leaf.dtype) else [cells(re), F.lit(None).cast("array<double>")]
    out = _grid(spark, leaf, tile).select(F.lit(leaf.op_id).alias("op_id"), "bi", "bj", values[0].alias("re"), values[1].alias("im"))
    return _marked(out, tile)


def tiled(params: DataFrame, leaf: L.Matrix, tile: int = TILE) -> DataFrame:
    """A matrix from a table of elements ``(op_id, i, j, re, im)`` as tiles; elements that lack are zero. Shuffles the elements once."""
    both = is_complex(leaf.dtype)
    cell = F.struct(((F.col("i") % tile) * F.least(F.lit(tile), F.lit(leaf.n) - F.floor(F.col("j") / tile) * tile) + F.col("j") % tile).cast("int").alias("at"), "re", "im")
    rows = params.where(F.col("op_id") == leaf.op_id).groupBy(F.floor(F.col("i") / tile).cast("int").alias("ti"), F.floor(F.col("j") / tile).cast("int").alias("tj")).agg(F.collect_list(cell).alias("cells"))
    grid = _grid(params.sparkSession, leaf, tile)
    rows = grid.join(rows, (F.col("bi") == F.col("ti")) & (F.col("bj") == F.col("tj")), "left").select("bi", "bj", (F.col("h") * F.col("w")).alias("size"), "cells")

    def fill(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a row is a tile
                one = batch.slice(k, 1)
                size, cells = one.column("size")[0].as_py(), one.column("cells").flatten()
                at = cells.field("at").to_numpy(zero_copy_only=False)
                out = []
                for part in ("re", "im") if both else ("re",):
                    values = np.zeros(size)
                    values[at] = cells.field(part).to_numpy(zero_copy_only=False)
                    out.append(_lists(values[None]))
                yield pa.RecordBatch.from_arrays([pa.array([leaf.op_id]), one.column("bi"), one.column("bj"), out[0], out[1] if both else pa.nulls(1, pa.list_(pa.float64()))], ["op_id", "bi", "bj", "re", "im"])

    return _marked(rows.mapInArrow(fill, _TILE), tile)


def elements(tiles: DataFrame, leaf: L.Matrix) -> DataFrame:
    """A tiled matrix as elements ``(i, j, re, im)``."""
    t = tile_size(tiles)
    pairs = F.posexplode(F.arrays_zip(F.col("re"), F.coalesce("im", F.transform("re", lambda _: F.lit(0.0))).alias("im"))).alias("k", "v")
    width = F.least(F.lit(t), F.lit(leaf.n) - F.col("bj") * t)
    rows = tiles.where(F.col("op_id") == leaf.op_id).select("bi", "bj", width.alias("w"), pairs)
    return rows.select((F.col("bi") * t + F.floor(F.col("k") / F.col("w"))).cast("int").alias("i"), (F.col("bj") * t + F.col("k") % F.col("w")).cast("int").alias("j"), F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def _lists(values: np.ndarray, mask: np.ndarray | None = None) -> pa.ListArray:
    """Rows of a matrix as a column of arrays."""
    ends = np.arange(len(values) + 1) * values.shape[1] if mask is None else np.concatenate([[0], np.cumsum(~mask * values.shape[1])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(values if mask is None else values[~mask]).ravel(), pa.float64()), mask=None if mask is None else pa.array(mask))


def _arrays(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray | None]:
    """The array of each row, without a copy."""
    c = batch.column(column)
    values, ends, valid = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy(), c.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(c)):
        yield values[ends[k] : ends[k + 1]] if valid[k] else None


def _complex(re: Iterator, im: Iterator) -> Iterator[np.ndarray | None]:
    for a, b in zip(re, im):
        yield a if b is None or a is None else a + 1j * b


def product(op: N.Bound, df: DataFrame, adjoint: bool, lead: int = 1, trail: int = 1) -> DataFrame:
    """A matrix, or its adjoint, along the middle axis of DENSE items of ``lead`` x n x ``trail`` elements. A null array stays null.

    The matrix comes as tiles, or as elements that are tiled first. Items are read once; their panels and the
    tiles are shuffled, tiles as often as there are shares of panels to a tile column.
    """
    leaf = op.op
    spark, wide = df.sparkSession, is_complex(leaf.dtype)
    tiles = op.params if is_tiled(op.params) else tiled(op.params, leaf)
    t, (n, m) = tile_size(tiles), (leaf.m, leaf.n) if adjoint else (leaf.n, leaf.m)
    if not n or not m:
        raise OperatorError("a tiled matrix has rows and columns")
    tiles = tiles.where(F.col("op_id") == leaf.op_id)
    keys = [c for c in df.columns if c not in ("re", "im")]
    per_item = lead * trail
    group = max(1, min(FIBRES, PANEL_BYTES // (8 * max(n, m))) // per_item)  # items in a panel

    def cut(batches):
        """Panels of a task's items: a row for each tile column, the keys of the items with the first."""
        panel, held, size = TaskContext.get().partitionId() << 33, [], 0

        def out():
            rows = pa.Table.from_batches(held).combine_chunks()
            whole = np.logical_and.reduce([rows.column(c).combine_chunks().is_valid().to_numpy(zero_copy_only=False) for c in (["re", "im"] if wide else ["re"])])
            x = np.zeros((len(rows), lead * n * trail), complex if wide else float)
            for k, v in enumerate(_complex(_arrays(flat := rows.to_batches()[0], "re"), _arrays(flat, "im") if wide else iter([None] * len(rows)))):
                if whole[k]:
                    if len(v) != x.shape[1]:
                        raise OperatorError(f"a row has {len(v)} elements where the operator takes {x.shape[1]}")
                    x[k] = v
            if any(rows.column(c).combine_chunks().flatten().null_count for c in (["re", "im"] if wide else ["re"])):
                raise OperatorError("a value is null")
            x = x.reshape(len(rows) * lead, n, trail)
            head = rows.select(keys).append_column("whole_", pa.array(whole))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_table(head)
            fibres = x.shape[0] * trail
            for b in range(-(-n // t)):
                part = x[:, b * t : (b + 1) * t].transpose(1, 0, 2).reshape(1, -1)
                yield pa.RecordBatch.from_arrays([pa.array([panel], pa.int64()), pa.array([b], pa.int32()), pa.array([fibres], pa.int32()), pa.array([sink.getvalue().to_pybytes() if b == 0 else None], pa.binary()), _lists(part.real), _lists(part.imag) if wide else pa.nulls(1, pa.list_(pa.float64()))], ["panel", "b", "fibres", "head", "x_re", "x_im"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(group - size, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, size = at + take, size + take
                if size == group:
                    yield from out()
                    panel, held, size = panel + 1, [], 0
        if size:
            yield from out()

    panels = df.select(*[F.col(f"`{k}`") for k in keys], "re", *(["im"] if wide else [])).mapInArrow(cut, "panel bigint, b int, fibres int, head binary, x_re array<double>, x_im array<double>")
    on, to = ("bi", "bj") if adjoint else ("bj", "bi")
    columns = -(-n // t)
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // columns)
    stripes = -(-(-(-m // t)) // TILES_AT_ONCE)
    left = panels.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("share", F.pmod(F.xxhash64("panel"), F.lit(shares)))
    right = tiles.select(F.col(on).alias("t_b"), F.col(to).alias("t_to"), F.expr(f"{to} DIV {TILES_AT_ONCE}").alias("t_stripe"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("t_share"), F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    pairs = left.join(right, (F.col("b") == F.col("t_b")) & (F.col("stripe") == F.col("t_stripe")) & (F.col("share") == F.col("t_share")), "left")
    pairs = pairs.select("panel", F.coalesce("t_to", F.col("stripe") * TILES_AT_ONCE).alias("to"), "fibres", "head", "x_re", "x_im", "w_re", "w_im")

    def multiply(batches):
        """Products of pairs, added up by panel and tile row as long as they fit."""
        open_: dict[tuple[int, int], list] = {}
        size = 0

        def out():
            for (panel, to), (head, y) in open_.items():
                y = y.reshape(1, -1)
                yield pa.RecordBatch.from_arrays([pa.array([panel], pa.int64()), pa.array([to], pa.int32()), pa.array([head], pa.binary()), _lists(y.real), _lists(y.imag) if wide else pa.nulls(1, pa.list_(pa.float64()))], ["panel", "to", "head", "re", "im"])

        for batch in batches:
            xs, ws = _complex(_arrays(batch, "x_re"), _arrays(batch, "x_im")), _complex(_arrays(batch, "w_re"), _arrays(batch, "w_im"))
            for panel, to, fibres, head, x, w in zip(batch.column("panel").to_pylist(), batch.column("to").to_pylist(), batch.column("fibres").to_pylist(), batch.column("head"), xs, ws):
                x, h = x.reshape(-1, fibres), min(t, m - to * t)
                if w is None:
                    y = np.zeros((h, fibres), x.dtype)
                else:
                    y = (w.reshape(-1, h).conj().T if adjoint else w.reshape(h, -1)) @ x
                if (panel, to) not in open_:
                    open_[panel, to] = [None, y]
                    size += y.nbytes
                else:
                    open_[panel, to][1] = open_[panel, to][1] + y
                if head.is_valid:
                    open_[panel, to][0] = head.as_py()
                if size >= OPEN_BYTES:
                    yield from out()
                    open_, size = {}, 0
        yield from out()

    parts = pairs.mapInArrow(multiply, "panel bigint, to int, head binary, re array<double>, im array<double>").repartition("panel").sortWithinPartitions("panel")

    def gather(batches):
        """A panel's sums put together, and its items taken apart."""
        now, head, y = None, None, None

        def out():
            rows = pa.ipc.open_stream(head).read_all().combine_chunks()
            whole = rows.column("whole_").combine_chunks().to_numpy(zero_copy_only=False)
            items = y.reshape(m, len(rows), lead, trail).transpose(1, 2, 0, 3).reshape(len(rows), -1)
            columns = [rows.column(k).combine_chunks() for k in keys]
            kinds = [items.real, items.imag] if wide else [items.real]
            yield pa.RecordBatch.from_arrays([*columns, *[_lists(v, None if whole.all() else ~whole) for v in kinds]], [*keys, "re", *(["im"] if wide else [])])

        for batch in batches:
            for panel, to, first, part in zip(batch.column("panel").to_pylist(), batch.column("to").to_pylist(), batch.column("head"), _complex(_arrays(batch, "re"), _arrays(batch, "im"))):
                if panel != now:
                    if now is not None:
                        yield from out()
                    now, head, y = panel, None, None
                h = min(t, m - to * t)
                part = part.reshape(h, -1)
                if y is None:
                    y = np.zeros((m, part.shape[1]), part.dtype)
                y[to * t : to * t + h] += part
                head = first.as_py() if first.is_valid else head
        if now is not None:
            yield from out()

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in (["re", "im"] if wide else ["re"])])
    return parts.mapInArrow(gather, schema)


def summed(df: DataFrame) -> DataFrame:
    """DENSE rows of equal keys, added up element by element; null arrays add nothing, and only they give a null one.

    Arrays are added within a task first, so a key has a row for each task (or ``OPEN_BYTES`` of sums) in the
    shuffle, and its rows are then added one after the other. Arrays of different lengths are an error.
    """
    keys, parts = [c for c in df.columns if c not in ("re", "im")], [c for c in ("re", "im") if c in df.columns]
    kinds = [df.schema[k].dataType for k in keys]

    def rows(open_: dict) -> Iterator[pa.RecordBatch]:
        if open_:
            names = [pa.array([k[c] for k in open_], schema_of[c]) for c in range(len(keys))]
            lists = [pa.array([None if v is None else v[p] for v in open_.values()], pa.list_(pa.float64())) for p in range(len(parts))]
            yield pa.RecordBatch.from_arrays([*names, *lists], [*keys, *parts])

    schema_of: list = []

    def add(batches, ordered: bool):
        open_, size = {}, 0
        for batch in batches:
            schema_of[:] = [batch.column(c).type for c in range(len(keys))]
            names = zip(*[batch.column(c).to_pylist() for c in range(len(keys))]) if keys else iter([()] * batch.num_rows)
            for name, *values in zip(names, *[_arrays(batch, p) for p in parts]):
                if ordered and name not in open_:
                    yield from rows(open_)
                    open_ = {}
                have = open_.get(name)
                if any(v is None for v in values):
                    open_.setdefault(name, None)
                elif have is None:
                    open_[name] = [v.copy() for v in values]
                    size += sum(v.nbytes for v in values)
                else:
                    for a, b in zip(have, values):
                        if len(a) != len(b):
                            raise OperatorError(f"arrays of {len(a)} and {len(b)} elements are added")
                        a += b
                if not ordered and size >= OPEN_BYTES:
                    yield from rows(open_)
                    open_, size = {}, 0
        yield from rows(open_)

    if any(isinstance(k, (T.ArrayType, T.MapType, T.StructType)) for k in kinds):
        raise OperatorError("keys of sums are plain values")
    names = [F.col(f"`{k}`") for k in keys]
    out = df.select(*names, *parts)
    once = out.mapInArrow(lambda b: add(b, False), out.schema)
    met = once.repartition(*names).sortWithinPartitions(*names) if keys else once.repartition(1)  # a row a task
    return met.mapInArrow(lambda b: add(b, True), out.schema)


def parameter_total(op) -> int:
    """Bytes of all bound parameters of a tree, each counted once."""
    leaves = {x.op_id: x for x in op.leaves() if getattr(x, "op_id", None) is not None}
    return sum(N.parameter_bytes(x) for x in leaves.values())


def whole(op) -> bool:
    """Whether all parameters of a tree go to every task together, and nothing in it crosses items."""
    return parameter_total(op) <= N.BROADCAST_BYTES and not any(is_tiled(b.params) for b in bound(op)) and not any(isinstance(x, L.Reduce) for x in op.leaves())


def bound(op) -> list[N.Bound]:
    return [op] if isinstance(op, N.Bound) else [b for c in op.children for b in bound(c)]


def axis_steps(op, lead: int = 1, trail: int = 1):
    """A tree as steps ``(node, lead, trail)`` in the order of application, each along the middle axis of ``lead`` x n x ``trail`` elements.

    Parts whose parameters fit together stay whole.
    """
    if whole(op) or not isinstance(op, (N.Compose, N.Kron, N.Broadcasted, N.Distributed)):
        yield op, lead, trail
    elif isinstance(op, N.Compose):
        for o in reversed(op.ops):
            yield from axis_steps(o, lead, trail)
    elif isinstance(op, N.Kron):
        sizes = [o.domain for o in op.ops]
        for k in op.order:
            yield from axis_steps(op.ops[k], lead * prod(sizes[:k]), trail * prod(sizes[k + 1 :]))
            sizes[k] = op.ops[k].range
    else:
        yield from axis_steps(op.op, lead, trail)


def matrix_of(op) -> tuple[N.Bound, bool] | None:
    """The bound matrix that a step is, and whether its adjoint is meant."""
    adjoint = isinstance(op, N.Adjoint)
    inner = op.op if adjoint else op
    return (inner, adjoint) if isinstance(inner, N.Bound) and isinstance(inner.op, L.Matrix) else None


__all__ = ["TILE", "axis_steps", "bound", "elements", "generated_tiles", "is_tiled", "matrix_of", "parameter_total", "product", "summed", "tile_size", "tiled", "whole"]
