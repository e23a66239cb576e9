"""Items in blocks: ``(keys..., rank, re array[, im array])``, one row for each block of an array on a grid of workers.

A block's array has its first axis fastest, as the whole item has. A move between grids cuts each block where
blocks of the other grid begin, and sends one row for each pair of overlapping blocks; the pieces of a block are put
together as they arrive. No item is ever whole, and no element has a row.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.base import OperatorError
from ..operators.leaves import Repartition
from .grid import grid_block, range_axes


def _values(df: DataFrame) -> list[str]:
    return [c for c in ("re", "im") if c in df.columns]


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("rank", "re", "im")]


def _schema(df: DataFrame, *more: T.StructField) -> T.StructType:
    """Keys of ``df``, ``more`` columns and its arrays."""
    return T.StructType([df.schema[k] for k in _keys(df)] + list(more) + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in _values(df)])


_RANK = T.StructField("rank", T.IntegerType())


def _rows(batch: pa.RecordBatch, values: list[str]):
    """For each row its arrays, stacked; None if one is null."""
    columns = [batch.column(c) for c in values]
    flat = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy(), c.is_valid().to_numpy(zero_copy_only=False)) for c in columns]
    for k in range(batch.num_rows):
        yield np.stack([v[e[k] : e[k + 1]] for v, e, _ in flat]) if all(ok[k] for _, _, ok in flat) else None


def _cells(x: np.ndarray, shape) -> np.ndarray:
    """The arrays of a row as arrays of ``shape``, last axis first."""
    if x.shape[1] != prod(shape):
        raise OperatorError(f"a row has {x.shape[1]} elements where a block has {prod(shape)}")
    return x.reshape(len(x), *shape[::-1])


def _batch(keys: list[tuple], kinds, names: list[str], more: list[pa.Array], arrays: list, n: int) -> pa.RecordBatch:
    columns = [pa.array([k[c] for k in keys], kinds[c]) for c in range(len(kinds))]
    lists = [pa.array([None if a is None else np.ascontiguousarray(a[p]).ravel() for a in arrays], pa.list_(pa.float64())) for p in range(n)]
    return pa.RecordBatch.from_arrays([*columns, *more, *lists], names)


def chunked(df: DataFrame, shape: tuple[int, ...], grid: tuple[int, ...]) -> DataFrame:
    """DENSE items of ``shape`` as blocks on ``grid``. A null array has null blocks."""
    if len(shape) != len(grid):
        raise OperatorError("shape and grid must have the same number of axes")
    keys, values, blocks = _keys(df), _values(df), [grid_block(shape, grid, r) for r in range(prod(grid))]
    schema = _schema(df, _RANK)

    def cut(batches):
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            names = list(zip(*[batch.column(k).to_pylist() for k in keys])) or [()] * batch.num_rows
            for name, x in zip(names, _rows(batch, values)):
                whole = None if x is None else _cells(x, shape)
                parts = [None if whole is None else whole[(slice(None), *(slice(a, b) for a, b in block[::-1]))] for block in blocks]
                yield _batch([name] * len(blocks), kinds, schema.names, [pa.array(range(len(blocks)), pa.int32())], parts, len(values))

    return df.select(*[F.col(f"`{k}`") for k in keys], *values).mapInArrow(cut, schema)


@lru_cache(maxsize=64)
def _overlaps(shape: tuple[int, ...], source: tuple[int, ...], target: tuple[int, ...], rank: int) -> tuple:
    """Of a block of the grid ``source``: each block of ``target`` that it meets, as ``(rank, range in the whole array)``."""
    axes = []
    for (a, b), ends in zip(grid_block(shape, source, rank), range_axes(target, shape)):
        axes.append([(k, max(a, c), min(b, d)) for k, (c, d) in enumerate(ends) if max(a, c) < min(b, d)])
    out = []
    for cells in product(*axes):
        to = 0
        for (k, _, _), p in zip(cells, target):
            to = to * p + k
        out.append((to, tuple((a, b) for _, a, b in cells)))
    return tuple(out)


def pieces(op: Repartition, blocks: DataFrame) -> DataFrame:
    """What a move sends: ``(keys..., rank, at, size, arrays)``, a piece for each pair of overlapping blocks, ``rank`` where it goes
    and ``at`` where it begins in the whole array."""
    keys, values, shape = _keys(blocks), _values(blocks), op.shape
    list_ = T.ArrayType(T.IntegerType())
    schema = _schema(blocks, _RANK, T.StructField("at", list_), T.StructField("size", list_))

    def cut(batches):
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            names = list(zip(*[batch.column(k).to_pylist() for k in keys])) or [()] * batch.num_rows
            for name, rank, x in zip(names, batch.column("rank").to_pylist(), _rows(batch, values)):
                here = grid_block(shape, op.grid_in, rank)
                block = None if x is None else _cells(x, [b - a for a, b in here])
                found = _overlaps(shape, op.grid_in, op.grid_out, rank)
                if not found:
                    continue
                parts = [None if block is None else block[(slice(None), *(slice(a - lo, b - lo) for (a, b), (lo, _) in zip(cells[::-1], here[::-1])))] for _, cells in found]
                at, size = ([[f(c) for c in cells] for _, cells in found] for f in (lambda c: c[0], lambda c: c[1] - c[0]))
                more = [pa.array([to for to, _ in found], pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(size, pa.list_(pa.int32()))]
                yield _batch([name] * len(found), kinds, schema.names, more, parts, len(values))

    return blocks.mapInArrow(cut, schema)


def moved_blocks(op: Repartition, blocks: DataFrame) -> DataFrame:
    """Blocks on the grid ``op.grid_in`` as blocks on ``op.grid_out``. A block of which a piece is null is null."""
    keys, values, shape = _keys(blocks), _values(blocks), op.shape
    schema = _schema(blocks, _RANK)
    where = [*[F.col(f"`{k}`") for k in keys], F.col("rank")]
    met = pieces(op, blocks).repartition(*where).sortWithinPartitions(*where)

    def join(batches):
        now, here, out, kinds = None, None, None, None
        done = lambda: _batch([now[:-1]], kinds, schema.names, [pa.array([now[-1]], pa.int32())], [out], len(values))
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            names = zip(*[batch.column(k).to_pylist() for k in (*keys, "rank")])
            for name, at, size, x in zip(names, batch.column("at").to_pylist(), batch.column("size").to_pylist(), _rows(batch, values)):
                if name != now:
                    if now is not None:
                        yield done()
                    now, here = name, grid_block(shape, op.grid_out, name[-1])
                    out = np.zeros((len(values), *[b - a for a, b in here][::-1]))
                if x is None or out is None:
                    out = None
                else:
                    out[(slice(None), *(slice(a - lo, a - lo + n) for a, n, (lo, _) in zip(at[::-1], size[::-1], here[::-1])))] = _cells(x, size)
        if now is not None:
            yield done()

    return met.mapInArrow(join, schema)


def whole_items(blocks: DataFrame, shape: tuple[int, ...], grid: tuple[int, ...]) -> DataFrame:
    """Blocks as DENSE items again."""
    return moved_blocks(Repartition(tuple(shape), tuple(grid), (1,) * len(shape)), blocks).drop("rank")


def rotated_blocks(blocks: DataFrame, shape: tuple[int, ...], grid: tuple[int, ...], by: int) -> tuple[DataFrame, tuple[int, ...], tuple[int, ...]]:
    """Axes turned cyclically, those of the grid too, so each block stays where it is: axis ``by`` becomes the first. Also the new shape and grid."""
    n, keys, values = len(shape), _keys(blocks), _values(blocks)
    turn = [(k + by) % n for k in range(n)]
    shape_out, grid_out = tuple(shape[k] for k in turn), tuple(grid[k] for k in turn)
    schema = _schema(blocks, _RANK)
    numbers = {}
    for rank, at in enumerate(product(*map(range, grid))):  # the rank of the same block on the turned grid
        to = 0
        for k in turn:
            to = to * grid[k] + at[k]
        numbers[rank] = to

    def turned(batches):
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            names = list(zip(*[batch.column(k).to_pylist() for k in keys])) or [()] * batch.num_rows
            ranks, out = batch.column("rank").to_pylist(), []
            for rank, x in zip(ranks, _rows(batch, values)):
                if x is not None:
                    cells = _cells(x, [b - a for a, b in grid_block(shape, grid, rank)])
                    x = cells.transpose(0, *[n - turn[n - 1 - k] for k in range(n)])
                out.append(x)
            yield _batch(names, kinds, schema.names, [pa.array([numbers[r] for r in ranks], pa.int32())], out, len(values))

    return blocks.mapInArrow(turned, schema), shape_out, grid_out


def matrix_blocks(blocks: DataFrame, shape: tuple[int, ...], grid: tuple[int, ...]) -> tuple[DataFrame, tuple[int, ...], tuple[int, ...]]:
    """All axes but the first as one: blocks that part these axes are moved together, and the arrays stay as they are. Also the new shape and grid."""
    if any(p != 1 for p in grid[1:]):
        blocks = moved_blocks(Repartition(tuple(shape), tuple(grid), (grid[0], *[1] * (len(shape) - 1))), blocks)
    return blocks, (shape[0], prod(shape[1:])), (grid[0], 1)


__all__ = ["chunked", "matrix_blocks", "moved_blocks", "pieces", "rotated_blocks", "whole_items"]
