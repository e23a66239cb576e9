"""Blocks of arrays on Cartesian grids of workers, as plain arithmetic and as column expressions."""

from __future__ import annotations

from itertools import product
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_size(n: int, rank: int, workers: int) -> int:
    """Elements of worker ``rank`` when ``n`` are dealt in even blocks, the first ones one larger."""
    return n // workers + (rank < n % workers)


def block_ranges(n: int, workers: int) -> list[tuple[int, int]]:
    """The half-open block of each worker."""
    ends = [0]
    for r in range(workers):
        ends.append(ends[-1] + local_size(n, r, workers))
    return list(zip(ends, ends[1:]))


def range_axes(grid: tuple[int, ...], shape: tuple[int, ...]) -> list[list[tuple[int, int]]]:
    """For each axis, the blocks of its workers."""
    return [block_ranges(n, p) for n, p in zip(shape, grid)]


def grid_block(shape: tuple[int, ...], grid: tuple[int, ...], rank: int) -> list[tuple[int, int]]:
    """The range of each axis that worker ``rank`` has; grid coordinates count with the last one fastest."""
    out = []
    for axis, p in zip(reversed(range_axes(grid, shape)), reversed(grid)):
        rank, at = divmod(rank, p)
        out.append(axis[at])
    return out[::-1]


def cumulative_ranges(lengths) -> list[tuple[int, int]]:
    """Half-open ranges of the given lengths, one after the other."""
    ends = [0]
    for n in lengths:
        ends.append(ends[-1] + n)
    return list(zip(ends, ends[1:]))


def block_of(x: Column, n: int, workers: int) -> Column:
    """The block that position ``x`` lies in."""
    q, r = divmod(n, workers)
    edge = r * (q + 1)
    # both branches may be evaluated, so neither divides by zero
    high = F.lit(r) + F.floor((x - edge) / max(q, 1))
    return F.when(x < edge, F.floor(x / (q + 1))).otherwise(high).cast("int")


def axis_columns(idx: str, shape: tuple[int, ...]) -> list[Column]:
    """Coordinates of the flat index column ``idx``, the first axis fastest."""
    return [F.expr(x) for x in axis_exprs(idx, shape)]


def index_type(n: int) -> str:
    """The SQL type of positions below ``n``."""
    return "INT" if n <= 1 << 31 else "LONG"


def axis_exprs(idx: str, shape: tuple[int, ...]) -> list[str]:
    """The same as SQL text: one expression is one call to the JVM."""
    out, below = [], 1
    for n in shape:
        out.append(f"CAST(({idx} DIV {below}) % {n} AS {index_type(n)})" if n and below else "0")
        below *= n
    return out


def flat_expr(axes: list[str], shape: tuple[int, ...]) -> str:
    """The flat index of coordinates as SQL text, the first axis fastest; a long where an int has no room."""
    terms, below, kind = [], 1, index_type(prod(shape))
    for a, n in zip(axes, shape):
        a = a if kind == "INT" else f"CAST({a} AS LONG)"
        terms.append(f"{a} * {below}{'L' if below > 1 << 30 else ''}" if below != 1 else a)
        below *= n
    return f"CAST({' + '.join(terms) or '0'} AS {kind})"


def rank_of(idx: str, shape: tuple[int, ...], grid: tuple[int, ...]) -> Column:
    """The worker that holds the flat position in column ``idx``; its grid coordinates count with the last one fastest."""
    out = F.lit(0)
    for a, n, p in zip(axis_columns(idx, shape), shape, grid):
        out = out * p + block_of(a, n, p)
    return out.cast("int")


def moved_elements(shape, grid_in, grid_out) -> int:
    """Elements that change their worker between two grids, from block overlaps alone."""
    if prod(grid_in) == 1 and prod(grid_out) == 1:
        return 0
    kept = 0
    source, target = range_axes(grid_in, shape), range_axes(grid_out, shape)
    rank = lambda at, grid: sum(c * prod(grid[k + 1 :]) for k, c in enumerate(at))
    where = {rank(at, grid_out): at for at in product(*map(range, grid_out))}
    for at in product(*map(range, grid_in)):
        there = where.get(rank(at, grid_in))
        if there is not None:
            kept += prod(max(0, min(source[k][a][1], target[k][b][1]) - max(source[k][a][0], target[k][b][0])) for k, (a, b) in enumerate(zip(at, there)))
    return prod(shape) - kept
