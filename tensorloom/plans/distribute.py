"""Expressions that say where data lie: grids, gathers and local products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import leaves as L
from ..operators import nodes as N
from ..operators.base import Operator, OperatorError
from .grid import axis_exprs, flat_expr, grid_block, local_size


def grid_for(grid: tuple[int, ...], operand: int) -> tuple[int, ...]:
    """The grid on which operand ``operand`` of a product has its axis whole; the next axis takes over its workers.

    Grid axes count from the fastest: operand ``o`` of ``n`` owns axis ``n - 1 - o``.
    """
    n = len(grid)
    axis = n - 1 - operand
    out = list(grid)
    out[axis] = 1
    out[(axis + 1) % n] *= grid[axis]
    return tuple(out)


def distribute(op: Operator, grid: tuple[int, ...] = (), grid_out: tuple[int, ...] | None = None) -> Operator:
    """``op`` as repartitions between grids and operators that need no other worker's data.

    Matrices keep their parameters whole on every worker; diagonals and
    identities are already local. A product brings each operand's axis to one
    worker before it is applied, and moves data only if the grid changes. When
    the expression is applied, moves within it cost nothing: each product deals
    rows anew by their batch keys and other axes, which keeps its axis whole, so
    only a last move to a grid of its own places rows.
    """
    if isinstance(op, L.Identity):
        return op
    if isinstance(op, L.Diagonal):
        return op  # joined on the index, so its blocks lie where the data's do
    if isinstance(op, (L.Matrix, L.Fourier, N.Bound, N.Adjoint)):
        return N.broadcasted(op) if op.has_params else op
    if isinstance(op, L.Tensor):
        return distribute_tensor(op, grid)
    if not isinstance(op, N.Kron):
        raise OperatorError(f"no distribution for {type(op).__name__}")
    grid = tuple(grid)
    if len(grid) != len(op.ops):
        raise OperatorError(f"{len(op.ops)} operands on a grid of {len(grid)} axes")
    busy = [k for k in op.order if not isinstance(op.ops[k], L.Identity)]
    if not busy:
        return L.Identity(op.domain, op.ddt)
    # the grid before each operand's turn, and where the result is to lie
    grids = [grid, *(grid_for(grid, k) for k in busy), tuple(grid_out or grid)]
    steps: list[Operator] = []
    for turn, (now, there) in enumerate(zip(grids, grids[1:])):
        lengths = [o.range if k in busy[:turn] else o.domain for k, o in enumerate(op.ops)]
        operand = busy[turn] if turn < len(busy) else None
        if now != there:
            steps.append(L.Repartition(tuple(lengths[::-1]), now, there, op.rdt if operand is None else op.ops[operand].ddt))
        if operand is not None:
            steps.append(_alone(op.ops[operand], operand, lengths))
    return N.composed(steps[::-1])


def _alone(child: Operator, operand: int, lengths: list[int]) -> N.Kron:
    """A product in which only one operand does something; the identities take its output."""
    parts = [N.broadcasted(child) if child.has_params else child] * len(lengths)
    parts = [p if k == operand else L.Identity(n, child.rdt) for k, (p, n) in enumerate(zip(parts, lengths))]
    return N.Kron(tuple(parts), (operand, *(k for k in range(len(lengths)) if k != operand)))


def local_diagonal(op: L.Diagonal, rank: int, workers: int) -> L.Diagonal:
    """The diagonal of worker ``rank``'s block: its length, and a parameter of its own."""
    return L.Diagonal(local_size(op.n, rank, workers), f"{op.op_id}@{rank}/{workers}", op.dtype)


def distribute_tensor(op: L.Tensor, grid: tuple[int, ...]) -> L.Tensor:
    """The tensor of one worker's block; ``grid`` has workers for each input axis. Summed axes must be whole, divisions exact."""
    workers = dict(zip(op.input_axes, grid))
    for a, p in workers.items():
        if p > 1 and a not in op.target_axes:
            raise OperatorError(f"axis {a} is summed over and cannot be divided among {p} workers")
        if op.sizes[a] % p:
            raise OperatorError(f"axis {a} of {op.sizes[a]} is not divisible among {p} workers")
    local = lambda axes, shape: tuple(n // workers.get(a, 1) for a, n in zip(axes, shape))
    return L.Tensor(op.weight_axes, local(op.weight_axes, op.weight_shape), op.input_axes, local(op.input_axes, op.input_shape), op.target_axes, local(op.target_axes, op.target_shape), op.op_id, op.dtype)


def local_part(op: Operator, grid: tuple[int, ...], rank: int) -> Operator:
    """A diagonal's or tensor's part that worker ``rank`` of the grid applies to its block; its parameter is a new one."""
    workers = 1
    for p in grid:
        workers *= p
    if isinstance(op, L.Diagonal):
        return local_diagonal(op, rank, workers)
    if isinstance(op, L.Tensor):
        t = distribute_tensor(op, grid)
        return L.Tensor(t.weight_axes, t.weight_shape, t.input_axes, t.input_shape, t.target_axes, t.target_shape, f"{op.op_id}@{rank}/{workers}", op.dtype)
    raise OperatorError(f"no local part of {type(op).__name__}")


def local_params(op: Operator, grid: tuple[int, ...], rank: int, params: DataFrame) -> DataFrame:
    """The rows of ``params`` that ``local_part`` needs, under its id and with indices of its own."""
    axes, shape = (op.weight_axes, op.weight_shape) if isinstance(op, L.Tensor) else (("n",), (op.n,))
    parted = op.input_axes if isinstance(op, L.Tensor) else ("n",)
    sizes = op.sizes if isinstance(op, L.Tensor) else {"n": op.n}
    block = dict(zip(parted, grid_block(tuple(sizes[a] for a in parted), grid, rank)))
    own = [block.get(a, (0, n)) for a, n in zip(axes, shape)]
    rows = params.where(F.col("op_id") == op.op_id)
    return _shifted_rows(rows, "i", tuple(shape), own).withColumn("op_id", F.lit(local_part(op, grid, rank).op_id))


def local_rows(df: DataFrame, shape: tuple[int, ...], grid: tuple[int, ...], rank: int) -> DataFrame:
    """The LONG rows of worker ``rank``'s block, with local positions."""
    return _shifted_rows(df, "idx", shape, grid_block(shape, grid, rank))


def global_rows(df: DataFrame, shape: tuple[int, ...], grid: tuple[int, ...], rank: int) -> DataFrame:
    """Undoes ``local_rows``."""
    block = grid_block(shape, grid, rank)
    at = [f"({e} + {a})" for e, (a, _) in zip(axis_exprs("idx", tuple(b - a for a, b in block)), block)]
    return df.withColumn("idx", F.expr(flat_expr(at, shape)))


def _shifted_rows(df: DataFrame, idx: str, shape: tuple[int, ...], block: list[tuple[int, int]]) -> DataFrame:
    at = axis_exprs(idx, shape)
    inside = " AND ".join(f"{e} BETWEEN {a} AND {b - 1}" for e, (a, b) in zip(at, block))
    local = flat_expr([f"({e} - {a})" for e, (a, _) in zip(at, block)], tuple(b - a for a, b in block))
    return df.where(inside).withColumn(idx, F.expr(local))
