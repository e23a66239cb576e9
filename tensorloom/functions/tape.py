"""The backward pass by joins, for parameters and items that do not fit in a task.

A tree is applied in LONG, step by step. What goes into a parametric leaf, and the gradient that comes back to
it, are written once, as both are read by the leaf's own gradient and by the next step; so no step
is worked out twice, however deep the tree is. The gradient of a parameter is a join of both sides by their keys and one
aggregate; that of the input is the conjugate transpose, lowered like any operator.
"""

from __future__ import annotations

from collections.abc import Callable
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import leaves as L
from ..operators import nodes as N
from ..operators.base import Operator, OperatorError
from ..plans import lower
from ..plans.grid import axis_exprs, flat_expr
from ..plans.lower import has_im, keys_of
from ..plans.types import complex_of, is_complex
from ..sources.checkpoints import kept

#: From the gradient of an output, along an index column, to that of the input.
Back = Callable[[DataFrame, str], DataFrame]


def record(op: Operator, x: DataFrame | None, grads: list[DataFrame], axis: str = "idx") -> tuple[DataFrame | None, Back]:
    """``op`` on LONG ``x`` and the way back, on which the gradients of parameters go to ``grads``. Without ``x`` only
    the gradient of the input can be had, and ``grads`` stays empty."""
    if isinstance(op, N.Compose):
        backs = []
        for o in reversed(op.ops):
            x, back = record(o, x, grads, axis)
            backs.append(back)

        def through(g: DataFrame, axis: str) -> DataFrame:
            for back in reversed(backs):
                g = back(g, axis)
            return g

        return x, through
    if isinstance(op, N.Kron):
        return _product(op, x, grads, axis)
    if isinstance(op, (N.Broadcasted, N.Distributed)):
        return record(op.op, x, grads, axis)
    adjoint = isinstance(op, N.Adjoint)
    inner = op.op if adjoint else op
    if isinstance(inner, (N.Bound, L.Matrix, L.Diagonal, L.Tensor)):
        return _parametric(op, inner, adjoint, x, grads, axis)
    y = None if x is None else lower._long(op, x, axis)
    if isinstance(inner, L.Fourier):
        return y, lambda g, axis: _transform_back(inner, g, adjoint, axis)
    if isinstance(inner, L.Restriction):
        return y, lambda g, axis: _moves_back(inner, g, adjoint, axis)
    # identity, and repartition, which only places rows; of a reduction each worker's gradient is its own
    return y, lambda g, axis: g


def _product(op: N.Kron, x: DataFrame | None, grads: list[DataFrame], axis: str) -> tuple[DataFrame | None, Back]:
    into, sizes, backs = [o.domain for o in op.ops], [o.domain for o in op.ops], []
    if x is not None:
        x, axes = lower.split_axis(x, axis, sizes)
    for k in op.order:
        x, back = record(op.ops[k], x, grads, axes[k] if x is not None else axis)
        backs.append((k, back))
        sizes[k] = op.ops[k].range
    out_of = list(sizes)

    def through(g: DataFrame, axis: str) -> DataFrame:
        g, axes = lower.split_axis(g, axis, out_of)
        for k, back in reversed(backs):
            g = back(g, axes[k])
        return lower.join_axis(g, axes, into, axis)

    return (None if x is None else lower.join_axis(x, axes, sizes, axis)), through


def _real(g: DataFrame, kind: str) -> DataFrame:
    """A real input has a real gradient."""
    return g if is_complex(kind) else g.drop("im")


def _parametric(op: Operator, inner: Operator, adjoint: bool, x: DataFrame | None, grads: list[DataFrame], axis: str) -> tuple[DataFrame | None, Back]:
    leaf = inner.op if isinstance(inner, N.Bound) else inner
    if x is not None:
        x = kept(x)
    y = lower._bound(inner, x, adjoint, axis) if x is not None and isinstance(inner, N.Bound) else None

    def back(g: DataFrame, at: str) -> DataFrame:
        if x is not None:
            g = kept(g)
            grads.append(leaf_gradient(leaf, x.withColumnRenamed(axis, at) if at != axis else x, g, adjoint, at))
        if not isinstance(inner, N.Bound):  # a leaf alone: its own gradient needs no value
            return g
        return _real(lower._bound(inner, g, not adjoint, at), op.ddt)

    return y, back


def _scaled(g: DataFrame, by: str) -> DataFrame:
    return g.withColumns({c: F.expr(f"{c} * {by}") for c in ("re", "im") if c in g.columns})


def _transform_back(f: L.Fourier, g: DataFrame, inverse: bool, axis: str) -> DataFrame:
    """The conjugate transpose, which for the real kinds is not the inverse: each stored coefficient counts once."""
    n, plain = f.n, f.norm != "ortho"
    if not n:
        return g
    if is_complex(f.dtype):
        back = lower._fourier(f, g, not inverse, axis)
        return _scaled(back, repr(1 / n) + "D" if inverse else f"{n}D") if plain else back
    if inverse:
        twice = f"CASE WHEN {axis} = 0 OR {axis} * 2 = {n} THEN 1D ELSE 2D END"
        return _scaled(lower._fourier(f, g.drop("im"), False, axis), f"{twice} * {1 / n!r}D" if plain else twice)
    whole = L.Fourier(n, complex_of(f.dtype), f.norm, f.piece)
    g = g if has_im(g) else g.withColumn("im", F.lit(0.0))
    back = lower._fourier(whole, g, True, axis).drop("im")  # coefficients that were not stored have no gradient
    return _scaled(back, f"{n}D") if plain else back


def _moves_back(r: L.Restriction, g: DataFrame, adjoint: bool, axis: str) -> DataFrame:
    moves = [(to, to + b - a, a) for a, b, to in (r.scattered() if adjoint else r.gathered())]
    out = lower.moved(g, moves, axis, r.range if adjoint else r.n, adjoint and r.accumulate and not r.disjoint())
    return out if adjoint or r.disjoint() else lower._sum(out, axis)  # what was read several times gathers several gradients


def leaf_gradient(leaf: Operator, x: DataFrame, g: DataFrame, adjoint: bool = False, axis: str = "idx") -> DataFrame:
    """``(op_id, i, j, re, im)`` of one leaf: the terms of a batch item meet by its keys, and are added up."""
    a, b = x.alias("x"), g.alias("y")
    at_x, at_y = f"x.`{axis}`", f"y.`{axis}`"
    xr, yr = F.col("x.re"), F.col("y.re")
    xi = F.col("x.im") if has_im(x) else F.lit(0.0)
    yi = F.col("y.im") if has_im(g) else F.lit(0.0)
    missing: list[tuple[str, int]] = []
    same = [F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`")) for k in keys_of(x, axis)]
    if isinstance(leaf, L.Matrix):
        joined = b.join(a, same or None, "inner" if same else None)
        i, j = (F.col(at_x), F.col(at_y)) if adjoint else (F.col(at_y), F.col(at_x))
    elif isinstance(leaf, L.Diagonal):
        joined = b.join(a, [*same, F.col(at_x) == F.col(at_y)])
        i, j = F.col(at_y), F.lit(0)
    elif isinstance(leaf, L.Tensor):
        t = leaf.turned() if adjoint else leaf
        ax = dict(zip(t.input_axes, axis_exprs(at_x, t.input_shape)))
        ay = dict(zip(t.target_axes, axis_exprs(at_y, t.target_shape)))
        joined = b.join(a, [*same, *[F.expr(f"{ax[n]} = {ay[n]}") for n in t.input_axes if n in ay]])
        # along axes that neither side has, the gradient is constant: it is worked out at 0 and repeated
        i, j = F.expr(flat_expr([ay.get(n, ax.get(n, "0")) for n in t.weight_axes], t.weight_shape)), F.lit(0)
        missing = [(n, prod(t.weight_shape[:k])) for k, n in enumerate(t.weight_axes) if n not in ax and n not in ay]
    else:
        raise OperatorError(f"{type(leaf).__name__} has no parameter")
    im = (yi * xr - yr * xi) if not adjoint else (yr * xi - yi * xr)
    terms = joined.select(i.cast("int").alias("i"), j.cast("int").alias("j"), (yr * xr + yi * xi).alias("re"), (im if is_complex(leaf.dtype) else F.lit(0.0)).alias("im"))
    sums = terms.groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    for n, below in missing:
        sums = sums.select(F.explode(F.sequence(F.col("i"), F.col("i") + (t.sizes[n] - 1) * below, F.lit(below))).alias("i"), "j", "re", "im")
    return sums.select(F.lit(leaf.op_id).alias("op_id"), "i", "j", "re", "im")


__all__ = ["leaf_gradient", "record"]
