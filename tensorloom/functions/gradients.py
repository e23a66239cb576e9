"""Pullbacks: what a change of the output says about the input and the parameters.

A gradient of a complex value is the derivative by its real part plus i times the
derivative by its imaginary part. Trees are walked backwards in NumPy on Arrow batches:
each task adds up the gradients of its own batch items, and only these sums, one row
for each element of a parameter, are shuffled. What does not fit in a task is walked by joins (``tape``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import leaves as L
from ..operators import nodes as N
from ..operators.base import Operator, OperatorError
from ..plans import lower, tiles
from ..plans.lower import apply, has_im, is_dense, keys_of, long_of
from ..plans.types import is_complex
from .tape import record

_CELLS = "op_id string, i int, j int, re double, im double"
Grads = dict[str, np.ndarray]


def grad_input(op: Operator, upstream: DataFrame) -> DataFrame:
    """The adjoint on the upstream gradient; for a reduction the gradient itself. Where the adjoint is an inverse or
    overwrites, as that of a transform or of overlapping ranges, ``pullback`` is the derivative."""
    return upstream if isinstance(op, L.Reduce) else apply(op.adjoint(), upstream)


def pullback(op: Operator, upstream: DataFrame, joins: bool | None = None) -> DataFrame:
    """The gradient of the input of a bound tree, for every kind of node the true derivative; LONG to LONG or DENSE to DENSE.
 ``joins`` as in ``grad_params``."""
    if not op.applicable:
        raise OperatorError("the operator has parameters without values; bind them first")
    tree, dense = lower._stripped(op), is_dense(upstream)
    if joins or joins is None and not _in_tasks(op):
        g = lower._guarded(long_of(upstream) if dense else upstream, tree.range)
        out = record(op, None, [])[1](g, "idx")
        if tree.domain is not None and (dense or lower._shows_gaps(tree.adjoint())):
            out = lower._filled(out, g, tree.domain)
        return lower.dense_of(out) if dense else out
    into, out_of = is_complex(tree.rdt) and has_im(upstream), is_complex(tree.ddt)

    def rule(g: np.ndarray, values: dict[str, np.ndarray]) -> np.ndarray:
        none = np.zeros((len(g), tree.domain), complex if out_of else float)  # a linear operator's derivative is the same everywhere
        return taped(tree, none, values, {})[1](g)

    given = upstream if dense else lower._guarded(upstream, tree.range)
    out = lower.by_items(op, given, rule, tree.range, into, out_of)
    return out if dense else lower.long_of(out)


def grad_params(op: Operator, x: DataFrame, upstream: DataFrame, joins: bool | None = None) -> DataFrame:
    """Gradients of all bound leaves of ``op`` as a table of parameters, summed over the batch.

    ``x`` is the input and ``upstream`` the gradient of the output, both LONG or both DENSE,
    with the same keys; null keys are keys. Compositions, Kronecker products,
    adjoints and broadcast operators are walked backwards: in NumPy on whole items, if these and all parameters together
    fit in a task; else, or with ``joins``, by joins, which takes reductions too.
    """
    if not (tiles.bound(op) or isinstance(op, (L.Matrix, L.Diagonal, L.Tensor))):  # of a leaf alone no value is needed
        raise OperatorError("no parameter is bound")
    if not joins and (joins is not None or _in_tasks(op)):
        return _by_items(op, x, upstream)
    grads: list[DataFrame] = []
    tree = lower._stripped(op)
    sides = [lower._guarded(long_of(d) if is_dense(d) else d, n) for d, n in ((x, tree.domain), (upstream, tree.range))]
    record(op, sides[0], grads)[1](sides[1], "idx")
    out = grads[0]
    for more in grads[1:]:
        out = out.unionByName(more)
    return gather_gradients(out)


def _in_tasks(op: Operator) -> bool:
    """Whether items and all parameters together are small enough for a task."""
    return tiles.whole(op) and lower._widest(lower._stripped(op)) <= lower.ITEM_CELLS


def _by_items(op: Operator, x: DataFrame, upstream: DataFrame) -> DataFrame:
    tree, fibres = lower._stripped(op), not is_dense(x)
    complex_in, complex_out = is_complex(tree.ddt) and has_im(x), is_complex(tree.rdt) and has_im(upstream)
    keys, domain, size = keys_of(x), tree.domain, tree.range
    columns = [["cells"] if fibres else ["re", *(["im"] if c else [])] for c in (complex_in, complex_out)]
    # input and upstream gradient of an item come together in one aggregate, which takes null keys for keys
    sides = [lower._guarded(d, n) for d, n in ((x, domain), (upstream, size))] if fibres else [x, upstream]
    rows = []
    for side, (df, c) in enumerate(zip(sides, (complex_in, complex_out))):
        values = ["idx", "re", *(["im"] if c else [])] if fibres else columns[side]
        rows.append(df.select(*[F.col(f"`{k}`") for k in keys], F.struct(*values).alias(("s_x", "s_y")[side])))
    both = rows[0].unionByName(rows[1], allowMissingColumns=True).groupBy(*[f"`{k}`" for k in keys])
    if fibres:
        both = both.agg(F.collect_list("s_x").alias("x_cells"), F.collect_list("s_y").alias("y_cells")).where("size(x_cells) > 0 AND size(y_cells) > 0")
    else:
        both = both.agg(F.any_value("s_x", True).alias("x"), F.any_value("s_y", True).alias("y"))
        both = both.select(*[F.col(f"x.{c}").alias(f"x_{c}") for c in columns[0]], *[F.col(f"y.{c}").alias(f"y_{c}") for c in columns[1]])
    both = both.drop(*keys)
    shapes = {leaf.op_id: leaf for leaf in tree.leaves() if getattr(leaf, "op_id", None) is not None}
    values = lower.gathered(op) or {op_id: np.zeros(leaf.shape if isinstance(leaf, L.Matrix) else prod(leaf.shape)) for op_id, leaf in shapes.items()}
    shared = x.sparkSession.sparkContext.broadcast(values)  # checked by grad_params()

    def array(part: pa.RecordBatch, at: int, n: int, im: bool) -> np.ndarray:
        re = lower.rows_of(part.column(at), n, fibres)
        return re + 1j * (lower.rows_of(part.column(at), n, True, "im") if fibres else lower.rows_of(part.column(at + 1), n, False)) if im else re

    def walk(batches):
        grads: Grads = {}
        for batch in batches:
            valid = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            for part in lower.slices(batch.filter(pa.array(valid)), max(lower._widest(tree), 1)):
                back = taped(tree, array(part, 0, domain, complex_in), shared.value, grads)[1]
                back(array(part, len(columns[0]), size, complex_out))
        for op_id, g in grads.items():
            flat = g if isinstance(shapes[op_id], L.Matrix) else g.reshape(-1, 1)
            i, j = np.divmod(np.arange(flat.size), flat.shape[1])
            re, im = np.ascontiguousarray(flat.real).ravel(), np.ascontiguousarray(flat.imag).ravel() if np.iscomplexobj(flat) else np.zeros(flat.size)
            yield pa.RecordBatch.from_arrays([pa.array([op_id] * flat.size, pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(re), pa.array(im)], ["op_id", "i", "j", "re", "im"])

    return gather_gradients(both.mapInArrow(walk, _CELLS))


def _add(grads: Grads, op_id: str, g: np.ndarray, dtype: str) -> None:
    g = g if is_complex(dtype) else g.real
    grads[op_id] = grads[op_id] + g if op_id in grads else g


def taped(op: Operator, x: np.ndarray, values: dict[str, np.ndarray], grads: Grads) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """``op`` along the last axis of ``x``, and the way back: from the output's gradient to the
    input's, adding the gradients of parameters to ``grads`` as it goes."""
    if isinstance(op, N.Compose):
        backs = []
        for o in reversed(op.ops):
            x, back = taped(o, x, values, grads)
            backs.append(back)
        return x, partial(_chained, backs)
    if isinstance(op, N.Kron):
        head, backs = x.shape[:-1], []
        x = x.reshape(*head, *(o.domain for o in op.ops))
        for k in op.order:
            at = len(head) + k
            y, back = taped(op.ops[k], np.moveaxis(x, at, -1), values, grads)
            x = np.moveaxis(y, -1, at)
            backs.append(lambda g, back=back, at=at: np.moveaxis(back(np.moveaxis(g, at, -1)), -1, at))
        return x.reshape(*head, -1), lambda g: _chained(backs, g.reshape(*head, *(o.range for o in op.ops))).reshape(*head, -1)
    if isinstance(op, N.Adjoint):
        return _taped_leaf(op.op, x, values, grads, True)
    return _taped_leaf(op, x, values, grads, False)


def _chained(backs: list, g: np.ndarray) -> np.ndarray:
    for back in reversed(backs):
        g = back(g)
    return g


def _taped_leaf(op: Operator, x: np.ndarray, values: dict[str, np.ndarray], grads: Grads, adjoint: bool):
    y = lower._evaluate_leaf(op, x, values, adjoint)
    whole = lambda g: g if np.iscomplexobj(x) else g.real  # noqa: E731  a real input has a real gradient

    def back(g: np.ndarray) -> np.ndarray:
        if isinstance(op, L.Diagonal):
            w = values[op.op_id]
            term = g.conj() * x if adjoint else g * x.conj()
            _add(grads, op.op_id, term.reshape(-1, op.n).sum(axis=0), op.dtype)
            return whole(g * (w if adjoint else w.conj()))
        if isinstance(op, L.Matrix):
            w = values[op.op_id]
            into, out = x.reshape(-1, x.shape[-1]), g.reshape(-1, g.shape[-1])
            _add(grads, op.op_id, into.T @ out.conj() if adjoint else out.T @ into.conj(), op.dtype)
            return whole(g @ w.T if adjoint else g @ w.conj())
        if isinstance(op, L.Tensor):
            return whole(_tensor_back(op.turned() if adjoint else op, x, g, values[op.op_id], adjoint, grads))
        if isinstance(op, L.Fourier):
            return whole(_fourier_back(op, g, adjoint))
        if isinstance(op, L.Restriction):
            return _restriction_back(op, g, adjoint)
        return g

    return y, back


def _tensor_back(t: L.Tensor, x: np.ndarray, g: np.ndarray, w: np.ndarray, conj: bool, grads: Grads) -> np.ndarray:
    letter = {a: chr(97 + k) for k, a in enumerate(t.sizes)}
    name = lambda axes: "".join(letter[a] for a in axes[::-1])  # noqa: E731  first axis fastest
    shaped = lambda v, shape: v.reshape(-1, *shape[::-1])
    xs, gs, ws = shaped(x, t.input_shape), shaped(g, t.target_shape), w.reshape(t.weight_shape[::-1])
    # axes of the weight that neither side has are summed over, so its gradient is constant along them
    seen = [a for a in t.weight_axes if a in t.input_axes or a in t.target_axes]
    term = np.einsum(f"Z{name(t.target_axes)},Z{name(t.input_axes)}->{name(seen)}", gs, xs.conj())
    for k, a in enumerate(t.weight_axes[::-1]):
        if a not in seen:
            term = np.repeat(np.expand_dims(term, k), t.sizes[a], axis=k)
    _add(grads, t.op_id, (term.conj() if conj else term).ravel(), t.dtype)
    used = ws if conj else ws.conj()
    lost = [a for a in t.input_axes if a not in t.weight_axes and a not in t.target_axes]
    kept = [a for a in t.input_axes if a not in lost]
    out = np.einsum(f"Z{name(t.target_axes)},{name(t.weight_axes)}->Z{name(kept)}", gs, used)
    for k, a in enumerate(t.input_axes[::-1]):
        if a in lost:
            out = np.repeat(np.expand_dims(out, k + 1), t.sizes[a], axis=k + 1)
    return out.reshape(*x.shape[:-1], -1)


def _fourier_back(op: L.Fourier, g: np.ndarray, inverse: bool) -> np.ndarray:
    """The conjugate transpose, which for the real kinds is not the inverse: each stored coefficient counts once."""
    n = op.n
    if not n:
        return g
    scale = 1 / np.sqrt(n) if op.norm == "ortho" else 1 / n if inverse else 1.0
    if is_complex(op.dtype):
        return (np.fft.fft(g) if inverse else np.fft.ifft(g) * n) * scale
    if not inverse:
        full = np.zeros((*g.shape[:-1], n), complex)
        full[..., : op.range] = g
        return np.fft.ifft(full).real * n * scale
    twice = np.full(op.range, 2.0)
    twice[0] = 1.0
    if n % 2 == 0:
        twice[-1] = 1.0
    return np.fft.rfft(g.real) * twice * scale


def _restriction_back(op: L.Restriction, g: np.ndarray, adjoint: bool) -> np.ndarray:
    if not adjoint:  # what is read several times gathers several gradients
        out = np.zeros((*g.shape[:-1], op.n), g.dtype)
        for a, b, to in op.gathered():
            out[..., a:b] += g[..., to : to + b - a]
        return out
    out = np.zeros((*g.shape[:-1], op.range), g.dtype)  # what was overwritten has none
    for a, b, to in op.scattered():
        out[..., a:b] = g[..., to : to + b - a]
    return out


def gather_gradients(gradients: DataFrame) -> DataFrame:
    """Gradients of replicated parameters, one table with a share from each worker, summed at the root."""
    return gradients.groupBy("op_id", "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


__all__ = ["gather_gradients", "grad_input", "grad_params", "pullback", "taped"]
