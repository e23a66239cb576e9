"""Nodes over other operators: composition, Kronecker product, adjoint, bound, broadcast and distributed operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod
from typing import Any

from ..plans.types import element_bytes, subset_type
from .base import BOUND, Operator, OperatorError
from .leaves import Identity


@dataclass(frozen=True)
class Compose(Operator):
    """The right-most operator is applied first. Lengths and element types of neighbours must agree."""

    ops: tuple[Operator, ...]

    def __post_init__(self):
        for a, b in zip(self.ops, self.ops[1:]):
            if None not in (a.domain, b.range) and a.domain != b.range:
                raise OperatorError(f"an input of {a.domain} follows an output of {b.range} elements")
            if a.ddt != b.rdt:
                raise OperatorError(f"an input of {a.ddt} follows an output of {b.rdt}")

    @property
    def children(self):
        return self.ops

    @property
    def domain(self):
        return next((o.domain for o in reversed(self.ops) if o.domain is not None), None)

    @property
    def range(self):
        return next((o.range for o in self.ops if o.range is not None), None)

    @property
    def ddt(self):
        return self.ops[-1].ddt

    @property
    def rdt(self):
        return self.ops[0].rdt

    def rebuild(self, children):
        return composed(children)

    def adjoint(self):
        return composed([o.adjoint() for o in reversed(self.ops)])


def composed(ops) -> Operator:
    """Composition of a list as it stands; one operator is itself."""
    ops = tuple(ops)
    if not ops:
        raise OperatorError("nothing to compose")
    return ops[0] if len(ops) == 1 else Compose(ops)


def compose(*ops: Operator) -> Operator:
    """Composition that merges compositions among its operands."""
    return composed([x for o in ops for x in (o.ops if isinstance(o, Compose) else (o,))])


def greedy_order(ops) -> tuple[int, ...]:
    """An order of application: whatever fits the current type; among these the narrowest output, the largest loss of length, the right-most."""
    current, left, out = ops[0].ddt, list(range(len(ops))), []
    for o in ops[1:]:
        current = subset_type(current, o.ddt)
    while left:
        fits = [i for i in left if ops[i].ddt == current]
        if not fits:
            raise OperatorError(f"no operand takes {current}")
        least = ops[fits[0]].rdt
        for i in fits[1:]:
            least = subset_type(least, ops[i].rdt)
        pick = max((i for i in fits if ops[i].rdt == least), key=lambda i: (ops[i].domain - ops[i].range, i))
        out.append(pick)
        left.remove(pick)
        current = ops[pick].rdt
    return tuple(out)


@dataclass(frozen=True)
class Kron(Operator):
    """Kronecker product; the last operand acts on the fastest axis. ``order`` lists operands as they are applied."""

    ops: tuple[Operator, ...]
    order: tuple[int, ...]

    def __post_init__(self):
        if sorted(self.order) != list(range(len(self.ops))):
            raise OperatorError(f"{self.order} is no order of {len(self.ops)} operands")
        for a, b in zip(self.order, self.order[1:]):
            if self.ops[a].rdt != self.ops[b].ddt:
                raise OperatorError(f"order {self.order}: {self.ops[b].ddt} is wanted after {self.ops[a].rdt}")

    @property
    def children(self):
        return self.ops

    @property
    def domain(self):
        return prod(o.domain for o in self.ops)

    @property
    def range(self):
        return prod(o.range for o in self.ops)

    @property
    def ddt(self):
        return self.ops[self.order[0]].ddt

    @property
    def rdt(self):
        return self.ops[self.order[-1]].rdt

    def rebuild(self, children):
        """Keeps the order, so binding parameters does not undo an optimised one."""
        return Kron(tuple(children), self.order)

    def adjoint(self):
        return Kron(tuple(o.adjoint() for o in self.ops), self.order[::-1])

    def with_order(self, order) -> Kron:
        return Kron(self.ops, tuple(order))


def kron_of(ops) -> Operator:
    """Kronecker product of a list as it stands, in greedy order. One operand is itself; identities of one type are one identity."""
    ops = tuple(ops)
    if not ops:
        raise OperatorError("nothing to multiply")
    if len(ops) == 1:
        return ops[0]
    if all(isinstance(o, Identity) and o.dtype == ops[0].ddt for o in ops):
        return Identity(prod(o.n for o in ops), ops[0].ddt)
    return Kron(ops, greedy_order(ops))


def kron(*ops: Operator) -> Operator:
    """Kronecker product that merges products among its operands."""
    return kron_of([x for o in ops for x in (o.ops if isinstance(o, Kron) else (o,))])


@dataclass(frozen=True)
class Adjoint(Operator):
    """Conjugate transpose of a leaf, worked out when it is applied."""

    op: Operator

    @property
    def children(self):
        return (self.op,)

    @property
    def domain(self):
        return self.op.range

    @property
    def range(self):
        return self.op.domain

    @property
    def ddt(self):
        return self.op.rdt

    @property
    def rdt(self):
        return self.op.ddt

    def rebuild(self, children):
        (c,) = children
        return c.adjoint()

    def adjoint(self):
        return self.op


@dataclass(frozen=True)
class Bound(Operator):
    """A leaf with its values: the rows of ``params`` that carry its id."""

    op: Operator
    params: Any = field(compare=False, repr=False)

    def __post_init__(self):
        from .leaves import Matrix

        if self.op.children or getattr(self.op, "op_id", None) is None:
            raise OperatorError("only parametric leaves are bound")
        if "bi" in getattr(self.params, "columns", ()) and not isinstance(self.op, Matrix):
            raise OperatorError("tiles are for matrices")

    @property
    def children(self):
        return (self.op,)

    @property
    def parametricity(self):
        return BOUND

    @property
    def domain(self):
        return self.op.domain

    @property
    def range(self):
        return self.op.range

    @property
    def ddt(self):
        return self.op.ddt

    @property
    def rdt(self):
        return self.op.rdt

    def rebuild(self, children):
        (c,) = children
        return Bound(c, self.params)

    def params_df(self):
        """``(i, j, re, im)`` of this operator's parameter, whichever way its table is laid out."""
        from ..plans import tiles

        if tiles.is_tiled(self.params):
            return tiles.elements(self.params, self.op)
        return self.params.where(self.params["op_id"] == self.op.op_id).select("i", "j", "re", "im")

    def __getitem__(self, cut):
        """A bound submatrix; its values are the block's, moved to start at 0."""
        from pyspark.sql import functions as F

        from .leaves import axis_range

        part = self.op[cut]
        rows, cols = (axis_range(c, n) for c, n in zip(cut, (self.op.m, self.op.n)))
        values = self.params_df().where(F.col("i").between(rows.start, rows.stop - 1) & F.col("j").between(cols.start, cols.stop - 1))
        i, j = ((F.col(c) - r.start).cast("int").alias(c) for c, r in (("i", rows), ("j", cols)))
        return Bound(part, values.select(F.lit(part.op_id).alias("op_id"), i, j, "re", "im"))


@dataclass(frozen=True)
class _Around(Operator):
    op: Operator

    @property
    def children(self):
        return (self.op,)

    @property
    def domain(self):
        return self.op.domain

    @property
    def range(self):
        return self.op.range

    @property
    def ddt(self):
        return self.op.ddt

    @property
    def rdt(self):
        return self.op.rdt


#: Parameters of so many bytes at most are sent to all executors.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Broadcasted(_Around):
    """An operator whose parameters every worker gets whole, if they are small enough; else they are joined by shuffle."""

    def rebuild(self, children):
        (c,) = children
        if isinstance(c, Kron):  # each parametric operand gets its own
            return c.rebuild([broadcasted(x) if x.has_params else x for x in c.ops])
        return Broadcasted(c)

    def adjoint(self):
        return Broadcasted(self.op.adjoint())


def broadcasted(op: Operator) -> Operator:
    return op if isinstance(op, Broadcasted) else Broadcasted(op).rebuild([op])


@dataclass(frozen=True)
class Distributed(_Around):
    """The part of an operator that worker ``rank`` of ``workers`` has; lengths are local."""

    rank: int
    workers: int

    @property
    def domain(self):
        from ..plans.grid import local_size

        return local_size(self.op.domain, self.rank, self.workers)

    @property
    def range(self):
        from ..plans.grid import local_size

        return local_size(self.op.range, self.rank, self.workers)

    def rebuild(self, children):
        (c,) = children
        return Distributed(c, self.rank, self.workers)

    def adjoint(self):
        return Distributed(self.op.adjoint(), self.rank, self.workers)


def parameter_bytes(op: Operator) -> int:
    """Bytes of a leaf's parameter as rows of positions and two values."""
    return prod(op.shape) * max(24, element_bytes(op.ddt))
