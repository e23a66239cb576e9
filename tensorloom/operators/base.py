"""Expression trees of linear operators: what every node has."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import prod

from ..plans.types import OperatorError, checked

PARAMETRIC, BOUND, FREE = "parametric", "parameterized", "nonparametric"


def promote_linearity(*kinds: str) -> str:
    return "linear" if all(k == "linear" for k in kinds) else "nonlinear"


def promote_parametricity(*kinds: str) -> str:
    """Parametric if any part lacks values; else parameterized if any part has some."""
    return PARAMETRIC if PARAMETRIC in kinds else BOUND if BOUND in kinds else FREE


@dataclass(frozen=True)
class Operator:
    """A node. ``domain`` and ``range`` are lengths, ``ddt`` and ``rdt`` element types of input and output."""

    @property
    def domain(self) -> int:
        raise NotImplementedError(f"{type(self).__name__} has no domain")

    @property
    def range(self) -> int:
        raise NotImplementedError(f"{type(self).__name__} has no range")

    @property
    def ddt(self) -> str:
        raise NotImplementedError(f"{type(self).__name__} has no domain type")

    @property
    def rdt(self) -> str:
        return self.ddt

    @property
    def linearity(self) -> str:
        return "linear"

    @property
    def parametricity(self) -> str:
        return promote_parametricity(*(c.parametricity for c in self.children)) if self.children else FREE

    @property
    def children(self) -> tuple[Operator, ...]:
        return ()

    @property
    def location(self) -> str:
        """Whether the node is a leaf (external) or made of others (internal)."""
        return "internal" if self.children else "external"

    @property
    def applicable(self) -> bool:
        return self.parametricity != PARAMETRIC

    @property
    def has_params(self) -> bool:
        return self.parametricity != FREE

    def rebuild(self, children) -> Operator:
        """The same node over other children."""
        if tuple(children):
            raise OperatorError(f"{type(self).__name__} has no children")
        return self

    def adjoint(self) -> Operator:
        from .nodes import Adjoint

        return Adjoint(self)

    @property
    def H(self) -> Operator:  # noqa: N802
        return self.adjoint()

    def leaves(self):
        """Leaves from left to right; those of bound nodes are their operators."""
        if not self.children:
            yield self
        for c in self.children:
            yield from c.leaves()

    def slots(self) -> dict[str, Operator]:
        """Parametric leaves by id, in order; one id names one slot, so its shapes must agree."""
        out: dict[str, Operator] = {}
        for leaf in self.leaves():
            if getattr(leaf, "op_id", None) is not None:
                if out.setdefault(leaf.op_id, leaf).shape != leaf.shape:
                    raise OperatorError(f"two shapes for the parameter {leaf.op_id!r}")
        return out

    def __matmul__(self, other):
        from .nodes import compose

        if isinstance(other, Operator):
            return compose(self, other)
        return self.apply(other)

    __mul__ = __matmul__

    def __rmatmul__(self, other):
        return self.rapply(other)

    __rmul__ = __rmatmul__

    def __call__(self, other):
        """Bind a table of parameters, or apply to data."""
        if {"op_id", "re"} <= set(getattr(other, "columns", ())):
            return self.bind(other)
        return self.apply(other)

    def bind(self, params) -> Operator:
        """The tree with every parametric leaf bound to its rows of ``params``."""
        if self.parametricity != PARAMETRIC:
            return self
        if not self.children:
            from .nodes import Bound

            return Bound(self, params)
        return self.rebuild([c.bind(params) for c in self.children])

    def apply(self, df, **options):
        """Apply to a LONG table ``(keys..., idx, re[, im])`` or a DENSE one ``(keys..., re array[, im array])``."""
        from ..plans.lower import apply

        return apply(self, df, **options)

    def rapply(self, df, **options):
        """The row-vector product ``x A`` for each batch item."""
        from ..plans.lower import rapply

        return rapply(self, df, **options)


def at_least(n: int, least: int, what: str) -> None:
    if not isinstance(n, int) or n < least:
        raise OperatorError(f"{what} must be an integer of {least} or more, not {n!r}")


__all__ = ["BOUND", "FREE", "PARAMETRIC", "Operator", "OperatorError", "at_least", "checked", "prod", "promote_linearity", "promote_parametricity", "replace"]
