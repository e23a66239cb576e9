"""Logical element types, their order and their cost weights."""

from __future__ import annotations

#: Type name -> (multiplication cost, addition cost, bytes of an element).
_TYPES = {
    "f16": (0.5, 0.25, 2),
    "f32": (1.0, 1.5, 4),
    "f64": (2.0, 1.0, 8),
    "c16": (1.0, 0.5, 4),
    "c32": (2.0, 1.0, 8),
    "c64": (4.0, 2.0, 16),
}
#: Cost of moving a byte between workers, and of a node of an expression.
TRANSFER_COST = 100.0
SYNTACTIC_COST = 1e-5

NAMES = tuple(_TYPES)


class OperatorError(ValueError):
    """An expression that cannot be built, bound or applied."""


def checked(dtype: str) -> str:
    if dtype not in _TYPES:
        raise OperatorError(f"unknown element type {dtype!r}; one of {', '.join(NAMES)}")
    return dtype


def is_complex(dtype: str) -> bool:
    return checked(dtype)[0] == "c"


def real_of(dtype: str) -> str:
    return "f" + checked(dtype)[1:]


def complex_of(dtype: str) -> str:
    return "c" + checked(dtype)[1:]


def multiplication_cost(dtype: str) -> float:
    return _TYPES[checked(dtype)][0]


def addition_cost(dtype: str) -> float:
    return _TYPES[checked(dtype)][1]


def element_bytes(dtype: str) -> int:
    return _TYPES[checked(dtype)][2]


def transfer_cost(n_bytes: float) -> float:
    return TRANSFER_COST * n_bytes


def subset_type(a: str, b: str) -> str:
    """The narrower of two types: real is below complex, then fewer bits are below more."""
    return min(checked(a), checked(b), key=lambda t: (is_complex(t), int(t[1:])))


def superset_type(a: str, b: str) -> str:
    """The smallest type that holds both."""
    bits = max(int(checked(a)[1:]), int(checked(b)[1:]))
    return f"{'c' if is_complex(a) or is_complex(b) else 'f'}{bits}"
