"""Leaf operators: identity, diagonal, matrix, Fourier transform, restriction, tensor, reduction, repartition."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from heapq import heappop, heappush
from math import prod

from ..plans.types import complex_of, is_complex, real_of
from .base import FREE, PARAMETRIC, Operator, OperatorError, at_least, checked


@dataclass(frozen=True)
class Identity(Operator):
    n: int
    dtype: str = "f64"

    def __post_init__(self):
        at_least(self.n, 0, "n")
        checked(self.dtype)

    @property
    def domain(self):
        return self.n

    range = domain

    @property
    def ddt(self):
        return self.dtype

    def adjoint(self):
        return self


@dataclass(frozen=True)
class Diagonal(Operator):
    """Element-wise product with the parameter ``op_id`` of length ``n``."""

    n: int
    op_id: str
    dtype: str = "f64"

    def __post_init__(self):
        at_least(self.n, 0, "n")
        checked(self.dtype)

    @property
    def shape(self):
        return (self.n,)

    @property
    def domain(self):
        return self.n

    range = domain

    @property
    def ddt(self):
        return self.dtype

    @property
    def parametricity(self):
        return PARAMETRIC


@dataclass(frozen=True)
class Matrix(Operator):
    """Product with the parameter ``op_id`` of ``m`` rows and ``n`` columns."""

    m: int
    n: int
    op_id: str
    dtype: str = "f64"

    def __post_init__(self):
        at_least(self.m, 0, "m")
        at_least(self.n, 0, "n")
        checked(self.dtype)

    @property
    def shape(self):
        return (self.m, self.n)

    @property
    def domain(self):
        return self.n

    @property
    def range(self):
        return self.m

    @property
    def ddt(self):
        return self.dtype

    @property
    def parametricity(self):
        return PARAMETRIC

    def __getitem__(self, cut) -> Matrix:
        """A new matrix of the size of the rows and columns taken; its parameter is a new one."""
        rows, cols = (axis_range(c, n) for c, n in zip(cut, (self.m, self.n)))
        return Matrix(len(rows), len(cols), f"{self.op_id}[{rows.start}:{rows.stop},{cols.start}:{cols.stop}]", self.dtype)


def axis_range(cut: slice | int, n: int) -> range:
    """The positions of an axis of length ``n`` that a slice or number takes, as a range of step 1."""
    if isinstance(cut, int):
        cut = slice(cut, cut + 1 or None)
    out = range(*cut.indices(n))
    if out.step != 1:
        raise OperatorError("slices of step 1 only")
    return out


@dataclass(frozen=True)
class Fourier(Operator):
    """Unnormalised discrete Fourier transform; real input gives the first ``n // 2 + 1`` coefficients.

    ``norm="backward"``: the adjoint is the inverse, scaled by 1/n. ``"ortho"``:
    both directions are scaled by 1/sqrt(n), so for complex input the inverse is
    the conjugate transpose. Axes of more than ``piece`` elements are transformed in factors in LONG, so no row has to hold one.
    """

    n: int
    dtype: str = "c64"
    norm: str = "backward"
    piece: int = 1 << 22

    def __post_init__(self):
        at_least(self.n, 0, "n")
        checked(self.dtype)
        if self.norm not in ("backward", "ortho"):
            raise OperatorError(f"unknown norm {self.norm!r}")

    @property
    def domain(self):
        return self.n

    @property
    def range(self):
        return self.n if is_complex(self.dtype) else self.n // 2 + 1 if self.n else 0

    @property
    def ddt(self):
        return self.dtype

    @property
    def rdt(self):
        return complex_of(self.dtype)


@dataclass(frozen=True)
class Restriction(Operator):
    """The elements at ``ranges`` of 0-based half-open positions, one range after the other; repeats are allowed.

    The adjoint scatters into zeros. Where ranges overlap, the last one wins, or
    with ``accumulate`` their values add up, which is the true adjoint. Ranges are
    checked against ``n`` when the operator is applied, not when it is built.
    """

    n: int
    ranges: tuple[tuple[int, int], ...]
    dtype: str = "f64"
    accumulate: bool = False

    def __post_init__(self):
        at_least(self.n, 0, "n")
        checked(self.dtype)
        object.__setattr__(self, "ranges", tuple((int(a), int(b)) for a, b in self.ranges))

    @property
    def domain(self):
        return self.n

    @property
    def range(self):
        return sum(max(b - a, 0) for a, b in self.ranges)

    @property
    def ddt(self):
        return self.dtype

    def checked_ranges(self) -> list[tuple[int, int]]:
        """The ranges that hold something, all within the domain."""
        ranges = [(a, b) for a, b in self.ranges if b > a]
        for a, b in ranges:
            if a < 0 or b > self.n:
                raise OperatorError(f"range [{a}, {b}) is outside of {self.n} elements")
        return ranges

    def disjoint(self) -> bool:
        """Whether no position is in two ranges."""
        ranges = sorted(self.checked_ranges())
        return all(b <= c for (_, b), (c, _) in zip(ranges, ranges[1:]))

    def gathered(self) -> list[tuple[int, int, int]]:
        """``(a, b, to)`` of each move: positions ``[a, b)`` go to those from ``to`` on."""
        out, at = [], 0
        for a, b in self.checked_ranges():
            out.append((a, b, at))
            at += b - a
        return out

    def scattered(self) -> list[tuple[int, int, int]]:
        """The moves of the adjoint. Without ``accumulate`` only what is not overwritten by a later range."""
        moves = [(at, at + b - a, a) for a, b, at in self.gathered()]
        if self.accumulate or self.disjoint():
            return moves
        # between neighbouring ends, the last range that is open there counts
        ends = sorted({x for at, end, a in moves for x in (a, a + end - at)})
        begins = deque(sorted(range(len(moves)), key=lambda k: moves[k][2]))
        out: list[tuple[int, int, int]] = []
        opened: list[int] = []
        for lo, hi in zip(ends, ends[1:]):
            while begins and moves[begins[0]][2] <= lo:
                heappush(opened, -begins.popleft())
            while opened and moves[-opened[0]][2] + moves[-opened[0]][1] - moves[-opened[0]][0] <= lo:
                heappop(opened)
            if opened:
                at, _, a = moves[-opened[0]]
                if out and out[-1][2] + out[-1][1] - out[-1][0] == lo and out[-1][1] == at + lo - a:
                    out[-1] = (out[-1][0], at + hi - a, out[-1][2])
                else:
                    out.append((at + lo - a, at + hi - a, lo))
        return out


@dataclass(frozen=True)
class Tensor(Operator):
    """Contraction of the input with the weight ``op_id``, described by one letter or name for each axis.

    Vectors and weights are laid out with their first axis fastest. Every target
    axis must stand in the weight or the input; axes that stand in neither target
    are summed over.
    """

    weight_axes: tuple[str, ...]
    weight_shape: tuple[int, ...]
    input_axes: tuple[str, ...]
    input_shape: tuple[int, ...]
    target_axes: tuple[str, ...]
    target_shape: tuple[int, ...]
    op_id: str
    dtype: str = "f64"

    def __post_init__(self):
        checked(self.dtype)
        sizes: dict[str, int] = {}
        for axes, shape in self.parts():
            if len(axes) != len(shape) or len(set(axes)) != len(axes):
                raise OperatorError(f"axes {axes} do not fit the shape {shape}")
            for a, n in zip(axes, shape):
                if sizes.setdefault(a, n) != n:
                    raise OperatorError(f"axis {a} has two sizes, {sizes[a]} and {n}")
        if missing := set(self.target_axes) - set(self.weight_axes) - set(self.input_axes):
            raise OperatorError(f"target axes {sorted(missing)} are in neither weight nor input")

    def parts(self):
        return ((self.weight_axes, self.weight_shape), (self.input_axes, self.input_shape), (self.target_axes, self.target_shape))

    @property
    def sizes(self) -> dict[str, int]:
        return {a: n for axes, shape in self.parts() for a, n in zip(axes, shape)}

    @property
    def shape(self):
        return tuple(self.weight_shape)

    @property
    def domain(self):
        return prod(self.input_shape)

    @property
    def range(self):
        return prod(self.target_shape)

    @property
    def ddt(self):
        return self.dtype

    @property
    def parametricity(self):
        return PARAMETRIC

    def turned(self) -> Tensor:
        """Input and target exchanged: the adjoint's axes."""
        return Tensor(self.weight_axes, self.weight_shape, self.target_axes, self.target_shape, self.input_axes, self.input_shape, self.op_id, self.dtype)


@dataclass(frozen=True)
class Reduce(Operator):
    """Element-wise sum over workers, present on every worker afterwards. Fits any length; self-adjoint."""

    dtype: str = "f64"

    @property
    def ddt(self):
        return checked(self.dtype)

    @property
    def domain(self):
        return None

    range = domain

    @property
    def parametricity(self):
        return FREE

    def adjoint(self):
        return self


@dataclass(frozen=True)
class Repartition(Operator):
    """Move an array of ``shape`` from blocks on the grid ``grid_in`` to blocks on ``grid_out``; values stay.

    The first axis is the fastest of the flat index; ranks count grid coordinates
    with the last coordinate fastest.
    """

    shape: tuple[int, ...]
    grid_in: tuple[int, ...]
    grid_out: tuple[int, ...]
    dtype: str = "f64"

    def __post_init__(self):
        checked(self.dtype)
        if not len(self.shape) == len(self.grid_in) == len(self.grid_out):
            raise OperatorError("shape and grids must have the same number of axes")

    @property
    def domain(self):
        return prod(self.shape)

    range = domain

    @property
    def ddt(self):
        return self.dtype

    @property
    def parametricity(self):
        return FREE

    def adjoint(self):
        return Repartition(self.shape, self.grid_out, self.grid_in, self.dtype)


def real_fourier(n: int, dtype: str = "f64", **options) -> Fourier:
    return Fourier(n, real_of(dtype), **options)
