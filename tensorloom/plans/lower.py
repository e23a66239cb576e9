"""From expression trees to DataFrames.

LONG: ``(keys..., idx, re[, im])``, one row an element; every column besides
``idx``, ``re`` and ``im`` is a batch key. Each operator is an equi-join with its
parameter and an aggregate, so Catalyst plans it and SQL can say it.

DENSE: ``(keys..., re array[, im array])``, one row a batch item, NumPy on Arrow
batches. It is the fast path for transforms and large dense matrices. LONG input
of a tree with transforms takes that path too, each item gathered into one row,
as long as items and parameters are small enough.

Inputs are checked where they enter: positions outside of the operator's domain,
rows of another length and null values are errors in either layout. A null array
(a batch item without values) stays null. Positions that a LONG item lacks count
as zero; of those that stand twice the sum counts.
"""

from __future__ import annotations

from functools import partial
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import leaves as L
from ..operators import nodes as N
from ..operators.base import Operator, OperatorError
from . import tiles
from .grid import axis_exprs, flat_expr, index_type, rank_of
from .types import complex_of, element_bytes, is_complex

#: Elements of a generated table (twiddles, positions) that is broadcast at most.
BROADCAST_ROWS = 1 << 20
#: Elements of a LONG item that is gathered into one row at most; larger ones are transformed axis by axis.
ITEM_CELLS = 1 << 22
#: Transforms up to this length are a join with a table of twiddles, longer ones a fast transform of each fibre.
TWIDDLE_LENGTH = 64
#: Elements of parameters that are collected row by row at most.
SMALL_CELLS = 1 << 14
#: Elements that a task evaluates at once, about.
BATCH_CELLS = 1 << 22


def keys_of(df: DataFrame, axis: str = "idx") -> list[str]:
    return [c for c in df.columns if c not in (axis, "re", "im")]


def has_im(df: DataFrame) -> bool:
    return "im" in df.columns


def long_of(df: DataFrame) -> DataFrame:
    """DENSE to LONG."""
    if not has_im(df):
        return df.select(*keys_of(df), F.posexplode("re").alias("idx", "re"))
    pairs = F.posexplode(F.arrays_zip("re", "im")).alias("idx", "v")
    return df.select(*keys_of(df), pairs).select(*keys_of(df), "idx", "v.re", "v.im")


def dense_of(df: DataFrame, n: int | None = None) -> DataFrame:
    """LONG to DENSE. A batch item must have each position once."""
    value = F.struct("idx", "re", *(["im"] if has_im(df) else []))
    out = df.groupBy(*keys_of(df)).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return out.select(*keys_of(df), F.col("v.re").alias("re"), *([F.col("v.im").alias("im")] if has_im(df) else []))


def is_dense(df: DataFrame) -> bool:
    return isinstance(df.schema["re"].dataType, T.ArrayType)


def apply(op: Operator, df: DataFrame, fast: bool | None = None, partitions: int | None = None, check: bool = True, complete: bool = False) -> DataFrame:
    """``op`` on each batch item of ``df``, LONG to LONG or DENSE to DENSE.

    ``fast``: NumPy on Arrow batches; by default for DENSE tables, and for LONG ones
    where the tree has transforms and its items and parameters are small enough.
    ``partitions``: deal batch items to so many partitions first; all later steps then
    go without a shuffle. Worth it where there are many more items than partitions.
    ``check``: refuse positions outside of the domain and null values in LONG tables; without
    it, filters on positions reach the source, and such rows are lost or spoil sums.
    ``complete``: LONG items have each position once, so zeros of a last scatter come with the rows that are there, in one pass.
    """
    if not op.applicable:
        raise OperatorError("the operator has parameters without values; bind them first")
    dense = is_dense(df)
    if has_im(df) and not is_complex(op.ddt):
        raise OperatorError(f"complex input for an operator on {op.ddt}")
    if is_complex(op.ddt) and not has_im(df):
        raise OperatorError(f"real input for an operator on {op.ddt}; add an im column")
    _check_ranges(op)
    df = _stored(df, "double")
    if partitions and keys_of(df):
        df = df.repartition(partitions, *_quoted(keys_of(df)))
    if check and not dense:
        df = _guarded(df, _stripped(op).domain)
    if fast is None:
        fast = dense or _gathers(op)
    if fast and not all(tiles.whole(o) or tiles.matrix_of(o) or isinstance(o, L.Reduce) for o, _, _ in tiles.axis_steps(op)):
        fast = False  # a large diagonal or tensor is joined element by element
    if fast:
        out = _fast(op, df) if dense else long_of(_fast(op, df))
    else:
        given = _guarded(long_of(df), _stripped(op).domain) if dense else df
        last, *before = op.ops if isinstance(op, N.Compose) else (op,)
        if (dense or complete) and _spreads(last) and not any(map(_shows_gaps, before)):
            out = _spread(last.op, _long(N.composed(before), given) if before else given)
        elif not _shows_gaps(op):
            out = _long(op, given)
        else:
            out = _long(op, given)
            out = _filled(out, out if any(isinstance(x, L.Reduce) for x in op.leaves()) else given, op.range)
        out = dense_of(out) if dense else out
    return _stored(out, "float") if element_bytes(op.rdt) <= (8 if is_complex(op.rdt) else 4) else out


def _stored(df: DataFrame, kind: str) -> DataFrame:
    """Values as ``float``, as types of up to 32 bits are kept, or as ``double``, as all are worked on."""
    of = {"re", "im"} & {*df.columns}
    want = f"array<{kind}>" if is_dense(df) else kind
    if all(df.schema[c].dataType.simpleString() == want for c in of):
        return df
    return df.withColumns({c: F.col(c).cast(want) for c in of})


def _guarded(df: DataFrame, n: int | None) -> DataFrame:
    """``df``, failing on positions outside of ``n`` elements and on null values. Whoever reads ``idx`` runs the check."""
    good = ["idx >= 0", *([f"idx < {n}"] if n is not None else []), *[f"{c} IS NOT NULL" for c in ("re", "im") if c in df.columns]]
    text = "a position is outside of the domain, or a value is null" if n is None else f"a position is outside of {n} elements, or a value is null"
    kind = df.schema["idx"].dataType.simpleString()
    idx = f"IF({' AND '.join(good)}, idx, CAST(raise_error('{text}') AS {kind})) AS idx"
    return df.selectExpr(*[idx if c == "idx" else f"`{c}`" for c in df.columns])


def _check_ranges(op: Operator) -> None:
    for leaf in op.leaves():
        if isinstance(leaf, L.Restriction):
            leaf.checked_ranges()


def _gathers(op: Operator) -> bool:
    """Whether LONG items are gathered into rows: the tree has transforms or large matrices, nothing that crosses items, and fits."""
    leaves = list(op.leaves())
    if any(isinstance(x, (L.Reduce, L.Repartition)) for x in leaves) or _widest(op) > ITEM_CELLS or any(isinstance(x, L.Fourier) and x.n > x.piece for x in leaves):
        return False
    if tiles.whole(op):
        return any(isinstance(x, L.Fourier) for x in leaves)
    return True


def _widest(op: Operator) -> int:
    """The most elements that an item has in any step of ``op``."""
    if isinstance(op, N.Kron):
        most = size = op.domain
        for k in op.order:
            child = op.ops[k]
            others = size // child.domain if child.domain else 0
            most, size = max(most, others * _widest(child)), others * child.range
        return most
    return max([op.domain, op.range, *map(_widest, op.children)])


def rapply(op: Operator, df: DataFrame, **options) -> DataFrame:
    """``x A`` for row vectors: the conjugate of the adjoint on the conjugate."""
    if not is_complex(op.rdt):
        return apply(op.adjoint(), df, **options)
    turn = lambda d: d.withColumn("im", F.transform("im", lambda v: -v) if is_dense(d) else -F.col("im"))
    return turn(apply(op.adjoint(), turn(df), **options))


# --- LONG -----------------------------------------------------------------


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _times(wr: str, wi: str, df: DataFrame, kind: str) -> list[str]:
    """The product of a weight and the value, in the parts that ``kind`` has. SQL text, as a plan has many of these."""
    if not is_complex(kind):
        return [f"{wr} * re AS re"]
    if not has_im(df):
        return [f"{wr} * re AS re", f"{wi} * re AS im"]
    return [f"{wr} * re - {wi} * im AS re", f"{wr} * im + {wi} * re AS im"]


def _sum(df: DataFrame, axis: str) -> DataFrame:
    """Values of equal keys and position, added up."""
    return df.groupBy(*_quoted(keys_of(df, axis)), axis).agg(*[F.sum(c).alias(c) for c in ("re", "im") if c in df.columns])


def _weight(op: Operator, conj: bool) -> tuple[DataFrame, str, str]:
    """A bound leaf's parameter with names of its own, broadcast if its shape says that it is small."""
    w = op.params_df().selectExpr("i AS w_i", "j AS w_j", "re AS w_re", "im AS w_im")
    if N.parameter_bytes(op.op) <= N.BROADCAST_BYTES:
        w = F.broadcast(w)
    return w, "w_re", "(-w_im)" if conj else "w_im"


def _bound(op: Operator, df: DataFrame, adjoint: bool, axis: str = "idx") -> DataFrame:
    leaf, keys = op.op, _quoted(keys_of(df, axis))
    w, wr, wi = _weight(op, adjoint)
    if isinstance(leaf, L.Diagonal):
        return df.join(w, F.col(axis) == F.col("w_i")).selectExpr(*keys, axis, *_times(wr, wi, df, leaf.dtype))
    if isinstance(leaf, L.Matrix):
        on, to = ("w_i", "w_j") if adjoint else ("w_j", "w_i")
        return _sum(df.join(w, F.col(axis) == F.col(on)).selectExpr(*keys, f"{to} AS {axis}", *_times(wr, wi, df, leaf.dtype)), axis)
    if isinstance(leaf, L.Tensor):
        return _tensor(leaf.turned() if adjoint else leaf, df, w, wr, wi, axis)
    raise OperatorError(f"no rule for {type(leaf).__name__}")


def _tensor(t: L.Tensor, df: DataFrame, w: DataFrame, wr: str, wi: str, axis: str) -> DataFrame:
    keys = _quoted(keys_of(df, axis))
    named = lambda k, axes, index, shape: [f"{e} AS `{k}_{n}`" for n, e in zip(axes, axis_exprs(index, shape))]
    x = df.selectExpr(*keys, *named("x", t.input_axes, axis, t.input_shape), "re", *(["im"] if has_im(df) else []))
    w = w.selectExpr(*named("w", t.weight_axes, "w_i", t.weight_shape), "w_re", "w_im")
    if N.parameter_bytes(t) <= N.BROADCAST_BYTES:
        w = F.broadcast(w)
    on = [F.col(f"x_{n}") == F.col(f"w_{n}") for n in t.input_axes if n in t.weight_axes]
    if not on:  # an outer product has a term for every pair: each value meets the weight block by block
        first = f"w_{t.weight_axes[0]}" if t.weight_axes else "0"
        blocks = 1 if N.parameter_bytes(t) <= N.BROADCAST_BYTES else (t.weight_shape or (1,))[0]
        x, w = x.withColumn("x_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), w.withColumn("w_block", F.expr(f"CAST({first} % {blocks} AS INT)"))
        on = [F.col("x_block") == F.col("w_block")]
    joined = x.join(w, on)
    to = flat_expr([f"`{'w' if n in t.weight_axes else 'x'}_{n}`" for n in t.target_axes], t.target_shape)
    return _sum(joined.selectExpr(*keys, f"{to} AS {axis}", *_times(wr, wi, df, t.dtype)), axis)


def twiddles(spark, n: int, outputs: int, sign: int, scale: float = 1.0) -> DataFrame:
    """``(t_k, t_j, t_c, t_s)``: scaled cosine and signed sine of 2 pi k j / n for every output k and input j."""
    angle = f"({2 * np.pi / n!r}D * (((id DIV {n}) * (id % {n})) % {n}))"
    t = spark.range(outputs * n).selectExpr(f"CAST(id DIV {n} AS INT) AS t_k", f"CAST(id % {n} AS INT) AS t_j", f"{scale!r}D * cos({angle}) AS t_c", f"{sign * scale!r}D * sin({angle}) AS t_s")
    return _maybe_broadcast(t, outputs * n)


def _fourier(op: L.Fourier, df: DataFrame, inverse: bool, axis: str = "idx") -> DataFrame:
    n, keys = op.n, _quoted(keys_of(df, axis))
    if not n:
        return df if is_complex(op.dtype) or not inverse else df.drop("im")
    if n > op.piece:
        return _factorised(op, df, inverse, axis)
    if n > TWIDDLE_LENGTH:
        return _fibres(op.adjoint() if inverse else op, df, axis)
    scale = float(1 / np.sqrt(n) if op.norm == "ortho" else 1 / n if inverse else 1.0)
    # coefficients are on the input side of the inverse; one kind of table serves, read the other way round
    on, to = ("t_k", "t_j") if inverse else ("t_j", "t_k")
    terms = df.join(twiddles(df.sparkSession, n, op.range, 1 if inverse else -1, scale), F.col(axis) == F.col(on))
    if inverse and not is_complex(op.dtype):
        # a half spectrum: all but the first and, for even n, the last coefficient stand for two
        value = [f"CASE WHEN t_k = 0 OR t_k * 2 = {n} THEN 1D ELSE 2D END * (t_c * re - t_s * im) AS re"]
    else:
        value = _times("t_c", "t_s", df, op.rdt)
    return _sum(terms.selectExpr(*keys, f"{to} AS {axis}", *value), axis)


def _factorised(op: L.Fourier, df: DataFrame, inverse: bool, axis: str) -> DataFrame:
    """A transform of length n1 n2 in fibres of n1 and n2: position j = j1 n2 + j2 is transformed along j1, turned by the angle
    of j2 k1 / n, transformed along j2, and lands at k1 + n1 k2. No row holds more than a piece of the axis."""
    n, wide = op.n, is_complex(op.dtype)
    n1 = next((k for k in range(min(op.piece, n), 1, -1) if n % k == 0), 1)
    if n1 == 1:
        raise OperatorError(f"{n} has no factor of {op.piece} or less")
    n2, keys = n // n1, keys_of(df, axis)
    q = _quoted(keys)
    if not has_im(df):
        df = df.selectExpr(*q, axis, "re", "0D AS im")
    if inverse and not wide:  # the other half of the spectrum is the mirrored conjugate
        both = f"array(struct({axis} AS k, im AS im), struct(CAST({n} - {axis} AS {index_type(n)}) AS k, -im AS im))"
        df = df.selectExpr(*q, "re", f"explode(IF({axis} = 0 OR {axis} * 2 = {n}, slice({both}, 1, 1), {both})) AS k_").selectExpr(*q, f"k_.k AS {axis}", "re", "k_.im AS im")
    df, (a1, a2) = split_axis(df, axis, [n1, n2])
    step = lambda d, m, a: _fourier(L.Fourier(m, complex_of(op.dtype), piece=op.piece), d, inverse, a) if m > op.piece else _fibres(L.Fourier(m, complex_of(op.dtype)).H if inverse else L.Fourier(m, complex_of(op.dtype)), d, a)
    df = step(df, n1, a1)
    turn = f"({(2 if inverse else -2) * np.pi / n!r}D * ((CAST({a1} AS LONG) * {a2}) % {n}))"
    df = df.selectExpr(*q, a1, a2, "re", "im", f"cos({turn}) AS t_c", f"sin({turn}) AS t_s")
    df = step(df.selectExpr(*q, a1, a2, "re * t_c - im * t_s AS re", "re * t_s + im * t_c AS im"), n2, a2)
    by = (float(np.sqrt(n)) if inverse else float(1 / np.sqrt(n))) if op.norm == "ortho" else 1.0
    kind = index_type(n)
    df = df.selectExpr(*q, f"CAST({a1} + CAST({a2} AS LONG) * {n1} AS {kind}) AS {axis}", f"re * {by!r}D AS re", f"im * {by!r}D AS im")
    if not wide:
        df = df.drop("im") if inverse else df.where(f"{axis} <= {n // 2}")
    return df


def _fibres(op: Operator, df: DataFrame, axis: str) -> DataFrame:
    """``op`` in NumPy on each fibre along ``axis``; the other axes are keys like any others."""
    keys = keys_of(df, axis)
    out = long_of(_fast(op, df.selectExpr(*_quoted(keys), f"{axis} AS idx", *_values(df))))
    return out.selectExpr(*_quoted(keys), f"idx AS {axis}", *_values(out))


#: Restrictions of so many ranges at most are expressions; more are joined with a table of positions.
MAX_CASES = 32


def _restriction(op: L.Restriction, df: DataFrame, adjoint: bool, axis: str = "idx") -> DataFrame:
    """Rows moved. Positions that a scatter leaves empty are zero, and get rows at the end of ``apply``, if they can be seen there."""
    # a gather may read one position for several ranges; a scatter sends each to one place
    out = moved(df, op.scattered() if adjoint else op.gathered(), axis, op.n if adjoint else op.range, not adjoint and not op.disjoint())
    return _sum(out, axis) if adjoint and op.accumulate and not op.disjoint() else out


def moved(df: DataFrame, moves: list[tuple[int, int, int]], axis: str, n: int, several: bool) -> DataFrame:
    """Rows moved by ranges ``(a, b, to)`` to positions below ``n``; ``several``: a position may be in more than one range."""
    keys, values, kind = _quoted(keys_of(df, axis)), _values(df), index_type(n)
    if len(moves) > MAX_CASES:
        return _moved(df, moves, axis, kind)
    shifted = [f"CASE WHEN {axis} BETWEEN {a} AND {b - 1} THEN CAST({axis} + {to - a} AS {kind}) END" for a, b, to in moves] or [f"CAST(NULL AS {kind})"]
    hits = f"explode(filter(array({', '.join(shifted)}), x -> x IS NOT NULL))" if several else f"coalesce({', '.join(shifted)})"
    return df.selectExpr(*keys, f"{hits} AS {axis}", *values).where(F.col(axis).isNotNull())


def _moved(df: DataFrame, moves: list[tuple[int, int, int]], axis: str, kind: str) -> DataFrame:
    """Rows moved by many ranges ``(a, b, to)``: each range stands in the buckets of positions that it touches, and a row
    looks up its own. Buckets are as wide as ranges are long on average, so there are some three rows a range, and no row for a position."""
    keys, values = _quoted(keys_of(df, axis)), _values(df)
    a, b, to = np.array(moves, np.int64).T
    width = max(1, int((b - a).sum()) // len(a))
    n = (b - 1) // width - a // width + 1
    which = np.repeat(np.arange(len(a)), n)
    bucket = (a // width)[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    ranges = df.sparkSession.createDataFrame(pa.table({"r_bucket": bucket, "r_a": a[which], "r_b": b[which], "r_by": (to - a)[which]}))
    on = (F.expr(f"CAST({axis} AS LONG) DIV {width}") == F.col("r_bucket")) & (F.col(axis) >= F.col("r_a")) & (F.col(axis) < F.col("r_b"))
    return df.join(_maybe_broadcast(ranges, len(which)), on).selectExpr(*keys, f"CAST({axis} + r_by AS {kind}) AS {axis}", *values)


def _shows_gaps(op: Operator) -> bool:
    """Whether the output may lack rows for positions that are zero because nothing was scattered there."""
    if isinstance(op, N.Compose):
        for o in op.ops:  # the last one first
            if _sums(o):
                return False
            if _shows_gaps(o):
                return True
        return False
    if isinstance(op, N.Adjoint) and isinstance(op.op, L.Restriction):
        r = op.op
        return bool(r.n) and (not r.disjoint() or r.range != r.n)
    return any(map(_shows_gaps, op.children))


#: Zeros that come with one row at most.
ZEROS = 1 << 12


def _empty_ranges(r: L.Restriction) -> list[tuple[int, int]]:
    """Positions that a scatter leaves empty, as ranges."""
    out, at = [], 0
    for to, end in [*sorted((to, to + b - a) for a, b, to in r.scattered()), (r.n, r.n)]:
        if to > at:
            out.append((at, to))
        at = max(at, end)
    return out


def _spreads(op: Operator) -> bool:
    """Whether ``op`` is a scatter of few ranges, to one place each, with few zeros for each row."""
    if not (isinstance(op, N.Adjoint) and isinstance(op.op, L.Restriction)):
        return False
    r = op.op
    moves, empty = r.scattered(), _empty_ranges(r)
    rows = sum(b - a for a, b, _ in moves)
    return 0 < len(moves) <= MAX_CASES and len(empty) <= MAX_CASES and (r.disjoint() or not r.accumulate) and sum(b - a for a, b in empty) <= ZEROS * rows


def _spread(r: L.Restriction, df: DataFrame) -> DataFrame:
    """A scatter of complete items, row by row: each moved row brings its share of the zeros, every so-manieth one."""
    keys, values, kind = _quoted(keys_of(df)), _values(df), index_type(r.n)
    moves, empty = r.scattered(), _empty_ranges(r)
    rows, zeros = sum(b - a for a, b, _ in moves), sum(b - a for a, b in empty)
    place, number, at = [], [], 0
    for a, b, to in moves:
        here = f"WHEN idx BETWEEN {a} AND {b - 1} THEN"
        place.append(f"{here} CAST(idx + {to - a} AS {kind})")
        number.append(f"{here} CAST(idx + {at - a} AS LONG)")
        at += b - a
    df = df.selectExpr(*keys, f"CASE {' '.join(place)} END AS idx", f"CASE {' '.join(number)} END AS number_", *values).where("idx IS NOT NULL")
    if not zeros:
        return df.drop("number_")
    goes, at = [], 0
    for a, b in empty:
        goes.append(f"WHEN z < {at + b - a} THEN CAST(z + {a - at} AS {kind})")
        at += b - a
    zero = ", ".join(f"'{v}', 0D" for v in values)
    more = f"IF(number_ < {zeros}, transform(sequence(number_, {zeros - 1}L, {rows}L), z -> named_struct('idx', CASE {' '.join(goes)} END, {zero})), array())"
    return df.selectExpr(*keys, f"inline(concat(array(struct(idx, {', '.join(values)})), {more})) AS (idx, {', '.join(values)})")


#: Words of 64 positions that one row is unfolded into at most.
WORDS = 1 << 20


def _filled(out: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """``out`` and a row of zeros for each of ``n`` positions that an item of ``items`` lacks.

    Only a bit a position is shuffled, in words of 64: each item begins with words of empty
    bits, its rows set theirs, and the bits that stay empty become rows. Values stay where they are, and no item is gathered.
    """
    keys, values = _quoted(keys_of(out)), _values(out)
    word, bits = "word", "bits"
    while {word, bits} & {*out.columns}:
        word, bits = f"{word}_", f"{bits}_"
    words, beyond = max(1, -(-n // 64)), -(1 << n % 64) if n % 64 else 0  # bits beyond the last position count as set
    if words == 1:
        begun = items.selectExpr(*keys, f"0L AS {word}", f"{beyond}L AS {bits}")
    else:
        begun = items.selectExpr(*keys).distinct() if keys else items.limit(1).select()
        if words > WORDS:
            begun = begun.selectExpr(*keys, f"explode(sequence(0L, {(words - 1) // WORDS}L)) AS {bits}")
            begun = begun.selectExpr(*keys, f"explode(sequence({bits} * {WORDS}, least({bits} * {WORDS} + {WORDS - 1}, {words - 1}L))) AS {word}")
        else:
            begun = begun.selectExpr(*keys, f"explode(sequence(0L, {words - 1}L)) AS {word}")
        begun = begun.selectExpr(*keys, word, f"IF({word} = {words - 1}, {beyond}L, 0L) AS {bits}")
    # the value is looked at so that both readers of ``out`` ask for the same columns, and its exchanges serve both
    seen = out.selectExpr(*keys, f"CAST(idx DIV 64 AS LONG) AS {word}", f"IF(re IS NULL, 0L, shiftleft(1L, CAST(idx % 64 AS INT))) AS {bits}")
    empty = begun.unionAll(seen).groupBy(*keys, word).agg(F.bit_or(bits).alias(bits)).where(f"{bits} <> -1")
    free = f"IF({bits} = 0, sequence(0, 63), filter(sequence(0, 63), k -> (shiftrightunsigned({bits}, k) & 1L) = 0))"
    free = empty.selectExpr(*keys, word, f"explode({free}) AS {bits}")
    return out.unionByName(free.selectExpr(*keys, f"CAST({word} * 64 + {bits} AS {index_type(n)}) AS idx", *[f"0D AS {v}" for v in values]))


def _values(df: DataFrame) -> list[str]:
    return [c for c in ("re", "im") if c in df.columns]


def _sums(op: Operator) -> bool:
    """Whether every output of ``op`` is a sum over its inputs, so that zeros among these need no rows."""
    if isinstance(op, N.Compose):
        return _sums(op.ops[-1])
    if isinstance(op, N.Kron):
        return all(map(_sums, op.ops))
    if isinstance(op, (N.Adjoint, N.Bound, N.Broadcasted)):
        return _sums(op.op)
    return isinstance(op, (L.Matrix, L.Fourier)) and bool(op.n)


def split_axis(df: DataFrame, axis: str, sizes: list[int]) -> tuple[DataFrame, list[str]]:
    """The flat index ``axis`` as a column for each of ``sizes``, the last one fastest."""
    keys, mark = keys_of(df, axis), "axis"
    while any(c.startswith(f"{mark}_") for c in [axis, *keys]):  # a product within a product, or a key of that name
        mark += "_"
    axes = [f"{mark}_{k}" for k in range(len(sizes))]
    split = axis_exprs(axis, tuple(sizes[::-1]))[::-1]
    return df.selectExpr(*_quoted(keys), *[f"{e} AS {a}" for e, a in zip(split, axes)], *_values(df)), axes


def join_axis(df: DataFrame, axes: list[str], sizes: list[int], axis: str) -> DataFrame:
    """Columns of ``split_axis`` as one flat index again."""
    keys = [c for c in df.columns if c not in (*axes, "re", "im")]
    return df.selectExpr(*_quoted(keys), f"{flat_expr(axes[::-1], tuple(sizes[::-1]))} AS {axis}", *_values(df))


def _kron(op: N.Kron, df: DataFrame, axis: str = "idx") -> DataFrame:
    """The flat index falls apart into one column an axis, once; each operand then works on its own."""
    sizes = [o.domain for o in op.ops]
    out, axes = split_axis(df, axis, sizes)
    for k in op.order:
        out = _long(op.ops[k], out, axes[k])
        sizes[k] = op.ops[k].range
    return join_axis(out, axes, sizes, axis)


def _reduce(df: DataFrame, axis: str = "idx") -> DataFrame:
    """The sum over the key ``rank``, on every rank again; of arrays where rows are DENSE."""
    if "rank" not in df.columns:
        raise OperatorError("a reduction needs the key column rank")
    ranks = df.select("rank").distinct().agg(F.sort_array(F.collect_list("rank")).alias("ranks"))  # one number a worker
    total = tiles.summed(df.drop("rank")) if is_dense(df) else _sum(df.drop("rank"), axis)
    out = total.crossJoin(F.broadcast(ranks)).withColumn("rank", F.explode("ranks"))  # one row of ranks
    return out.select(*_quoted(df.columns))


def _repartition(op: L.Repartition, df: DataFrame, axis: str = "idx") -> DataFrame:
    """Each block in the partition of its worker, exactly."""
    out = df.withColumn("rank", rank_of(axis, op.shape, op.grid_out))
    return out.repartitionById(prod(op.grid_out), F.col("rank")).select(*_quoted(df.columns))


def _long(op: Operator, df: DataFrame, axis: str = "idx") -> DataFrame:
    """``op`` along the index column ``axis``; all other columns but the values are keys."""
    if isinstance(op, N.Compose):
        for k in reversed(range(len(op.ops))):
            if k and isinstance(op.ops[k], L.Repartition):
                continue  # what follows deals rows by its own keys, so only a last placement can be seen
            df = _long(op.ops[k], df, axis)
        return df
    if isinstance(op, N.Kron):
        return _kron(op, df, axis)
    if isinstance(op, (N.Broadcasted, N.Distributed)):
        return _long(op.op, df, axis)
    if isinstance(op, L.Identity):
        return df
    if isinstance(op, N.Bound):
        return _bound(op, df, False, axis)
    if isinstance(op, L.Fourier):
        return _fourier(op, df, False, axis)
    if isinstance(op, L.Restriction):
        return _restriction(op, df, False, axis)
    if isinstance(op, L.Reduce):
        return _reduce(df, axis)
    if isinstance(op, L.Repartition):
        return _repartition(op, df, axis)
    if isinstance(op, N.Adjoint):
        inner = op.op
        if isinstance(inner, N.Bound):
            return _bound(inner, df, True, axis)
        if isinstance(inner, L.Fourier):
            return _fourier(inner, df, True, axis)
        if isinstance(inner, L.Restriction):
            return _restriction(inner, df, True, axis)
        return _long(inner.adjoint(), df, axis)
    raise OperatorError(f"no rule for {type(op).__name__}")


# --- element-wise forms of single leaves ---------------------------------


def add_bias(op: Operator, df: DataFrame) -> DataFrame:
    """``x + A`` or, for an adjoint, ``x + A'``: a parameter of one column is added to every item, any other
    element by element to a batch of its shape, whose columns are the key ``j``."""
    if is_dense(df):
        return dense_of(add_bias(op, long_of(df)))
    turned = isinstance(op, N.Adjoint)
    w, wr, wi = _weight(op.op if turned else op, turned)
    i, j = ("w_j", "w_i") if turned else ("w_i", "w_j")
    on = [F.col("idx") == F.col(i)] + ([F.col("j") == F.col(j)] if op.domain > 1 or turned else [])
    return df.join(w, on).selectExpr(*_quoted(keys_of(df)), "idx", f"re + {wr} AS re", *([f"im + {wi} AS im"] if has_im(df) else []))


def ieee_divide(a: Column, b: Column) -> Column:
    """Division of doubles with infinities and NaN instead of an error."""
    inf = F.lit(float("inf"))
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when((a > 0) == b.cast("string").startswith("-"), -inf).otherwise(inf)
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def divide_by(op: N.Bound, df: DataFrame) -> DataFrame:
    """``A / x`` element by element, for a real matrix of the shape of the batch (key ``j``: the column)."""
    if is_dense(df):
        return dense_of(divide_by(op, long_of(df)))
    w, wr, _ = _weight(op, False)
    out = df.join(w, (F.col("idx") == F.col("w_i")) & (F.col("j") == F.col("w_j")))
    return out.select(*_quoted(keys_of(df)), "idx", ieee_divide(F.col(wr), F.col("re")).alias("re"))


def scale_rows(op: N.Bound, df: DataFrame) -> DataFrame:
    """Each row of the batch times its element of the diagonal, from either side."""
    return apply(op, df) if is_dense(df) else _bound(op, df, False)


# --- DENSE ----------------------------------------------------------------


def gathered(op: Operator) -> dict[str, np.ndarray]:
    """Values of all bound leaves as arrays on the driver, one job a table; refused above the broadcast limit, all together."""
    if tiles.parameter_total(op) > N.BROADCAST_BYTES:
        raise OperatorError("the parameters of the tree are too large to send to every task")
    tables: dict[int, tuple[DataFrame, dict[str, Operator]]] = {}

    def visit(o: Operator) -> None:
        if isinstance(o, N.Bound):
            tables.setdefault(id(o.params), (o.params, {}))[1][o.op.op_id] = o.op
        else:
            for c in o.children:
                visit(c)

    visit(op)
    out: dict[str, np.ndarray] = {}
    for params, slots in tables.values():
        rows = params.where(F.col("op_id").isin(list(slots))).select("op_id", "i", "j", "re", "im")
        if sum(prod(leaf.shape) for leaf in slots.values()) <= SMALL_CELLS:  # values that stand in the plan come without a job
            columns = list(zip(*rows.collect())) or [()] * 5
            t = pa.table({c: pa.array(v, k) for c, v, k in zip(rows.columns, columns, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))})
        else:
            t = rows.toArrow()
        names = t.column("op_id").combine_chunks().dictionary_encode()
        which, known = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
        i, j, re, im = (t.column(c).to_numpy() for c in ("i", "j", "re", "im"))
        for op_id, leaf in slots.items():
            here = which == known.index(op_id) if op_id in known else np.zeros(len(which), bool)
            kind = np.complex128 if is_complex(leaf.dtype) else np.float64
            w = np.zeros((leaf.m, leaf.n) if isinstance(leaf, L.Matrix) else prod(leaf.shape), kind)
            at = (i[here], j[here]) if w.ndim == 2 else i[here]
            w[at] = re[here] + 1j * im[here] if kind is np.complex128 else re[here]
            out[op_id] = w
    return out


def _stripped(op: Operator) -> Operator:
    """The tree without references to DataFrames, to be sent to tasks."""
    if isinstance(op, N.Bound):
        return op.op
    if isinstance(op, N.Adjoint):
        return N.Adjoint(_stripped(op.op))
    if isinstance(op, (N.Broadcasted, N.Distributed)):
        return _stripped(op.op)
    if isinstance(op, N.Compose):
        return N.Compose(tuple(_stripped(c) for c in op.ops))
    if isinstance(op, N.Kron):
        return N.Kron(tuple(_stripped(c) for c in op.ops), op.order)
    return op


def evaluate(op: Operator, x: np.ndarray, values: dict[str, np.ndarray]) -> np.ndarray:
    """``op`` along the last axis of ``x``, in NumPy."""
    if isinstance(op, N.Compose):
        for o in reversed(op.ops):
            x = evaluate(o, x, values)
        return x
    if isinstance(op, N.Kron):
        head = x.shape[:-1]
        x = x.reshape(*head, *(o.domain for o in op.ops))
        for k in op.order:
            at = len(head) + k
            x = np.moveaxis(evaluate(op.ops[k], np.moveaxis(x, at, -1), values), -1, at)
        return x.reshape(*head, -1)
    if isinstance(op, N.Adjoint):
        return _evaluate_leaf(op.op, x, values, True)
    return _evaluate_leaf(op, x, values, False)


def _evaluate_leaf(op: Operator, x: np.ndarray, values: dict[str, np.ndarray], adjoint: bool) -> np.ndarray:
    if isinstance(op, L.Diagonal):
        w = values[op.op_id]
        return x * (w.conj() if adjoint else w)
    if isinstance(op, L.Matrix):
        w = values[op.op_id]
        return x @ (w.conj() if adjoint else w.T)
    if isinstance(op, L.Fourier):
        if not op.n:
            return x
        if is_complex(op.dtype):
            return (np.fft.ifft if adjoint else np.fft.fft)(x, op.n, norm=op.norm)
        return np.fft.irfft(x, op.n, norm=op.norm) if adjoint else np.fft.rfft(x, op.n, norm=op.norm)
    if isinstance(op, L.Restriction):
        return scatter(op, x) if adjoint else gather(op, x)
    if isinstance(op, L.Tensor):
        t = op.turned() if adjoint else op
        letter = {a: chr(97 + k) for k, a in enumerate(t.sizes)}
        name = lambda axes: "".join(letter[a] for a in axes[::-1])  # noqa: E731  first axis fastest
        w = values[op.op_id].reshape(t.weight_shape[::-1])
        lead = x.reshape(-1, *t.input_shape[::-1])
        y = np.einsum(f"Z{name(t.input_axes)},{name(t.weight_axes)}->Z{name(t.target_axes)}", lead, w.conj() if adjoint else w)
        return y.reshape(*x.shape[:-1], -1)
    if isinstance(op, (L.Identity, L.Repartition)):
        return x
    raise OperatorError(f"no dense rule for {type(op).__name__}")


def gather(op: L.Restriction, x: np.ndarray) -> np.ndarray:
    """The elements at the ranges, along the last axis."""
    return np.concatenate([x[..., a:b] for a, b, _ in op.gathered()] or [x[..., :0]], axis=-1)


def scatter(op: L.Restriction, x: np.ndarray) -> np.ndarray:
    """Into zeros along the last axis; where ranges overlap, the last one wins or values add up."""
    out = np.zeros((*x.shape[:-1], op.n), x.dtype)
    for a, b, to in op.scattered():
        if op.accumulate:
            out[..., to : to + b - a] += x[..., a:b]
        else:
            out[..., to : to + b - a] = x[..., a:b]
    return out


def rows_of(column: pa.Array, n: int, fibres: bool, what: str = "re") -> np.ndarray:
    """One row an item from a column without null rows: arrays of ``n`` values, or with ``fibres`` arrays of ``(idx, value)``."""
    ends = column.offsets.to_numpy()
    if fibres:
        cells = column.values.slice(ends[0], ends[-1] - ends[0])
        out = np.zeros(len(column) * n)
        row = np.repeat(np.arange(len(column)), np.diff(ends))
        np.add.at(out, row * n + cells.field("idx").to_numpy(zero_copy_only=False), cells.field(what).to_numpy(zero_copy_only=False))
        return out.reshape(len(column), n)
    if (np.diff(ends) != n).any():
        raise OperatorError(f"a row has {next(k for k in np.diff(ends).tolist() if k != n)} elements where the operator takes {n}")
    cells = column.values.slice(ends[0], ends[-1] - ends[0])
    if cells.null_count:
        raise OperatorError("a value is null")
    return cells.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), n)


def items(df: DataFrame) -> DataFrame:
    """LONG items as one row each: ``(keys..., cells array<struct<idx, re[, im]>>)``, in no order."""
    return df.groupBy(*_quoted(keys_of(df))).agg(F.collect_list(F.struct("idx", *_values(df))).alias("cells")).where("size(cells) > 0")


def slices(batch: pa.RecordBatch, n: int):
    """Parts of a batch of about ``BATCH_CELLS`` elements, for items of ``n``."""
    step = max(1, BATCH_CELLS // max(n, 1))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def _fast(op: Operator, df: DataFrame) -> DataFrame:
    """DENSE result from a DENSE or LONG table. A null array stays null."""
    if tiles.whole(op):
        tree = _stripped(op)
        return by_items(op, df, partial(evaluate, tree), tree.domain, is_complex(op.ddt), is_complex(op.rdt))
    if not is_dense(df):
        n, same = _stripped(op).domain, lambda x, values: x
        df = by_items(L.Identity(n, op.ddt), df, same, n, is_complex(op.ddt), is_complex(op.ddt))
    for o, lead, trail in tiles.axis_steps(op):
        if isinstance(o, L.Reduce):
            df = _reduce(df)
        elif tiles.whole(o):
            tree = _stripped(o)
            rule = partial(_along, tree=tree, lead=lead, trail=trail)
            df = by_items(o, df, rule, lead * tree.domain * trail, is_complex(o.ddt), is_complex(o.rdt), lead * trail)
        else:
            bound, adjoint = tiles.matrix_of(o)
            df = tiles.product(bound, df, adjoint, lead, trail)
    return df


def _along(x: np.ndarray, values: dict[str, np.ndarray], tree: Operator, lead: int, trail: int) -> np.ndarray:
    """``tree`` along the middle axis of rows of ``lead`` x n x ``trail`` elements."""
    y = evaluate(tree, np.moveaxis(x.reshape(len(x), lead, -1, trail), 2, -1), values)
    return np.moveaxis(y, -1, 2).reshape(len(x), -1)


def by_items(op: Operator, df: DataFrame, rule, length: int, into: bool, out_of: bool, copies: int = 1) -> DataFrame:
    """``rule(rows, values of op)`` on batches of the items of a DENSE or LONG table, of ``length`` elements each, as a DENSE
    table; ``into`` and ``out_of`` say whether input and output are complex, ``copies`` how often an item has the operator's axis."""
    keys, values, fibres, widest = keys_of(df), gathered(op), not is_dense(df), max(_widest(_stripped(op)), 1) * copies
    shared = df.sparkSession.sparkContext.broadcast(values)  # checked by gathered()

    def step(batches, n: int):
        for batch in batches:
            for part in slices(batch, widest):
                whole = np.ones(part.num_rows, bool)
                for k in range(n, part.num_columns):
                    whole &= part.column(k).is_valid().to_numpy(zero_copy_only=False)
                given = part if whole.all() else part.filter(pa.array(whole))
                x = rows_of(given.column(n), length, fibres)
                if into:
                    x = x + 1j * (rows_of(given.column(n), length, True, "im") if fibres else rows_of(given.column(n + 1), length, False))
                y = rule(x, values=shared.value)
                ends = np.concatenate([[0], np.cumsum(whole * y.shape[-1])]).astype(np.int32)
                kinds = [y.real, y.imag] if out_of else [y.real]
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(v).ravel()), mask=None if whole.all() else pa.array(~whole)) for v in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *lists], [*keys, "re", *(["im"] if out_of else [])])

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in (["re", "im"] if out_of else ["re"])])
    given = items(df) if fibres else df.select(*_quoted(keys), "re", *(["im"] if into else []))
    return given.mapInArrow(partial(step, n=len(keys)), schema)
