"""Parameters as one table ``(op_id, i, j, re, im)``: initial values, arithmetic, updates.

A matrix has its rows in ``i`` and columns in ``j``; diagonals and tensors have their
flat index (first axis fastest) in ``i`` and 0 in ``j``.
"""

from __future__ import annotations

from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leaves as L
from ..operators.base import Operator, OperatorError
from ..plans.types import is_complex

#: Positions of generated parameters up to this number are rows of the plan, whose values need no job.
LOCAL_CELLS = 1 << 14
SCHEMA = "op_id string, i int, j int, re double, im double"


def from_arrays(spark: SparkSession, values: dict[str, np.ndarray]) -> DataFrame:
    """A table of small parameters given as arrays: two axes for matrices, else one; tensors with their first axis fastest."""
    rows = []
    for op_id, w in values.items():
        w = np.asarray(w)
        two = w if w.ndim == 2 else w.reshape(-1, order="F")[:, None]
        rows += [(op_id, i, j, float(np.real(v)), float(np.imag(v))) for (i, j), v in np.ndenumerate(two)]
    return spark.createDataFrame(rows, SCHEMA)


def generated(spark: SparkSession, leaf: Operator, re, im=None) -> DataFrame:
    """The parameter of a leaf from column functions of ``(i, j)``, made on the executors, or a small one while it is planned."""
    m, n = leaf.shape if isinstance(leaf, L.Matrix) else (prod(leaf.shape), 1)
    if 0 < m * n <= LOCAL_CELLS:
        i, j = np.divmod(np.arange(m * n, dtype=np.int32), n)
        cells = spark.createDataFrame(pa.table({"i": i, "j": j}))
    else:
        i, j = F.floor(F.col("id") / max(n, 1)).cast("int"), (F.col("id") % max(n, 1)).cast("int")
        cells = spark.range(0, m * n, 1, max(1, m * n >> 16)).select(i.alias("i"), j.alias("j"))
    value = lambda f: f(F.col("i"), F.col("j")).cast("double") if f else F.lit(0.0)
    return cells.select(F.lit(leaf.op_id).alias("op_id"), "i", "j", value(re).alias("re"), value(im).alias("im"))


def init(spark: SparkSession, *ops: Operator, seed: int = 0) -> DataFrame:
    """Random initial values of all parametric leaves, alike for equal ids and seeds.

    Matrices: zero if they have one column (a bias); else uniform around zero of
    width sqrt(24 / (m + n)), or for complex ones uniform over 1 / sqrt(m n).
    Diagonals: uniform in [0, 1). Tensors: uniform over the root of their size.
    """
    out = spark.createDataFrame([], SCHEMA)
    slots: dict[str, Operator] = {}
    for op in ops:
        for op_id, leaf in op.slots().items():
            if slots.setdefault(op_id, leaf).shape != leaf.shape:
                raise OperatorError(f"two shapes for the parameter {op_id!r}")

    def draw(op_id: str, part: int):
        def uniform(i: Column, j: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(op_id), F.lit(seed), F.lit(part), i, j), 11)
            return bits.cast("double") / float(1 << 53)

        return uniform

    for op_id, leaf in slots.items():
        re, im = draw(op_id, 0), draw(op_id, 1) if is_complex(leaf.dtype) else None
        if isinstance(leaf, L.Matrix):
            if leaf.n == 1:
                re = im = None
            elif is_complex(leaf.dtype):
                re, im = (_scaled(f, 1 / float(np.sqrt(max(leaf.m * leaf.n, 1)))) for f in (re, im))
            else:
                re = _scaled(re, float(np.sqrt(24 / (leaf.m + leaf.n))), 0.5)
        elif isinstance(leaf, L.Tensor):
            by = 1 / float(np.sqrt(max(prod(leaf.shape), 1)))
            re, im = _scaled(re, by), _scaled(im, by) if im else None
        out = out.unionByName(generated(spark, leaf, re, im))
    return out


def _scaled(f, by: float, less: float = 0.0):
    return lambda i, j: (f(i, j) - less) * by


def merge(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Element-wise ``+ - * /`` or ``^`` on ids that both have; elements of one side only pass unchanged, even for ``-``."""
    key = ["op_id", "i", "j"]
    x, y = ((F.col(f"{t}.re"), F.col(f"{t}.im")) for t in "ab")
    (ar, ai), (br, bi) = x, y
    both = {
        "+": lambda: (ar + br, ai + bi),
        "-": lambda: (ar - br, ai - bi),
        "*": lambda: (ar * br - ai * bi, ar * bi + ai * br),
        "/": lambda: _quotient(ar, ai, br, bi),
        "^": lambda: _power(ar, ai, br, bi),
    }.get(op)
    if both is None:
        raise OperatorError(f"no arithmetic {op!r}")
    re, im = both()
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    pick = lambda k, v, w, r: F.when(F.col("a.op_id").isNull(), w).when(F.col("b.op_id").isNull(), v).otherwise(r).alias(k)
    joined = a.alias("a").join(b.alias("b"), on, "full")
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], pick("re", ar, br, re), pick("im", ai, bi, im))


def _quotient(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    """Real values divide as IEEE doubles; complex ones with the larger part of the divisor scaled to 1, so nothing overflows on the way."""
    from ..plans.lower import ieee_divide

    real = (ai == 0) & (bi == 0)
    flat = F.abs(br) >= F.abs(bi)
    r = F.when(flat, ieee_divide(bi, br)).otherwise(ieee_divide(br, bi))
    below = F.when(flat, br + bi * r).otherwise(br * r + bi)
    re = F.when(flat, ar + ai * r).otherwise(ar * r + ai)
    im = F.when(flat, ai - ar * r).otherwise(ai * r - ar)
    return F.when(real, ieee_divide(ar, br)).otherwise(ieee_divide(re, below)), F.when(real, F.lit(0.0)).otherwise(ieee_divide(im, below))


def _power(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    """Real values by ``pow`` (NaN for a broken power of a negative number), complex ones in polar form; 0 to the power 0 is 1."""
    real = (ai == 0) & (bi == 0)
    size, angle = F.hypot(ar, ai), F.atan2(ai, ar)
    log = F.log(F.when(size > 0, size).otherwise(F.lit(1.0)))
    length, turn = F.exp(br * log - bi * angle), br * angle + bi * log
    zero = F.when((br == 0) & (bi == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    re = F.when(real, F.pow(ar, br)).when(size == 0, zero).otherwise(length * F.cos(turn))
    return re, F.when(real | (size == 0), F.lit(0.0)).otherwise(length * F.sin(turn))


def update(params: DataFrame, gradients: DataFrame) -> DataFrame:
    """``params - gradients``; a gradient without parameter is taken over as it is."""
    return merge(params, gradients, "-")


def scale(a: float, params: DataFrame) -> DataFrame:
    return params.select("op_id", "i", "j", (F.col("re") * a).alias("re"), (F.col("im") * a).alias("im"))
