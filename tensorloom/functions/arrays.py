"""Array views on LONG tables: index arithmetic, no data moves. The first axis of a shape is the fastest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.grid import axis_exprs, flat_expr


def rotate_axes(df: DataFrame, shape: tuple[int, ...], by: int) -> tuple[DataFrame, tuple[int, ...]]:
    """Axes turned cyclically: axis ``by`` of the input becomes the first. Batch keys stay. Also the new shape."""
    n = len(shape)
    axes = axis_exprs("idx", shape)
    turn = [(k + by) % n for k in range(n)]
    out = tuple(shape[k] for k in turn)
    return df.withColumn("idx", F.expr(flat_expr([axes[k] for k in turn], out))), out


def as_matrix(df: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """The first axis stays in ``idx``; all others become the batch key ``col``."""
    head = shape[0] if shape else 1
    return df.withColumn("col", F.floor(F.col("idx") / head).cast("int")).withColumn("idx", (F.col("idx") % head).cast("int"))


def from_matrix(df: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """Undoes ``as_matrix`` for an array of ``shape``."""
    head = shape[0] if shape else 1
    return df.withColumn("idx", (F.col("idx") + F.col("col") * head).cast("int")).drop("col")


def zeros_like(df: DataFrame) -> DataFrame:
    """The same positions, all zero."""
    return df.withColumns({c: F.lit(0.0) for c in ("re", "im") if c in df.columns})


def zeros(keys: DataFrame, n: int, is_complex: bool = False) -> DataFrame:
    """A vector of zeros for each row of ``keys``."""
    idx = F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>"))
    return keys.select(*keys.columns, idx.alias("idx"), F.lit(0.0).alias("re"), *([F.lit(0.0).alias("im")] if is_complex else []))


def gelu(x: Column) -> Column:
    """Gaussian error linear unit in its hyperbolic tangent form."""
    return x * 0.5 * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))



def cpu(params: DataFrame) -> DataFrame:
    """Parameters are tables, so they have no device: this and ``gpu`` return them as they are."""
    return params


gpu = cpu
