"""Queries over the driver's tables, one or more for each operator, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.gradients import gather_gradients, grad_input, grad_params, pullback
from .functions.params import generated, merge, scale, update
from .operators import leaves as L
from .operators import nodes as N
from .plans.chunks import chunked, matrix_blocks, moved_blocks, rotated_blocks
from .plans.distribute import distribute
from .plans.grid import block_of, cumulative_ranges, rank_of
from .plans.lower import add_bias, divide_by, has_im, keys_of, long_of, scale_rows
from .plans.rewrite import Optimizer, merkle_hash, transforms
from .plans.tiles import generated_tiles, tiled
from .sources import tables
from .sources.json_codec import from_json, to_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Deterministic parameters.
W = lambda i, j: (7 * i + 3 * j) % 11 - 5
V = lambda i, j: (5 * i + 2 * j) % 7 - 3
D = lambda i, j: (3 * i) % 5 - 2
E = lambda i, j: (2 * i) % 7 - 3


def _params(spark, *leaves, re=W, im=None) -> DataFrame:
    out = None
    for leaf in leaves:
        kind = D if isinstance(leaf, L.Diagonal) and re is W else re
        p = generated(spark, leaf, kind, im if leaf.dtype[0] == "c" else None)
        out = p if out is None else out.unionByName(p)
    return out


def _rounded(c: str, bits: int) -> Column:
    """To the nearest multiple of ``2**-bits``: finer than the dyadic inputs and results, so none of these lies between two of them."""
    return F.rint(F.col(c) * 2.0**bits) / 2.0**bits


def _out(df: DataFrame, bits: int = 0) -> DataFrame:
    """Columns in order, without negative zeros; values after trigonometric steps are rounded to ``bits`` binary places."""
    value = lambda c: ((_rounded(c, bits) if bits else F.col(c)) + F.lit(0.0)).alias(c)
    return df.select(*keys_of(df), F.col("idx").cast("int").alias("idx"), value("re"), *([value("im")] if has_im(df) else []))


# Common table expressions.
_L = "l AS (SELECT b, CAST(idx AS INTEGER) AS idx, floor(CAST(e AS DOUBLE) * 1024) / 1024 AS re, label FROM (SELECT vec_id AS b, label, unnest(range(0, 64)) AS idx, unnest(embedding) AS e FROM embeddings))"
_Z = "z AS (SELECT x.b, x.idx, x.re, y.re AS im FROM l x JOIN l y ON x.b = y.b AND y.idx = x.idx + 32 WHERE x.idx < 32)"


def _w(name: str, m: int, n: int, im: bool = False) -> str:
    imag = ", CAST((5 * i + 2 * j) % 7 - 3 AS DOUBLE) AS wi" if im else ""
    return f"{name} AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST((7 * i + 3 * j) % 11 - 5 AS DOUBLE) AS w{imag} FROM range({m}) a(i), range({n}) c(j))"


def _d(n: int, im: bool = False) -> str:
    imag = ", CAST((2 * i) % 7 - 3 AS DOUBLE) AS wi" if im else ""
    return f"d AS (SELECT CAST(i AS INTEGER) AS i, CAST((3 * i) % 5 - 2 AS DOUBLE) AS w{imag} FROM range({n}) a(i))"


_I = "CAST(i AS INTEGER) AS idx"


@_query(f"WITH {_L} SELECT b, idx, re + 0.0 AS re FROM l")
def identity_apply(spark, d):
    return _out(L.Identity(64).apply(tables.vectors(spark, d)))


def _complex_diagonal(spark):
    leaf = L.Diagonal(32, "d", "c64")
    return leaf.bind(generated(spark, leaf, D, E))


@_query(f"WITH {_L}, {_Z}, {_d(32, True)} SELECT b, idx, w * re - wi * im + 0.0 AS re, w * im + wi * re + 0.0 AS im FROM z JOIN d ON idx = i")
def diagonal_apply(spark, d):
    return _out(_complex_diagonal(spark).apply(tables.complex_vectors(spark, d)))


@_query(f"WITH {_L}, {_Z}, {_d(32, True)} SELECT b, idx, w * re + wi * im + 0.0 AS re, w * im - wi * re + 0.0 AS im FROM z JOIN d ON idx = i")
def diagonal_adjoint(spark, d):
    return _out(_complex_diagonal(spark).H.apply(tables.complex_vectors(spark, d)))


def _matrix(spark, m, n, dtype="f64", op_id="W"):
    leaf = L.Matrix(m, n, op_id, dtype)
    return leaf.bind(_params(spark, leaf, im=V))


@_query(f"WITH {_L}, {_w('w', 8, 64)} SELECT b, {_I}, sum(w * re) + 0.0 AS re FROM l JOIN w ON idx = j GROUP BY b, i")
def matrix_apply(spark, d):
    return _out(_matrix(spark, 8, 64).apply(tables.vectors(spark, d, deal=True)))


@_query(f"WITH {_L}, {_w('w', 8, 64)} SELECT b, {_I}, sum(w * re) + 0.0 AS re FROM l JOIN w ON idx = j GROUP BY b, i")
def matrix_apply_dense(spark, d):
    """The same by NumPy on Arrow batches."""
    from .plans.lower import long_of

    return _out(long_of(_matrix(spark, 8, 64).apply(tables.dense_vectors(spark, d))))


@_query(f"WITH {_L}, {_Z}, {_w('w', 32, 16, True)} SELECT b, CAST(j AS INTEGER) AS idx, sum(w * re + wi * im) + 0.0 AS re, sum(w * im - wi * re) + 0.0 AS im FROM z JOIN w ON idx = i GROUP BY b, j")
def matrix_adjoint(spark, d):
    return _out(_matrix(spark, 32, 16, "c64").H.apply(tables.complex_vectors(spark, d, deal=True)))


@_query(f"WITH {_L}, {_Z}, {_w('w', 32, 16, True)} SELECT b, CAST(j AS INTEGER) AS idx, sum(w * re - wi * im) + 0.0 AS re, sum(w * im + wi * re) + 0.0 AS im FROM z JOIN w ON idx = i GROUP BY b, j")
def matrix_rapply(spark, d):
    return _out(_matrix(spark, 32, 16, "c64").rapply(tables.complex_vectors(spark, d, deal=True)))


@_query(f"WITH {_L}, {_w('w', 8, 64)} SELECT b, label, {_I}, sum(w * re) + 0.0 AS re FROM l JOIN w ON idx = j GROUP BY b, label, i")
def matrix_batched3(spark, d):
    return _out(_matrix(spark, 8, 64).apply(tables.vectors(spark, d, "label", deal=True)))


@_query(f"WITH {_L}, {_w('w', 64, 1)} SELECT b, idx, re + w + 0.0 AS re FROM l JOIN w ON idx = i")
def matrix_bias(spark, d):
    return _out(add_bias(_matrix(spark, 64, 1), tables.vectors(spark, d)))


@_query(f"WITH {_L}, {_w('w', 8, 64)} SELECT b, CAST(b % 8 AS INTEGER) AS j, idx, re + w + 0.0 AS re FROM l JOIN w ON b % 8 = i AND idx = w.j")
def matrix_bias_adjoint(spark, d):
    x = tables.vectors(spark, d).withColumn("j", (F.col("b") % 8).cast("int"))
    return _out(add_bias(_matrix(spark, 8, 64).H, x))


@_query(f"WITH {_L}, {_d(64)} SELECT b, idx, w * re + 0.0 AS re FROM l JOIN d ON idx = i")
def diagonal_scale_rows(spark, d):
    leaf = L.Diagonal(64, "d")
    return _out(scale_rows(leaf.bind(_params(spark, leaf)), tables.vectors(spark, d)))


@_query(f"WITH {_L}, {_w('w', 64, 8)} SELECT b, CAST(b % 8 AS INTEGER) AS j, idx, CASE WHEN re != 0 THEN w / re WHEN w = 0 THEN 'nan'::DOUBLE WHEN w > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END + 0.0 AS re FROM l JOIN w ON idx = i AND b % 8 = j")
def matrix_divide(spark, d):
    x = tables.vectors(spark, d).withColumn("j", (F.col("b") % 8).cast("int"))
    return _out(divide_by(_matrix(spark, 64, 8), x))


@_query(f"WITH {_L}, {_w('w', 16, 80)} SELECT b, CAST(i - 4 AS INTEGER) AS idx, sum(w * re) + 0.0 AS re FROM l JOIN w ON idx = j - 8 WHERE i >= 4 AND i < 12 GROUP BY b, i")
def matrix_slice(spark, d):
    return _out(_matrix(spark, 16, 80)[4:12, 8:72].apply(tables.vectors(spark, d, deal=True)))


_SIN = "2 * pi() * ((k * {j}) % {n}) / {n}"


@_query(f"WITH {_L} SELECT b, CAST(k AS INTEGER) AS idx, round((sum(re * cos({_SIN.format(j='idx', n=64)}))) * pow(2, 20)) / pow(2, 20) + 0.0 AS re, round((sum(-re * sin({_SIN.format(j='idx', n=64)}))) * pow(2, 20)) / pow(2, 20) + 0.0 AS im FROM l, range(33) t(k) GROUP BY b, k")
def rdft_apply(spark, d):
    return _out(L.Fourier(64, "f64").apply(tables.vectors(spark, d, deal=True)), 20)


@_query(f"WITH {_L}, {_Z}, t AS (SELECT k, idx AS j, cos({_SIN.format(j='idx', n=32)}) AS c, sin({_SIN.format(j='idx', n=32)}) AS s FROM range(32) a(k), range(32) e(idx)) SELECT b, CAST(k AS INTEGER) AS idx, round((sum(re * c + im * s)) * pow(2, 20)) / pow(2, 20) + 0.0 AS re, round((sum(im * c - re * s)) * pow(2, 20)) / pow(2, 20) + 0.0 AS im FROM z JOIN t ON idx = j GROUP BY b, k")
def cdft_apply(spark, d):
    return _out(L.Fourier(32).apply(tables.complex_vectors(spark, d, deal=True)), 20)


@_query(f"WITH {_L}, {_Z}, t AS (SELECT k, idx AS j, cos({_SIN.format(j='idx', n=32)}) AS c, sin({_SIN.format(j='idx', n=32)}) AS s FROM range(32) a(k), range(32) e(idx)) SELECT b, CAST(k AS INTEGER) AS idx, round((sum(re * c - im * s) / 32) * pow(2, 20)) / pow(2, 20) + 0.0 AS re, round((sum(im * c + re * s) / 32) * pow(2, 20)) / pow(2, 20) + 0.0 AS im FROM z JOIN t ON idx = j GROUP BY b, k")
def icdft(spark, d):
    return _out(L.Fourier(32).H.apply(tables.complex_vectors(spark, d, deal=True)), 20)


@_query(f"WITH {_L}, {_Z}, h AS (SELECT b, idx % 17 AS idx, sum(re) AS re, sum(im) AS im FROM z GROUP BY ALL) SELECT b, CAST(k AS INTEGER) AS idx, round((sum((CASE WHEN idx IN (0, 16) THEN 1 ELSE 2 END) * (re * cos({_SIN.format(j='idx', n=32)}) - im * sin({_SIN.format(j='idx', n=32)}))) / 32) * pow(2, 20)) / pow(2, 20) + 0.0 AS re FROM h, range(32) t(k) GROUP BY b, k")
def irdft(spark, d):
    half = tables.folded(tables.complex_vectors(spark, d, deal=True), 17)
    return _out(L.Fourier(32, "f64").H.apply(half), 20)


_ENDS = L.Restriction(64, ((0, 8), (56, 64)))


@_query(f"WITH {_L} SELECT b, CAST(CASE WHEN idx < 8 THEN idx ELSE idx - 48 END AS INTEGER) AS idx, re + 0.0 AS re FROM l WHERE idx < 8 OR idx >= 56")
def restrict_gather(spark, d):
    return _out(_ENDS.apply(tables.vectors(spark, d)))


@_query(f"WITH {_L} SELECT b, idx, CASE WHEN idx < 8 OR idx >= 56 THEN re ELSE 0 END + 0.0 AS re FROM l")
def restrict_scatter(spark, d):
    return _out(N.compose(_ENDS.H, _ENDS).apply(tables.vectors(spark, d, deal=True), complete=True))


@_query(ORACLE_SQL["restrict_scatter"])
def restrict_scatter_words(spark, d):
    """The same without knowing that items are complete: empty positions are found by bits."""
    return _out(N.compose(_ENDS.H, _ENDS).apply(tables.vectors(spark, d, deal=True)))


_OVER = L.Restriction(64, ((0, 20), (10, 30)))


@_query(f"WITH {_L} SELECT b, CAST(p AS INTEGER) AS idx, coalesce(re, 0.0) + 0.0 AS re FROM (SELECT b, p, CASE WHEN p < 10 THEN p WHEN p < 30 THEN p + 10 END AS q FROM (SELECT DISTINCT b FROM l), range(64) t(p)) LEFT JOIN (SELECT b AS b2, idx % 40 AS idx, sum(re) AS re FROM l GROUP BY ALL) ON b = b2 AND idx = q")
def restrict_scatter_overlap(spark, d):
    """Overlapping ranges: the last one wins."""
    return _out(_OVER.H.apply(tables.folded(tables.vectors(spark, d, deal=True), 40)))


def _tensor_query(weight: str, shape: tuple[int, ...], source: str, target: str):
    size = dict(zip(weight, shape))
    leaf = L.Tensor(tuple(weight), shape, tuple(source), tuple(size[a] for a in source), tuple(target), tuple(size[a] for a in target), "T")

    def axes(names: str, index: str) -> str:
        out, below = [], 1
        for a in names:
            out.append(f"CAST(floor({index} / {below}) AS BIGINT) % {size[a]} AS {index[0]}_{a}")
            below *= size[a]
        return ", ".join(out)

    to, below = [], 1
    for a in target:
        to.append(f"{'w' if a in weight else 'x'}_{a} * {below}")
        below *= size[a]
    on = " AND ".join(f"w_{a} = x_{a}" for a in source if a in weight)
    sql = f"WITH {_L}, x AS (SELECT b, re, {axes(source, 'xi')} FROM (SELECT b, sum(re) AS re, idx % {leaf.domain} AS xi FROM l GROUP BY b, xi)), w AS (SELECT CAST((7 * wi) % 11 - 5 AS DOUBLE) AS w, {axes(weight, 'wi')} FROM range({int(np.prod(shape))}) t(wi)) SELECT b, CAST({' + '.join(to)} AS INTEGER) AS idx, sum(w * re) + 0.0 AS re FROM x JOIN w ON {on} GROUP BY ALL"

    def run(spark, d):
        x = tables.folded(tables.vectors(spark, d, deal=True), leaf.domain)
        return _out(leaf.bind(_params(spark, leaf)).apply(x))

    return run, sql


for _name, _case in {
    "tensor4": ("iotp", (4, 3, 4, 4), "itp", "otp"),
    "tensor5": ("oixyt", (3, 4, 2, 4, 2), "ixyt", "oxyt"),
    "tensor6": ("oixyzt", (3, 2, 2, 4, 2, 2), "ixyzt", "oxyzt"),
}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _tensor_query(*_case)


@_query(f"WITH {_L}, s AS (SELECT idx, sum(re) AS re FROM l GROUP BY idx), r AS (SELECT DISTINCT CAST(b % 8 AS INTEGER) AS rank FROM l) SELECT rank, idx, re + 0.0 AS re FROM s, r")
def reduce_sum(spark, d):
    x = tables.vectors(spark, d).select((F.col("b") % 8).cast("int").alias("rank"), "idx", "re")
    return _out(L.Reduce().apply(x))


@_query(f"WITH {_L} SELECT CAST((CASE WHEN idx % 4 < 2 THEN 0 ELSE idx % 4 - 1 END) * 2 + ((idx // 4) % 4) // 2 AS INTEGER) AS rank, count(*) AS n, sum(re) + 0.0 AS re FROM l GROUP BY 1")
def repartition_blocks(spark, d):
    """Elements and sums of each worker after a move to a grid of 3 x 2 x 1."""
    from .plans.grid import rank_of

    op = L.Repartition((4, 4, 4), (2, 2, 2), (3, 2, 1))
    x = op.apply(tables.vectors(spark, d))
    rank = rank_of("idx", op.shape, op.grid_out)
    return x.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"), (F.sum("re") + F.lit(0.0)).alias("re"))


def _chain(spark):
    a, g, c = L.Matrix(8, 16, "A"), L.Diagonal(16, "g"), L.Matrix(16, 64, "C")
    return N.compose(a, g, c).bind(_params(spark, a, g, c))


@_query(f"WITH {_L}, {_w('w', 16, 64)}, {_w('v', 8, 16)}, {_d(16)}, y AS (SELECT b, i, sum(w * re) AS re FROM l JOIN w ON idx = j GROUP BY b, i), g AS (SELECT b, y.i AS i, w * re AS re FROM y JOIN d ON y.i = d.i) SELECT b, CAST(v.i AS INTEGER) AS idx, sum(w * re) + 0.0 AS re FROM g JOIN v ON g.i = v.j GROUP BY b, v.i")
def compose_chain(spark, d):
    return _out(_chain(spark).apply(tables.vectors(spark, d, deal=True)))


@_query(f"WITH {_L}, {_w('w', 16, 64)}, {_w('v', 8, 16)}, {_d(16)}, y AS (SELECT b, j AS i, sum(w * re) AS re FROM l JOIN v ON idx % 8 = i GROUP BY b, j), g AS (SELECT b, y.i AS i, w * re AS re FROM y JOIN d ON y.i = d.i) SELECT b, CAST(w.j AS INTEGER) AS idx, sum(w * re) + 0.0 AS re FROM g JOIN w ON g.i = w.i GROUP BY b, w.j")
def compose_adjoint(spark, d):
    return _out(_chain(spark).H.apply(tables.folded(tables.vectors(spark, d, deal=True), 8)))


def _product(spark, *sizes):
    leaves = [L.Matrix(m, n, f"K{k}") for k, (m, n) in enumerate(sizes)]
    return N.kron(*leaves).bind(_params(spark, *leaves))


_K2 = f"WITH {_L}, {_w('p', 4, 8)}, {_w('q', 3, 8)} SELECT b, CAST(p.i * 3 + q.i AS INTEGER) AS idx, sum(p.w * q.w * re) + 0.0 AS re FROM l JOIN p ON idx // 8 = p.j JOIN q ON idx % 8 = q.j GROUP BY b, p.i, q.i"


@_query(_K2)
def kron2(spark, d):
    return _out(_product(spark, (4, 8), (3, 8)).apply(tables.vectors(spark, d, deal=True)))


@_query(_K2)
def kron2_dense(spark, d):
    from .plans.lower import long_of

    return _out(long_of(_product(spark, (4, 8), (3, 8)).apply(tables.dense_vectors(spark, d))))


_K3 = f"WITH {_L}, {_w('p', 2, 4)}, {_w('q', 3, 4)}, {_w('r', 5, 4)} SELECT b, CAST((p.i * 3 + q.i) * 5 + r.i AS INTEGER) AS idx, sum(p.w * q.w * r.w * re) + 0.0 AS re FROM l JOIN p ON idx // 16 = p.j JOIN q ON (idx // 4) % 4 = q.j JOIN r ON idx % 4 = r.j GROUP BY b, p.i, q.i, r.i"


@_query(_K3)
def kron3(spark, d):
    return _out(_product(spark, (2, 4), (3, 4), (5, 4)).apply(tables.vectors(spark, d, deal=True)))


@_query(_K3)
def kron3_optimized(spark, d):
    """The same product in the order that the optimizer finds."""
    return _out(Optimizer(_product(spark, (2, 4), (3, 4), (5, 4))).run().apply(tables.vectors(spark, d, deal=True)))


@_query(f"WITH {_L}, {_w('p', 4, 6)}, {_w('q', 4, 3)}, {_w('r', 4, 2)} SELECT b, CAST((p.j * 3 + q.j) * 2 + r.j AS INTEGER) AS idx, sum(p.w * q.w * r.w * re) + 0.0 AS re FROM l JOIN p ON idx // 16 = p.i JOIN q ON (idx // 4) % 4 = q.i JOIN r ON idx % 4 = r.i GROUP BY b, p.j, q.j, r.j")
def kron_adjoint(spark, d):
    return _out(_product(spark, (4, 6), (4, 3), (4, 2)).H.apply(tables.vectors(spark, d, deal=True)))


@_query("SELECT CAST(64 AS BIGINT) * count(*) AS n, CAST(0 AS BIGINT) AS bad FROM embeddings")
def kron_orders_agree(spark, d):
    """Elements of all orders of a product of three, and how many of them differ from the first order's."""
    op, x = _product(spark, (4, 4), (4, 4), (4, 4)), tables.vectors(spark, d, deal=True)
    orders = [(0, 1, 2), (1, 2, 0), (2, 0, 1)]
    out = None
    for k, order in enumerate(orders):
        y = op.with_order(order).apply(x).withColumnRenamed("re", f"r{k}")
        out = y if out is None else out.join(y, ["b", "idx"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("r0") != F.col("r1")) | (F.col("r0") != F.col("r2"))).cast("bigint")).alias("bad"))


@_query(f"WITH {_L}, y AS (SELECT b, idx // 8 AS a, k, sum(re * cos({_SIN.format(j='(idx % 8)', n=8)})) AS re, sum(-re * sin({_SIN.format(j='(idx % 8)', n=8)})) AS im FROM l, range(5) t(k) GROUP BY b, a, k), t AS (SELECT k AS m, j, cos({_SIN.format(j='j', n=8)}) AS c, sin({_SIN.format(j='j', n=8)}) AS s FROM range(8) p(k), range(8) q(j)) SELECT b, CAST(m * 5 + k AS INTEGER) AS idx, round((sum(re * c + im * s)) * pow(2, 20)) / pow(2, 20) + 0.0 AS re, round((sum(im * c - re * s)) * pow(2, 20)) / pow(2, 20) + 0.0 AS im FROM y JOIN t ON a = j GROUP BY b, m, k")
def kron_mixed_type(spark, d):
    """Two-dimensional transform of real 8 x 8 arrays: the real axis goes first."""
    op = N.kron(L.Fourier(8, "c64"), L.Fourier(8, "f64"))
    return _out(op.apply(tables.vectors(spark, d, deal=True)), 20)


@_query(_K2)
def distributed_kron(spark, d):
    """The product as repartitions and local steps on a grid of 2 x 4 workers."""
    op = distribute(N.kron(L.Matrix(4, 8, "K0"), L.Matrix(3, 8, "K1")), (4, 2))
    return _out(op.bind(_params(spark, L.Matrix(4, 8, "K0"), L.Matrix(3, 8, "K1"))).apply(tables.vectors(spark, d, deal=True)))


@_query(_K2)
def broadcast_kron(spark, d):
    """The product with its parameters marked to be whole on every worker."""
    return _out(N.broadcasted(N.kron(L.Matrix(4, 8, "K0"), L.Matrix(3, 8, "K1"))).bind(_params(spark, L.Matrix(4, 8, "K0"), L.Matrix(3, 8, "K1"))).apply(tables.vectors(spark, d, deal=True)))


@_query(f"WITH {_L} SELECT b, idx, re + 0.0 AS re FROM l")
def distributed_identity(spark, d):
    """Local identities on a grid of 1 x 2 x 1 leave everything where it is."""
    op = distribute(N.kron(*[L.Identity(4, "f64") for _ in range(3)]), (1, 2, 1))
    return _out(N.Distributed(op, 0, 1).apply(tables.vectors(spark, d)))


def _two_tables(spark, d):
    """Parameters from nations (all) and regions (twice their key), which share the ids 0 to 4, and one id of regions alone."""
    n = tables.read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("op_id"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("n_regionkey").cast("double").alias("re"), F.lit(0.0).alias("im"))
    r = tables.read(spark, d, "region").select(F.when(F.col("r_regionkey") == 4, "only").otherwise(F.col("r_regionkey").cast("string")).alias("op_id"), F.lit(0).alias("i"), F.lit(0).alias("j"), (F.col("r_regionkey") * 2 + 1).cast("double").alias("re"), F.lit(0.0).alias("im"))
    return n, r


_TWO = "n AS (SELECT CAST(n_nationkey AS VARCHAR) AS op_id, CAST(n_regionkey AS DOUBLE) AS re FROM nation), r AS (SELECT CASE WHEN r_regionkey = 4 THEN 'only' ELSE CAST(r_regionkey AS VARCHAR) END AS op_id, CAST(r_regionkey * 2 + 1 AS DOUBLE) AS re FROM region)"


def _merge_sql(op: str) -> str:
    return f"WITH {_TWO} SELECT coalesce(n.op_id, r.op_id) AS op_id, CASE WHEN n.op_id IS NULL THEN r.re WHEN r.op_id IS NULL THEN n.re ELSE n.re {op} r.re END + 0.0 AS re FROM n FULL JOIN r ON n.op_id = r.op_id"


def _merged(op: str):
    def run(spark, d):
        return merge(*_two_tables(spark, d), op).select("op_id", (F.col("re") + F.lit(0.0)).alias("re"))

    return run


for _name, _op in {"params_add": "+", "params_merge": "-", "params_multiply": "*", "params_divide": "/", "params_power": "^"}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _merged(_op), _merge_sql(_op)


@_query(_merge_sql("-"))
def params_update(spark, d):
    return update(*_two_tables(spark, d)).select("op_id", (F.col("re") + F.lit(0.0)).alias("re"))


@_query(f"WITH {_TWO} SELECT op_id, re * 2.5 + 0.0 AS re FROM n")
def params_scale(spark, d):
    return scale(2.5, _two_tables(spark, d)[0]).select("op_id", (F.col("re") + F.lit(0.0)).alias("re"))


def _step(spark, d):
    a = _matrix(spark, 8, 64)
    x = tables.vectors(spark, d, deal=True)
    return a, x, a.apply(x)


@_query(f"WITH {_L}, {_w('w', 8, 64)}, y AS (SELECT b, i, sum(w * re) AS re FROM l JOIN w ON idx = j GROUP BY b, i) SELECT CAST(i AS INTEGER) AS i, CAST(idx AS INTEGER) AS j, sum(y.re * l.re) + 0.0 AS re FROM y JOIN l USING (b) GROUP BY i, idx")
def grad_matrix(spark, d):
    a, x, y = _step(spark, d)
    return grad_params(a, x, y).select("i", "j", (F.col("re") + F.lit(0.0)).alias("re"))


@_query(f"WITH {_L}, {_w('w', 8, 64)}, y AS (SELECT b, i, sum(w * re) AS re FROM l JOIN w ON idx = j GROUP BY b, i) SELECT b, CAST(j AS INTEGER) AS idx, sum(w * re) + 0.0 AS re FROM y JOIN w USING (i) GROUP BY b, j")
def grad_of_input(spark, d):
    a, _, y = _step(spark, d)
    return _out(grad_input(a, y))


@_query(f"WITH {_L} SELECT b, idx, CASE WHEN idx < 8 OR idx >= 56 THEN re ELSE 0 END + 0.0 AS re FROM l")
def pullback_restriction(spark, d):
    """The gradient of a restriction's input is scattered into zeros."""
    return _out(grad_input(_ENDS, _ENDS.apply(tables.vectors(spark, d, deal=True))))


@_query(f"WITH {_L} SELECT b, CAST(CASE WHEN idx < 8 THEN idx ELSE idx - 48 END AS INTEGER) AS idx, re + 0.0 AS re FROM l WHERE idx < 8 OR idx >= 56")
def pullback_scatter(spark, d):
    """The gradient of a scatter's input is gathered."""
    return _out(grad_input(_ENDS.H, tables.vectors(spark, d)))


@_query(f"WITH {_L} SELECT b, idx, re + 0.0 AS re FROM l")
def pullback_repartition(spark, d):
    """The gradient goes back to where the input came from; a reduction's passes unchanged."""
    moved = grad_input(L.Repartition((4, 4, 4), (2, 2, 2), (3, 2, 1)), tables.vectors(spark, d))
    return _out(grad_input(L.Reduce(), moved))


@_query(f"WITH {_L}, {_d(64)} SELECT CAST(i AS INTEGER) AS i, sum(w * re * re) + 0.0 AS re FROM l JOIN d ON idx = i GROUP BY i")
def grad_diagonal(spark, d):
    leaf = L.Diagonal(64, "d")
    a, x = leaf.bind(_params(spark, leaf)), tables.vectors(spark, d)
    return grad_params(a, x, a.apply(x)).select("i", (F.col("re") + F.lit(0.0)).alias("re"))


@_query(f"WITH {_L}, y AS (SELECT b % 4 AS worker, idx, sum(re) AS re FROM l GROUP BY 1, 2) SELECT idx AS i, sum(re) + 0.0 AS re FROM y GROUP BY idx")
def grad_gather(spark, d):
    """Shares of four workers in the gradient of one replicated parameter."""
    shares = tables.vectors(spark, d).groupBy((F.col("b") % 4).alias("worker"), F.col("idx").alias("i")).agg(F.sum("re").alias("re"))
    shares = shares.select(F.lit("d").alias("op_id"), "i", F.lit(0).alias("j"), "re", F.lit(0.0).alias("im"))
    return gather_gradients(shares).select("i", (F.col("re") + F.lit(0.0)).alias("re"))


@_query(f"WITH h AS (SELECT user_id AS b, CAST(date_part('hour', ts) AS INTEGER) AS h, sum(floor(coalesce(value, 0) * 1024) / 1024) AS v FROM events GROUP BY 1, 2) SELECT b, CAST(k AS INTEGER) AS idx, round((sum(v * cos({_SIN.format(j='h', n=24)}))) * pow(2, 14)) / pow(2, 14) + 0.0 AS re, round((sum(-v * sin({_SIN.format(j='h', n=24)}))) * pow(2, 14)) / pow(2, 14) + 0.0 AS im FROM h, range(13) t(k) GROUP BY b, k")
def events_hour_dft(spark, d):
    return _out(L.Fourier(24, "f64").apply(tables.hourly(spark, d)), 14)


def spectral_block(keep: int = 2):
    """Convolution in frequency space of 4 x 4 arrays with 4 channels (the fastest axis), and a direct channel mix."""
    transform = N.kron(L.Fourier(4, "f64"), L.Fourier(4, "c64"))
    low = N.kron(L.Restriction(3, ((0, keep),), "c64"), L.Restriction(4, ((0, keep),), "c64"))
    to_modes = N.kron_of([N.compose(low, transform), L.Identity(4, "f64")])
    weight = N.kron_of([L.Diagonal(keep * keep, "g", "c64"), L.Matrix(4, 4, "M", "c64")])
    return N.compose(to_modes.H, weight, to_modes)


def _block_sql() -> str:
    turn = lambda j, n: f"2 * pi() * ((k * {j}) % {n}) / {n}"
    return f"""WITH {_L}, {_w('w', 4, 4, True)}, {_w('u', 4, 4)}, {_d(4, True)},
x AS (SELECT b, idx // 16 AS t, (idx // 4) % 4 AS s, idx % 4 AS c, re FROM l),
f1 AS (SELECT b, k AS kt, s, c, sum(re * cos({turn('t', 4)})) AS re, sum(-re * sin({turn('t', 4)})) AS im FROM x, range(2) r(k) GROUP BY ALL),
f2 AS (SELECT b, kt, k AS ks, c, sum(re * cos({turn('s', 4)}) + im * sin({turn('s', 4)})) AS re, sum(im * cos({turn('s', 4)}) - re * sin({turn('s', 4)})) AS im FROM f1, range(2) r(k) GROUP BY ALL),
g AS (SELECT b, kt, ks, c, w * re - wi * im AS re, w * im + wi * re AS im FROM f2 JOIN d ON kt * 2 + ks = i),
m AS (SELECT b, kt, ks, i AS c, sum(w * re - wi * im) AS re, sum(w * im + wi * re) AS im FROM g JOIN w ON c = j GROUP BY ALL),
i2 AS (SELECT b, kt, k AS s, c, sum(re * cos({turn('ks', 4)}) - im * sin({turn('ks', 4)})) / 4 AS re, sum(im * cos({turn('ks', 4)}) + re * sin({turn('ks', 4)})) / 4 AS im FROM m, range(4) r(k) GROUP BY ALL)
SELECT b, CAST(k * 16 + s * 4 + c AS INTEGER) AS idx, round((sum((CASE WHEN kt = 0 THEN 1 ELSE 2 END) * (re * cos({turn('kt', 4)}) - im * sin({turn('kt', 4)}))) / 4) * pow(2, 20)) / pow(2, 20) + 0.0 AS re
FROM i2, range(4) r(k) GROUP BY b, k, s, c"""


@_query(_block_sql())
def spectral_convolution(spark, d):
    """The flagship: transforms, mode restriction, weights with channel mixing, and back."""
    leaves = [L.Diagonal(4, "g", "c64"), L.Matrix(4, 4, "M", "c64")]
    params = generated(spark, leaves[0], D, E).unionByName(generated(spark, leaves[1], W, V))
    return _out(spectral_block().bind(params).apply(tables.vectors(spark, d, deal=True)), 20)


@_query(_block_sql().replace("SELECT b, CAST(k * 16", "SELECT b, y AS idx, round((v * 0.5 * (1 + tanh(0.7978845608028654 * (v + 0.044715 * v * v * v)))) * pow(2, 20)) / pow(2, 20) + 0.0 AS re FROM (SELECT b, y, sum(v) AS v FROM (SELECT b, CAST(k * 16").replace(" AS INTEGER) AS idx, round((sum((CASE WHEN kt", " AS INTEGER) AS y, (sum((CASE WHEN kt").replace("/ 4) * pow(2, 20)) / pow(2, 20) + 0.0 AS re\nFROM i2", "/ 4) AS v\nFROM i2") + " UNION ALL SELECT b, CAST(t * 16 + s * 4 + i AS INTEGER) AS y, sum(u.w * re) AS v FROM x JOIN u ON c = j GROUP BY b, t, s, i) GROUP BY b, y)")
def spectral_layer(spark, d):
    """The spectral convolution plus a direct mix of channels, through an element-wise nonlinearity."""
    from .functions.arrays import gelu

    x = tables.vectors(spark, d, deal=True)
    leaves = [L.Diagonal(4, "g", "c64"), L.Matrix(4, 4, "M", "c64")]
    params = generated(spark, leaves[0], D, E).unionByName(generated(spark, leaves[1], W, V))
    mixed = N.kron(L.Identity(16), L.Matrix(4, 4, "U"))
    direct = mixed.bind(_params(spark, L.Matrix(4, 4, "U"))).apply(x)
    both = spectral_block().bind(params).apply(x).unionByName(direct)
    return _out(both.groupBy("b", "idx").agg(gelu(F.sum("re")).alias("re")), 20)


@_query(f"WITH {_L} SELECT b, CAST((idx // 4) % 2 + ((idx // 8) * 2) + (idx % 4) * 16 AS INTEGER) AS idx, re + 0.0 AS re FROM l")
def rotate_axes(spark, d):
    """The 64 values as 4 x 2 x 8, the second axis turned to the front."""
    from .functions.arrays import rotate_axes as turn

    return _out(turn(tables.vectors(spark, d), (4, 2, 8), 1)[0])


@_query(f"WITH {_L}, {_w('w', 3, 4)} SELECT b, CAST(idx // 4 AS INTEGER) AS col, {_I}, sum(w * re) + 0.0 AS re FROM l JOIN w ON idx % 4 = j GROUP BY b, col, i")
def as_matrix(spark, d):
    """The 64 values as a 4 x 16 matrix, each column multiplied."""
    from .functions.arrays import as_matrix as view

    return _out(_matrix(spark, 3, 4).apply(view(tables.vectors(spark, d), (4, 16))))


# --- layouts, odd items and the remaining forms ---------------------------

_RDFT = ORACLE_SQL["rdft_apply"]


@_query(_RDFT)
def rdft_dense(spark, d):
    """By a fast transform of arrays, one a row."""
    from .plans.lower import long_of

    return _out(long_of(L.Fourier(64, "f64").apply(tables.dense_vectors(spark, d))), 20)


@_query(_RDFT)
def rdft_twiddle(spark, d):
    """By a join with the table of twiddles, in DataFrame operations only."""
    return _out(L.Fourier(64, "f64").apply(tables.vectors(spark, d, deal=True), fast=False), 20)


@_query(f"WITH {_L}, p AS (SELECT b // 2 AS b, (b % 2) * 64 + idx AS idx, re FROM l) SELECT b, CAST(k AS INTEGER) AS idx, round((sum(re * cos({_SIN.format(j='idx', n=128)}))) * pow(2, 20)) / pow(2, 20) + 0.0 AS re, round((sum(-re * sin({_SIN.format(j='idx', n=128)}))) * pow(2, 20)) / pow(2, 20) + 0.0 AS im FROM p, range(65) t(k) GROUP BY b, k")
def rdft_fibres(spark, d):
    """Pairs of vectors end to end, too long for the table of twiddles: a fast transform of each fibre."""
    x = tables.vectors(spark, d)
    x = x.select(F.floor(F.col("b") / 2).alias("b"), (F.col("b") % 2 * 64 + F.col("idx")).cast("int").alias("idx"), "re")
    return _out(L.Fourier(128, "f64").apply(x, fast=False), 20)


@_query(f"WITH {_L}, f AS (SELECT b, idx % 16 AS idx, sum(re) AS re FROM l WHERE idx % 3 = 1 GROUP BY ALL) SELECT k.b, CAST(p AS INTEGER) AS idx, coalesce(re, 0.0) + 0.0 AS re FROM (SELECT DISTINCT b FROM f) k CROSS JOIN range(64) t(p) LEFT JOIN (SELECT b, CASE WHEN idx < 8 THEN idx ELSE idx + 48 END AS q, re FROM f WHERE idx % 3 = 1) f ON k.b = f.b AND p = q")
def scatter_sparse_items(spark, d):
    """Items that lack most positions, the first among them: all 64 come out, zeros where nothing was."""
    x = tables.folded(tables.vectors(spark, d).where("idx % 3 = 1"), 16)
    return _out(_ENDS.H.apply(x.where("idx % 3 = 1")))


@_query(f"WITH {_L} SELECT b, CASE WHEN b % 7 = 3 THEN -1 ELSE 64 END AS n, CASE WHEN b % 7 != 3 THEN sum(re) END AS re FROM l GROUP BY b")
def identity_dense_nulls(spark, d):
    """Items without an array keep none; no other item is touched."""
    x = tables.dense_vectors(spark, d).select("b", F.when(F.col("b") % 7 != 3, F.col("re")).alias("re"))
    y = L.Identity(64).apply(x)
    return y.select("b", F.coalesce(F.size("re"), F.lit(-1)).alias("n"), F.aggregate("re", F.lit(0.0), lambda s, v: s + v).alias("re"))


@_query(f"WITH {_L}, w AS (SELECT o, i, CAST((7 * (o + 3 * i)) % 11 - 5 AS DOUBLE) AS w FROM range(3) a(o), range(8) c(i)) SELECT b, CAST(idx // 8 + 8 * o AS INTEGER) AS idx, sum(w * re) + 0.0 AS re FROM l JOIN w ON idx % 8 = i GROUP BY b, l.idx // 8, o")
def tensor_einsum(spark, d):
    """A contraction in which one axis of the input is not in the weight: (o, i), (i, p) to (p, o)."""
    leaf = L.Tensor(("o", "i"), (3, 8), ("i", "p"), (8, 8), ("p", "o"), (8, 3), "T")
    return _out(leaf.bind(_params(spark, leaf)).apply(tables.vectors(spark, d, deal=True)))


@_query(f"WITH {_L}, w AS (SELECT o, CAST((7 * o) % 11 - 5 AS DOUBLE) AS w FROM range(3) a(o)) SELECT b, CAST(idx * 3 + o AS INTEGER) AS idx, sum(w * re) + 0.0 AS re FROM l, w GROUP BY b, l.idx, o")
def tensor_outer(spark, d):
    """An outer product: weight and input share no axis."""
    leaf = L.Tensor(("o",), (3,), ("i",), (64,), ("o", "i"), (3, 64), "T")
    return _out(leaf.bind(_params(spark, leaf)).apply(tables.vectors(spark, d, deal=True)))


@_query(f"WITH {_L}, {_w('w', 8, 64)}, f AS (SELECT b, idx % 8 AS idx, sum(re) AS re FROM l GROUP BY ALL) SELECT b, CAST(j AS INTEGER) AS idx, sum(w * re) + 0.0 AS re FROM f JOIN w ON idx = i GROUP BY b, j")
def bind_adjoint(spark, d):
    """An adjoint that gets its values after it was made."""
    leaf = L.Matrix(8, 64, "W")
    return _out(leaf.H.bind(_params(spark, leaf)).apply(tables.folded(tables.vectors(spark, d, deal=True), 8)))


@_query(f"WITH {_L} SELECT b, idx, CAST(0 AS DOUBLE) AS re FROM l")
def zeros_like_table(spark, d):
    from .functions.arrays import zeros_like

    return _out(zeros_like(tables.vectors(spark, d)))


@_query(f"WITH {_L}, f AS (SELECT b // 16 AS b, ((b % 16) * 64 + idx) % 1000 AS idx, sum(re) AS re FROM l GROUP BY ALL) SELECT CAST((idx % 10 // 5) * 4 + (idx // 10 % 10 // 5) * 2 + idx // 100 // 5 AS INTEGER) AS rank, count(*) AS n, sum(re) + 0.0 AS re FROM f GROUP BY 1")
def repartition_back(spark, d):
    """The adjoint of a move of 10 x 10 x 10 arrays from a grid of 2 x 2 x 2 workers to 8 x 1 x 1: back to the eight octants."""
    from .plans.grid import rank_of

    x = tables.vectors(spark, d)
    x = tables.folded(x.select(F.floor(F.col("b") / 16).alias("b"), (F.col("b") % 16 * 64 + F.col("idx")).alias("idx"), "re"), 1000)
    back = L.Repartition((10, 10, 10), (2, 2, 2), (8, 1, 1)).H
    y = back.apply(x)
    return y.groupBy(rank_of("idx", back.shape, back.grid_out).alias("rank")).agg(F.count(F.lit(1)).alias("n"), (F.sum("re") + F.lit(0.0)).alias("re"))


def _complex_tables(spark, d):
    n, r = _two_tables(spark, d)
    n = n.withColumn("im", F.when(F.length("op_id") == 1, F.col("op_id").cast("double")).otherwise(F.lit(0.0)))
    return n, r.withColumn("re", (F.col("re") + 1) / 2).withColumn("im", F.when(F.col("op_id") == "only", F.lit(0.0)).otherwise(F.col("op_id").try_cast("int") % 2))


_CTWO = f"{_TWO}, cn AS (SELECT op_id, re, CASE WHEN length(op_id) = 1 THEN CAST(op_id AS DOUBLE) ELSE 0 END AS im FROM n), cr AS (SELECT op_id, (re + 1) / 2 AS re, CASE WHEN op_id = 'only' THEN 0 ELSE CAST(TRY_CAST(op_id AS INTEGER) % 2 AS DOUBLE) END AS im FROM r), j AS (SELECT coalesce(cn.op_id, cr.op_id) AS op_id, cn.re AS ar, cn.im AS ai, cr.re AS br, cr.im AS bi FROM cn FULL JOIN cr ON cn.op_id = cr.op_id)"


def _complex_sql(re: str, im: str) -> str:
    pick = lambda a, b, both: f"round((CASE WHEN ar IS NULL THEN {b} WHEN br IS NULL THEN {a} ELSE {both} END) * pow(2, 20)) / pow(2, 20) + 0.0"
    return f"WITH {_CTWO} SELECT op_id, {pick('ar', 'br', re)} AS re, {pick('ai', 'bi', im)} AS im FROM j"


def _complex_merged(spark, d, op: str) -> DataFrame:
    value = lambda c: (_rounded(c, 20) + F.lit(0.0)).alias(c)
    return merge(*_complex_tables(spark, d), op).select("op_id", value("re"), value("im"))


_POLAR = "exp(br * ln(sqrt(ar * ar + ai * ai)) - bi * atan2(ai, ar))", "(br * atan2(ai, ar) + bi * ln(sqrt(ar * ar + ai * ai)))"


@_query(_complex_sql(f"CASE WHEN ai = 0 AND bi = 0 THEN pow(ar, br) ELSE {_POLAR[0]} * cos({_POLAR[1]}) END", f"CASE WHEN ai = 0 AND bi = 0 THEN 0 ELSE {_POLAR[0]} * sin({_POLAR[1]}) END"))
def params_power_complex(spark, d):
    return _complex_merged(spark, d, "^")


@_query(_complex_sql("(ar * br + ai * bi) / (br * br + bi * bi)", "(ai * br - ar * bi) / (br * br + bi * bi)"))
def params_divide_complex(spark, d):
    return _complex_merged(spark, d, "/")


@_query(f"WITH {_TWO} SELECT coalesce(n.op_id, r.op_id) AS op_id, CASE WHEN n.op_id IS NULL THEN 0 WHEN r.op_id IS NULL THEN n.re WHEN n.re = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END + 0.0 AS re FROM n FULL JOIN r ON n.op_id = r.op_id")
def params_divide_zero(spark, d):
    """Division by zero as IEEE doubles do it."""
    n, r = _two_tables(spark, d)
    return merge(n, r.withColumn("re", F.lit(0.0)), "/").select("op_id", (F.col("re") + F.lit(0.0)).alias("re"))


@_query(ORACLE_SQL["grad_matrix"])
def grad_null_key(spark, d):
    """Batch items that have a null in their key count like any others."""
    a, x, _ = _step(spark, d)
    x = x.withColumn("k", F.when(F.col("b") % 2 == 0, F.lit("x")))
    return grad_params(a, x, a.apply(x)).select("i", "j", (F.col("re") + F.lit(0.0)).alias("re"))


_GRAD = _block_sql()[: _block_sql().index(",\ni2 AS")].replace("\nm AS", "\nmx AS") + """,
up AS (SELECT b, kt, ks, c, (CASE WHEN kt = 0 THEN 1 ELSE 2 END) / 16.0 * re AS re, (CASE WHEN kt = 0 THEN 1 ELSE 2 END) / 16.0 * im AS im FROM f2),
mm AS (SELECT b, kt, ks, i AS c, sum(w * re - wi * im) AS re, sum(w * im + wi * re) AS im FROM f2 JOIN w ON c = j GROUP BY ALL),
r AS (SELECT 'g' AS op_id, CAST(up.kt * 2 + up.ks AS INTEGER) AS i, 0 AS j, sum(up.re * mm.re + up.im * mm.im) AS re, sum(up.im * mm.re - up.re * mm.im) AS im FROM up JOIN mm USING (b, kt, ks, c) GROUP BY up.kt, up.ks
      UNION ALL SELECT 'M', CAST(up.c AS INTEGER), CAST(g.c AS INTEGER), sum(up.re * g.re + up.im * g.im), sum(up.im * g.re - up.re * g.im) FROM up JOIN g USING (b, kt, ks) GROUP BY up.c, g.c)
SELECT op_id, i, j, round((re) * pow(2, 26)) / pow(2, 26) + 0.0 AS re, round((im) * pow(2, 26)) / pow(2, 26) + 0.0 AS im FROM r"""


@_query(_GRAD)
def grad_spectral_block(spark, d):
    """Gradients of the flagship's parameters, walked backwards through transforms, restrictions and products."""
    leaves = [L.Diagonal(4, "g", "c64"), L.Matrix(4, 4, "M", "c64")]
    params = generated(spark, leaves[0], D, E).unionByName(generated(spark, leaves[1], W, V))
    x = tables.dense_vectors(spark, d)
    value = lambda c: (_rounded(c, 26) + F.lit(0.0)).alias(c)
    return grad_params(spectral_block().bind(params), x, x).select("op_id", "i", "j", value("re"), value("im"))


@_query(f"WITH {_L}, y AS (SELECT b, k, sum(re * cos({_SIN.format(j='idx', n=64)})) AS re, sum(-re * sin({_SIN.format(j='idx', n=64)})) AS im FROM l, range(33) t(k) GROUP BY b, k) SELECT b, CAST(j AS INTEGER) AS idx, round((sum(re * cos({_SIN.format(j='j', n=64)}) - im * sin({_SIN.format(j='j', n=64)}))) * pow(2, 20)) / pow(2, 20) + 0.0 AS re FROM y, range(64) u(j) GROUP BY b, j")
def pullback_transform(spark, d):
    """The derivative of a real transform at its own output: each stored coefficient counts once, nothing is divided."""
    f = L.Fourier(64, "f64")
    return _out(pullback(f, f.apply(tables.vectors(spark, d, deal=True))), 20)


def _two_range_sql() -> str:
    turn = lambda j: f"2 * pi() * ((k * {j}) % 8) / 8"
    return f"""WITH {_L}, x AS (SELECT b, idx // 8 AS t, idx % 8 AS s, re FROM l),
f1 AS (SELECT b, k AS kt, s, sum(re * cos({turn('t')})) AS re, sum(-re * sin({turn('t')})) AS im FROM x, range(3) r(k) GROUP BY ALL),
f2 AS (SELECT b, kt, k AS ks, sum(re * cos({turn('s')}) + im * sin({turn('s')})) AS re, sum(im * cos({turn('s')}) - re * sin({turn('s')})) AS im FROM f1, (SELECT k FROM range(8) r(k) WHERE k < 2 OR k >= 6) GROUP BY ALL),
i2 AS (SELECT b, kt, k AS s, sum(re * cos({turn('ks')}) - im * sin({turn('ks')})) / 8 AS re, sum(im * cos({turn('ks')}) + re * sin({turn('ks')})) / 8 AS im FROM f2, range(8) r(k) GROUP BY ALL)
SELECT b, CAST(k * 8 + s AS INTEGER) AS idx, round((sum((CASE WHEN kt = 0 THEN 1 ELSE 2 END) * (re * cos({turn('kt')}) - im * sin({turn('kt')}))) / 8) * pow(2, 20)) / pow(2, 20) + 0.0 AS re FROM i2, range(8) r(k) GROUP BY b, k, s"""


@_query(_two_range_sql())
def spectral_two_ranges(spark, d):
    """Low frequencies of 8 x 8 arrays, both ends of the full axis, and back."""
    low = N.kron(L.Restriction(5, ((0, 3),), "c64"), L.Restriction(8, ((0, 2), (6, 8)), "c64"))
    modes = N.compose(low, N.kron(L.Fourier(8, "f64"), L.Fourier(8, "c64")))
    return _out(N.compose(modes.H, modes).apply(tables.vectors(spark, d, deal=True)), 20)


# --- tables of what expressions say about themselves ----------------------


_BLOCKS = "SELECT p, CASE WHEN x < (n % p) * (n // p + 1) THEN x // (n // p + 1) ELSE n % p + (x - (n % p) * (n // p + 1)) // greatest(n // p, 1) END AS block, x"


@_query(f"WITH o AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS x, count(*) OVER () AS n FROM customer), b AS ({_BLOCKS} FROM o, (VALUES (1), (3), (7), (13)) t(p)) SELECT CAST(p AS INTEGER) AS p, CAST(block AS INTEGER) AS block, count(*) AS n, min(x) AS lo, max(x) + 1 AS hi FROM b GROUP BY p, block")
def block_table(spark, d):
    """Customers in even blocks: how many each worker has, and which range."""
    keys = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("x"))  # numbered from 0 without gaps
    n, out = keys.count(), None
    for p in (1, 3, 7, 13):
        part = keys.groupBy(F.lit(p).alias("p"), block_of(F.col("x"), n, p).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), (F.max("x") + 1).alias("hi"))
        out = part if out is None else out.unionByName(part)
    return out


@_query("WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT CAST(k AS INTEGER) AS k, CAST(sum(n) OVER (ORDER BY k) - n AS BIGINT) AS lo, CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS hi FROM c")
def ranges_table(spark, d):
    """The ranges that the customers of each nation take, one nation after the other."""
    sizes = tables.read(spark, d, "customer").groupBy("c_nationkey").count().orderBy("c_nationkey").collect()  # one row a nation
    ranges = cumulative_ranges([r["count"] for r in sizes])
    return spark.createDataFrame([(r["c_nationkey"], a, b) for r, (a, b) in zip(sizes, ranges)], "k int, lo long, hi long")


@_query(ORACLE_SQL["compose_chain"])
def json_round_trip(spark, d):
    """A chain that is written as JSON text, read back, bound and applied."""
    leaves = [L.Matrix(8, 16, "A"), L.Diagonal(16, "g"), L.Matrix(16, 64, "C")]
    return _out(from_json(to_json(N.compose(*leaves))).bind(_params(spark, *leaves)).apply(tables.vectors(spark, d, deal=True)))


@_query("SELECT CAST(64 * 10 * count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS bad FROM embeddings")
def rewrites_agree(spark, d):
    """Elements of all forms of one product of three factors, and how many differ from another form's."""
    op, x = _product(spark, (4, 4), (4, 4), (4, 4)), tables.vectors(spark, d, deal=True)
    forms: dict[str, N.Operator] = {}
    for other in transforms(op):
        forms.setdefault(merkle_hash(other), other)
    out = None
    for other in forms.values():
        y = other.apply(x)
        out = y if out is None else out.unionByName(y)
    same = out.groupBy("b", "idx").agg(F.count(F.lit(1)).alias("n"), (F.min("re") != F.max("re")).cast("long").alias("bad"))
    return same.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _by_rank(x: DataFrame, shape: tuple[int, ...], grid: tuple[int, ...]) -> DataFrame:
    """Rows with the worker that has them on ``grid`` as a key, in its partition."""
    return x.withColumn("rank", rank_of("idx", shape, grid)).repartitionById(int(np.prod(grid)), F.col("rank"))


@_query(f"WITH {_L}, {_d(64)} SELECT CAST(idx // 16 AS INTEGER) AS rank, b, idx, w * re + 0.0 AS re FROM l JOIN d ON idx = i")
def distributed_diagonal(spark, d):
    """A diagonal on rows that lie with four workers, each with its block."""
    leaf = L.Diagonal(64, "d")
    return _out(leaf.bind(_params(spark, leaf)).apply(_by_rank(tables.vectors(spark, d), (64,), (4,))))


@_query(f"WITH {_L}, w AS (SELECT i, o, t, CAST((7 * (i + 8 * o + 24 * t)) % 11 - 5 AS DOUBLE) AS w FROM range(8) a(i), range(3) c(o), range(8) e(t)) SELECT CAST(t // 2 AS INTEGER) AS rank, b, CAST(o + 3 * t AS INTEGER) AS idx, sum(w * re) + 0.0 AS re FROM l JOIN w ON idx % 8 = i AND idx // 8 = t GROUP BY b, o, t")
def distributed_tensor(spark, d):
    """A contraction on rows that lie with four workers by their third axis, which it does not sum over."""
    leaf = L.Tensor(("i", "o", "t"), (8, 3, 8), ("i", "t"), (8, 8), ("o", "t"), (3, 8), "T")
    return _out(leaf.bind(_params(spark, leaf)).apply(_by_rank(tables.vectors(spark, d), (8, 8), (1, 4))))


@_query(f"WITH {_L}, {_w('w', 64, 64)} SELECT b, {_I}, sum(w * re) + 0.0 AS re FROM l JOIN w ON idx = j GROUP BY b, i")
def matrix_tiled(spark, d):
    """A matrix as tiles of 16 x 16 on panels of vectors."""
    leaf = L.Matrix(64, 64, "W")
    return _out(long_of(leaf.bind(generated_tiles(spark, leaf, W, tile=16)).apply(tables.dense_vectors(spark, d))))


@_query(f"WITH {_L}, {_Z}, {_w('w', 32, 16, True)} SELECT b, CAST(j AS INTEGER) AS idx, sum(w * re + wi * im) + 0.0 AS re, sum(w * im - wi * re) + 0.0 AS im FROM z JOIN w ON idx = i GROUP BY b, j")
def matrix_tiled_adjoint(spark, d):
    """The adjoint of a complex matrix, its elements tiled by 8 x 8, on LONG items."""
    leaf = L.Matrix(32, 16, "W", "c64")
    return _out(leaf.bind(tiled(_params(spark, leaf, im=V), leaf, 8)).H.apply(tables.complex_vectors(spark, d)))


@_query(f"WITH {_L}, {_w('w', 8, 64)} SELECT b, {_I}, CAST(CAST(sum(CAST(re AS FLOAT) * w) AS FLOAT) AS DOUBLE) + 0.0 AS re FROM l JOIN w ON idx = j GROUP BY b, i")
def matrix_apply_f32(spark, d):
    """Floats in and out, added up as doubles."""
    x = tables.vectors(spark, d, deal=True).withColumn("re", F.col("re").cast("float"))
    return _out(_matrix(spark, 8, 64, "f32").apply(x))


@_query(f"WITH {_L}, s AS (SELECT b // 40 AS b, idx, sum(re) AS re FROM l GROUP BY ALL), r AS (SELECT DISTINCT CAST(b % 8 AS INTEGER) AS rank FROM l) SELECT b, rank, idx, re + 0.0 AS re FROM s, r")
def reduce_dense(spark, d):
    """Arrays of eight workers added up item by item, and again on every worker."""
    rows = tables.dense_vectors(spark, d).select(F.floor(F.col("b") / 40).alias("b"), (F.col("b") % 8).cast("int").alias("rank"), "re")
    return _out(long_of(L.Reduce().apply(rows).dropDuplicates(["b", "rank"])))


@_query(f"WITH {_L}, p AS (SELECT b // 64 AS b, (b % 64) * 64 + idx AS idx, re FROM l) SELECT b, CAST(k AS INTEGER) AS idx, round((sum(re * cos({_SIN.format(j='idx', n=4096)}))) * pow(2, 10)) / pow(2, 10) + 0.0 AS re, round((sum(-re * sin({_SIN.format(j='idx', n=4096)}))) * pow(2, 10)) / pow(2, 10) + 0.0 AS im FROM p, range(2049) t(k) GROUP BY b, k")
def rdft_long_axis(spark, d):
    """64 vectors end to end, transformed in two passes of 64: no row holds the axis."""
    x = tables.vectors(spark, d)
    x = x.select(F.floor(F.col("b") / 64).alias("b"), (F.col("b") % 64 * 64 + F.col("idx")).cast("int").alias("idx"), "re")
    return _out(L.Fourier(4096, "f64", piece=64).apply(x), 10)


@_query(f"WITH {_L} SELECT b, CAST(idx % 4 AS INTEGER) AS rank, CAST(idx // 4 AS INTEGER) AS idx, re + 0.0 AS re FROM l")
def repartition_chunks(spark, d):
    """4 x 4 x 4 arrays in blocks, from a grid of 2 x 2 x 2 to one of 4 x 1 x 1: a row for each pair of overlapping blocks."""
    op = L.Repartition((4, 4, 4), (2, 2, 2), (4, 1, 1))
    return _out(long_of(moved_blocks(op, chunked(tables.dense_vectors(spark, d), op.shape, op.grid_in))))


@_query(f"WITH {_L} SELECT b, CAST((idx // 8) // 2 AS INTEGER) AS rank, CAST((idx // 8) % 2 + 2 * (idx % 8) AS INTEGER) AS idx, re + 0.0 AS re FROM l")
def rotate_chunks(spark, d):
    """8 x 8 arrays in blocks of 4 x 2, turned, so the second axis comes first, and their other axis gathered."""
    blocks, shape, grid = rotated_blocks(chunked(tables.dense_vectors(spark, d), (8, 8), (2, 4)), (8, 8), (2, 4), 1)
    return _out(long_of(matrix_blocks(blocks, shape, grid)[0]))


_MANY = [(3 * k % 61, 3 * k % 61 + 2 + k % 2) for k in range(50)]


@_query(f"WITH {_L}, r AS (SELECT k, 3 * k % 61 AS a, 2 + k % 2 AS n FROM range(50) t(k)), s AS (SELECT a, n, sum(n) OVER (ORDER BY k) - n AS o FROM r) SELECT b, CAST(idx - a + o AS INTEGER) AS idx, re + 0.0 AS re FROM l JOIN s ON idx >= a AND idx < a + n")
def restrict_many_ranges(spark, d):
    """More ranges than an expression has cases for, some of them overlapping: looked up by buckets of positions."""
    return _out(L.Restriction(64, tuple(_MANY)).apply(tables.vectors(spark, d)))


@_query(ORACLE_SQL["grad_spectral_block"])
def grad_tree_long(spark, d):
    """The same gradients by joins alone, as for parameters and items that do not fit in a task."""
    leaves = [L.Diagonal(4, "g", "c64"), L.Matrix(4, 4, "M", "c64")]
    params = generated(spark, leaves[0], D, E).unionByName(generated(spark, leaves[1], W, V))
    x = tables.vectors(spark, d)
    value = lambda c: (_rounded(c, 26) + F.lit(0.0)).alias(c)
    return grad_params(spectral_block().bind(params), x, x, joins=True).select("op_id", "i", "j", value("re"), value("im"))


__all__ = ["ORACLE_SQL", "QUERIES", "spectral_block"]
