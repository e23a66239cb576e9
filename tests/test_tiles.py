"""Tiled matrices, sums of arrays and element types against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tensorloom as t
from tensorloom.operators import nodes
from tensorloom.plans import tiles

RNG = np.random.default_rng(7)


def dense(spark, x, keys=None):
    keys = keys or [(k,) for k in range(len(x))]
    im = np.iscomplexobj(x)
    rows = [(*k, v.real.tolist(), *([v.imag.tolist()] if im else [])) for k, v in zip(keys, x)]
    names = "b long" if len(keys[0]) == 1 else "b long, c string"
    return spark.createDataFrame(rows, f"{names}, re array<double>{', im array<double>' if im else ''}")


def values(df):
    out = {tuple(r[k] for k in df.columns if k not in ("re", "im")): np.array(r["re"]) + (1j * np.array(r["im"]) if "im" in df.columns else 0) for r in df.collect() if r["re"] is not None}
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], atol=1e-9)


@pytest.mark.parametrize("m, n, adjoint, dtype", [(10, 7, False, "f64"), (10, 7, True, "c64"), (12, 12, False, "c64"), (1, 5, True, "f64"), (33, 1, False, "f64")])
def test_product(spark, monkeypatch, m, n, adjoint, dtype):
    monkeypatch.setattr(tiles, "FIBRES", 3)
    monkeypatch.setattr(tiles, "TILES_AT_ONCE", 2)
    monkeypatch.setattr(tiles, "OPEN_BYTES", 100)
    w = RNG.integers(-5, 5, (m, n)) + (1j * RNG.integers(-5, 5, (m, n)) if dtype == "c64" else 0)
    x = RNG.integers(-5, 5, (8, m if adjoint else n)) + (1j if dtype == "c64" else 0.0)
    leaf = t.Matrix(m, n, "W", dtype)
    a = leaf.bind(tiles.tiled(t.from_arrays(spark, {"W": w}), leaf, 4))
    a = a.H if adjoint else a
    keys = [(k % 3 or None, f"c{k}") for k in range(8)]
    want = {k: v for k, v in zip(keys, x @ (w.conj() if adjoint else w.T))}
    df = dense(spark, x, keys).repartition(2)
    close(values(a.apply(df)), want)
    close(values(t.dense_of(a.apply(t.long_of(df)))), want)  # LONG items are gathered, and unfolded again
    close(values(t.dense_of(a.apply(t.long_of(df), fast=False))), want)  # element by element


def test_tiles_are_counted_not_elements(spark):
    """What is shuffled: a row for each pair of panel and tile column, and for each tile and share; not one for each element."""
    leaf = t.Matrix(64, 48, "W")
    a = leaf.bind(tiles.generated_tiles(spark, leaf, lambda i, j: (7 * i + 3 * j) % 11 - 5, tile=16))
    x = RNG.integers(-9, 9, (100, 48)).astype(float)
    y = a.apply(dense(spark, x).coalesce(1))
    w = np.array([[(7 * i + 3 * j) % 11 - 5 for j in range(48)] for i in range(64)])
    close(values(y), {(k,): v for k, v in enumerate(x @ w.T)})
    y.collect()
    plan, rows = y._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        if name == "Exchange":
            rows.append(p.metrics().get("shuffleRecordsWritten").get().value())
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(plan)
    assert rows and max(rows) <= 4 * 3 * 8 and sum(rows) < 200, rows


def test_trees_beyond_the_limit(spark, monkeypatch):
    """Parameters that do not go to every task together: matrices of a tree become tiles, the rest is as before."""
    a, b, d = t.Matrix(6, 4, "a"), t.Matrix(5, 3, "b"), t.Diagonal(30, "d")
    w = {"a": RNG.integers(-3, 3, (6, 4)), "b": RNG.integers(-3, 3, (5, 3)), "d": RNG.integers(-3, 3, 30)}
    params = t.from_arrays(spark, w)
    op = t.compose(d, t.kron(a, b)).bind(params)
    x = RNG.integers(-5, 5, (7, 12)).astype(float)
    want = {(k,): v for k, v in enumerate(w["d"] * (x @ np.kron(w["a"], w["b"]).T))}
    monkeypatch.setattr(nodes, "BROADCAST_BYTES", 24 * 30)  # the diagonal fits, the matrices beside it do not
    monkeypatch.setattr(tiles, "TILE", 4)
    close(values(op.apply(dense(spark, x))), want)
    monkeypatch.setattr(nodes, "BROADCAST_BYTES", 1)  # then the diagonal is joined, and everything in LONG
    close(values(op.apply(dense(spark, x))), want)
    with pytest.raises(t.OperatorError, match="too large"):
        from tensorloom.plans import lower

        lower.gathered(op)


def test_tiles_of_other_shapes(spark):
    leaf = t.Matrix(5, 6, "W")
    table = tiles.tiled(spark.createDataFrame([("W", 4, 5, 2.0, 0.0), ("X", 0, 0, 9.0, 0.0)], t.functions.params.SCHEMA), leaf, 4)
    assert table.count() == 4 and tiles.tile_size(table) == 4
    assert [(r.i, r.j) for r in tiles.elements(table, leaf).where("re != 0").collect()] == [(4, 5)]
    assert tiles.elements(table, leaf).count() == 30
    x = spark.createDataFrame([(1, [1.0] * 6), (2, None)], "b long, re array<double>")
    got = {r["b"]: r["re"] for r in leaf.bind(table).apply(x).collect()}
    assert got == {1: [0, 0, 0, 0, 2], 2: None}
    assert leaf.bind(table).apply(x.where("false")).count() == 0
    with pytest.raises(t.OperatorError, match="tiles are for matrices"):
        t.Diagonal(4, "W").bind(table)
    for bad in ([1.0] * 5, [1.0, None] * 3):
        with pytest.raises(Exception, match="elements where the operator takes 6|a value is null"):
            leaf.bind(table).apply(spark.createDataFrame([(1, bad)], "b long, re array<double>")).collect()


def test_reduce_of_arrays(spark):
    x = RNG.integers(-5, 5, (12, 6)).astype(float)
    keys = [(k % 2 or None, k % 3) for k in range(12)]
    df = spark.createDataFrame([(*k, v.tolist()) for k, v in zip(keys, x)] + [(5, 0, None), (5, 1, [1.0] * 6), (6, 2, None)], "b long, rank int, re array<double>").repartition(4)
    got = {(r["b"], r["rank"]): r["re"] for r in t.Reduce().apply(df).collect()}
    want = {(b, rank): sum(v for k, v in zip(keys, x) if k[0] == b).tolist() for b in (1, None) for rank in range(3)}
    assert got == want | {(5, r): [1.0] * 6 for r in range(3)} | {(6, r): None for r in range(3)}
    leaf = t.Diagonal(6, "d")
    both = t.compose(t.Reduce(), leaf).bind(t.from_arrays(spark, {"d": np.arange(6)}))
    got = {(r["b"], r["rank"]): r["re"] for r in both.apply(df).collect()}
    assert got[1, 0] == (np.arange(6) * want[1, 0]).tolist()
    with pytest.raises(t.OperatorError, match="rank"):
        t.Reduce().apply(dense(spark, x))
    with pytest.raises(Exception, match="arrays of"):
        t.Reduce().apply(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "rank int, re array<double>")).collect()


def test_sums_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(tiles, "OPEN_BYTES", 1)
    df = spark.range(200).selectExpr("id % 7 AS b", "array(CAST(id AS DOUBLE), 1D) AS re", "array(0D, CAST(id AS DOUBLE)) AS im").repartition(6)
    got = {r["b"]: (r["re"], r["im"]) for r in tiles.summed(df).collect()}
    assert got == {b: ([float(sum(range(b, 200, 7))), float(len(range(b, 200, 7)))], [0.0, float(sum(range(b, 200, 7)))]) for b in range(7)}
    (one,) = tiles.summed(df.select("re", "im")).collect()
    assert one["re"] == [19900.0, 200.0] and tiles.summed(df.where("false")).count() == 0


TYPES = ["f32", "c32", "c64"]


def grid(dtype):
    """The operators whose sizes and element types are looked at, with the length of input and output."""
    wide = t.Fourier(8, dtype)
    return [
        (t.Identity(8, dtype), 8, 8), (t.Matrix(6, 8, "W", dtype), 8, 6), (t.Matrix(6, 8, "W", dtype).H, 6, 8), (t.Diagonal(8, "d", dtype), 8, 8), (t.Diagonal(8, "d", dtype).H, 8, 8),
        (wide, 8, 8 if dtype[0] == "c" else 5), (wide.H, 8 if dtype[0] == "c" else 5, 8), (t.Restriction(8, ((0, 2), (6, 8)), dtype), 8, 4), (t.Restriction(8, ((0, 2), (6, 8)), dtype).H, 4, 8),
        (t.kron(t.Matrix(6, 8, "W", dtype), t.Matrix(6, 8, "W", dtype)), 64, 36), (t.kron(wide, t.Fourier(8, wide.rdt)), 64, 64 if dtype[0] == "c" else 40), (t.compose(t.Matrix(6, 8, "W", dtype), t.Diagonal(8, "d", dtype)), 8, 6),
    ]


@pytest.mark.parametrize("dtype", TYPES)
def test_types_and_sizes(spark, dtype):
    """Every operator on a vector and on two: lengths, and float or double columns by element type."""
    params = t.from_arrays(spark, {"W": RNG.random((6, 8)), "d": RNG.random(8)})
    for op, n, m in grid(dtype):
        assert (op.domain, op.range) == (n, m)
        kind = {"re": "array<float>" if op.rdt in ("f32", "c32") else "array<double>"}
        given = "array<float>" if dtype in ("f32", "c32") else "array<double>"
        for items in (1, 2):
            x = dense(spark, RNG.random((items, n)) * (1 + 1j if op.ddt[0] == "c" else 1)).withColumn("re", F.col("re").cast(given))
            y = op.bind(params).apply(x)
            assert {c: k for c, k in y.dtypes if c == "re"} == kind and ("im" in y.columns) == (op.rdt[0] == "c")
            assert [len(r["re"]) for r in y.collect()] == [m] * items
            z = op.bind(params).apply(t.long_of(x))
            assert dict(z.dtypes)["re"] == kind["re"][6:-1] and z.count() == m * items


def test_floats_are_floats(spark):
    w, x = np.array([[1.0 + 2**-30]]), spark.createDataFrame([(0, [1.0])], "b long, re array<double>")
    a = t.Matrix(1, 1, "W", "f32").bind(t.from_arrays(spark, {"W": w}))
    assert a.apply(x).collect()[0]["re"] == [1.0] and a.apply(t.long_of(x)).collect()[0]["re"] == 1.0


def test_forms_on_arrays(spark):
    """Bias, division and row scaling take DENSE tables too."""
    x = dense(spark, np.array([[1.0, 2.0], [3.0, 4.0]]))
    params = t.from_arrays(spark, {"b": np.array([[10.0], [20.0]]), "d": np.array([2.0, 3.0])})
    from tensorloom.plans.lower import add_bias, scale_rows

    close(values(add_bias(t.Matrix(2, 1, "b").bind(params), x)), {(0,): np.array([11, 22]), (1,): np.array([13, 24])})
    close(values(scale_rows(t.Diagonal(2, "d").bind(params), x)), {(0,): np.array([2, 6]), (1,): np.array([6, 12])})
