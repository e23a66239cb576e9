"""Each operator in both layouts against NumPy."""

import numpy as np
import pytest

import tensorloom as t
from tensorloom.plans.lower import scale_rows

RNG = np.random.default_rng(7)


def table(spark, x):
    """LONG rows of a batch; rows of ``x`` are items."""
    kind = "b long, idx int, re double" + (", im double" if np.iscomplexobj(x) else "")
    rows = [(b, i, float(v.real), *([float(v.imag)] if np.iscomplexobj(x) else [])) for (b, i), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, kind)


def array(df, shape):
    out = np.zeros(shape, complex)
    seen = np.zeros(shape, int)
    for r in df.collect():
        out[r["b"], r["idx"]] = complex(r["re"], r["im"] if "im" in df.columns else 0.0)
        seen[r["b"], r["idx"]] += 1
    assert (seen == 1).all(), "each position once"
    return out


def both(spark, op, x, want, params=None):
    bound = op.bind(params) if params is not None else op
    df = table(spark, x)
    np.testing.assert_allclose(array(bound.apply(df), want.shape), want, atol=1e-9)
    np.testing.assert_allclose(array(bound.apply(df, fast=True), want.shape), want, atol=1e-9)


def draw(*shape, complex_=False):
    x = RNG.normal(size=shape)
    return x + 1j * RNG.normal(size=shape) if complex_ else x


@pytest.mark.parametrize("c", [False, True])
def test_matrix_and_diagonal(spark, c):
    kind = "c64" if c else "f64"
    w, d = draw(3, 5, complex_=c), draw(5, complex_=c)
    params = t.from_arrays(spark, {"W": w, "d": d})
    a, diag = t.Matrix(3, 5, "W", kind), t.Diagonal(5, "d", kind)
    x, y = draw(2, 5, complex_=c), draw(2, 3, complex_=c)
    both(spark, a, x, x @ w.T, params)
    both(spark, a.H, y, y @ w.conj(), params)
    both(spark, diag, x, x * d, params)
    both(spark, diag.H, x, x * d.conj(), params)
    np.testing.assert_allclose(array(t.rapply(a.bind(params), table(spark, y)), (2, 5)), y @ w, atol=1e-9)
    both(spark, a @ diag, x, (x * d) @ w.T, params)
    both(spark, (a @ diag).H, y, (y @ w.conj()) * d.conj(), params)
    # binding and adjoint commute
    np.testing.assert_allclose(array(a.bind(params).H.apply(table(spark, y)), (2, 5)), y @ w.conj(), atol=1e-9)
    np.testing.assert_allclose(array(scale_rows(diag.bind(params), table(spark, x)), (2, 5)), x * d, atol=1e-9)


def test_slices(spark):
    w = draw(4, 6)
    params = t.from_arrays(spark, {"W": w})
    a = t.Matrix(4, 6, "W")
    assert a[1:3, 0:2].op_id != a.op_id and a[1:3, 0:2].shape == (2, 2)
    assert a[2, 1:4].shape == (1, 3) and a[1:3, 5].shape == (2, 1)
    part = a.bind(params)[1:3, 2:6]
    x = draw(2, 4)
    np.testing.assert_allclose(array(part.apply(table(spark, x)), (2, 2)), x @ w[1:3, 2:6].T, atol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 5, 8])
@pytest.mark.parametrize("norm", ["backward", "ortho"])
def test_fourier(spark, n, norm):
    x, z = draw(3, n), draw(3, n, complex_=True)
    real, full = t.Fourier(n, "f64", norm), t.Fourier(n, "c64", norm)
    half = np.fft.rfft(x, norm=norm)
    assert real.range == half.shape[1]
    both(spark, real, x, half)
    both(spark, real.H, half, x + 0j)
    both(spark, full, z, np.fft.fft(z, norm=norm))
    both(spark, full.H, z, np.fft.ifft(z, norm=norm))


def test_adjoint_property(spark):
    """<x, A' y> = <A x, y> where the adjoint is the conjugate transpose."""
    w = draw(4, 5, complex_=True)
    params = t.from_arrays(spark, {"W": w, "d": draw(5, complex_=True)})
    ops = [t.Matrix(4, 5, "W", "c64"), t.Diagonal(5, "d", "c64"), t.Fourier(6, "c64", "ortho"), t.Restriction(6, ((0, 2), (1, 4)), "c64", True)]
    for op in ops:
        x, y = draw(1, op.domain, complex_=True), draw(1, op.range, complex_=True)
        a = op.bind(params)
        left = np.vdot(x, array(a.H.apply(table(spark, y)), x.shape))
        right = np.vdot(array(a.apply(table(spark, x)), y.shape), y)
        assert left == pytest.approx(right, rel=1e-9)


def test_restriction(spark):
    r = t.Restriction(8, ((0, 2), (6, 8)))
    x = np.arange(1.0, 9)[None]
    both(spark, r, x, np.array([[1, 2, 7, 8.0]]))
    both(spark, r.H, np.array([[1, 2, 7, 8.0]]), np.array([[1, 2, 0, 0, 0, 0, 7, 8.0]]))
    over = t.Restriction(4, ((0, 3), (1, 3)))
    y = np.array([[1, 2, 3, 20, 30.0]])
    both(spark, over.H, y, np.array([[1, 20, 30, 0.0]]))
    both(spark, over, np.array([[1, 2, 3, 4.0]]), np.array([[1, 2, 3, 2, 3.0]]))
    many = t.Restriction(90, tuple((i, i + 1) for i in range(0, 80, 2)))
    z = draw(2, 40)
    both(spark, many.H, z, np.insert(np.zeros((2, 50)), np.arange(0, 40), z, axis=1))
    both(spark, many, draw(1, 90) * 0 + np.arange(90.0), np.arange(0.0, 80, 2)[None])
    none = t.Restriction(3, ((1, 1),))
    assert none.range == 0 and none.apply(table(spark, draw(1, 3))).count() == 0
    both(spark, t.Restriction(4, ((0, 3), (1, 3)), accumulate=True).H, y, np.array([[1, 22, 33, 0.0]]))
    with pytest.raises(t.OperatorError):
        t.Restriction(4, ((0, 5),)).apply(table(spark, x[:, :4]))


def test_kron_goldens(spark):
    p = t.from_arrays(spark, {"A": np.array([[1, 2], [3, 4.0]]), "B": np.array([[0, 1], [1, 0.0]]), "C": np.array([[1, 2, 3.0]])})
    a, b, c = t.Matrix(2, 2, "A"), t.Matrix(2, 2, "B"), t.Matrix(1, 3, "C")
    both(spark, t.kron(a, b), np.array([[1, 2, 3, 4.0]]), np.array([[10, 7, 22, 15.0]]), p)
    both(spark, t.kron(c, b), np.arange(1.0, 7)[None], np.array([[28, 22.0]]), p)


def test_kron_orders_and_nesting(spark):
    w = {"A": draw(2, 3), "B": draw(3, 4), "C": draw(4, 2)}
    p = t.from_arrays(spark, w)
    a, b, c = t.Matrix(2, 3, "A"), t.Matrix(3, 4, "B"), t.Matrix(4, 2, "C")
    full = np.kron(w["A"], np.kron(w["B"], w["C"]))
    x, y = draw(2, 24), draw(2, 24)
    k = t.kron(a, b, c)
    for order in [(0, 1, 2), (2, 0, 1), (1, 2, 0)]:
        both(spark, k.with_order(order), x, x @ full.T, p)
    both(spark, t.kron_of([a, t.kron(b, c)]), x, x @ full.T, p)
    both(spark, k.H, y, y @ full, p)
    both(spark, t.kron(a, t.Identity(4)), draw(1, 12) * 0 + 1, np.ones((1, 12)) @ np.kron(w["A"], np.eye(4)).T, p)
    assert k.bind(p).order == k.order
    assert t.kron(t.Identity(3), t.Identity(4)) == t.Identity(12)


def test_kron_mixed_types(spark):
    x = draw(2, 20)
    op = t.kron(t.Fourier(4, "c64"), t.Fourier(5, "f64"))
    assert op.order == (1, 0)
    want = np.fft.fft(np.fft.rfft(x.reshape(2, 4, 5), axis=2), axis=1).reshape(2, -1)
    both(spark, op, x, want)
    both(spark, op.H, want, x + 0j)
    with pytest.raises(t.OperatorError):
        op.with_order((0, 1))


def test_greedy_orders():
    m = lambda i, j, k: t.Matrix(i, j, k)
    a, b, c = m(10, 20, "a"), m(30, 50, "b"), m(60, 90, "c")
    assert t.kron(c, b, a).order == (0, 1, 2)
    assert t.kron(t.Fourier(640, "c64"), t.Fourier(253, "f64")).order == (1, 0)
    assert t.kron(t.Fourier(20, "f64"), t.Fourier(64), t.Fourier(64)).order == (0, 2, 1)


@pytest.mark.parametrize("c", [False, True])
def test_tensor(spark, c):
    kind = "c64" if c else "f64"
    cases = [
        ("iotp", (2, 3, 2, 2), "itp", "otp"),
        ("oixyt", (3, 2, 2, 1, 2), "ixyt", "oxyt"),
        ("oixyzt", (3, 2, 2, 1, 2, 2), "ixyzt", "oxyzt"),
        ("ij", (2, 3), "jk", "ik"),
    ]
    for weight, shape, source, target in cases:
        size = dict(zip(weight, shape)) | {"k": 2}
        op = t.Tensor(tuple(weight), shape, tuple(source), tuple(size[a] for a in source), tuple(target), tuple(size[a] for a in target), "w", kind)
        w = draw(*shape, complex_=c)
        p = t.from_arrays(spark, {"w": w.reshape(-1, order="F")})
        x = draw(2, op.domain, complex_=c)
        cube = np.stack([v.reshape(op.input_shape, order="F") for v in x])
        want = np.stack([np.einsum(f"{source},{weight}->{target}", v, w).reshape(-1, order="F") for v in cube])
        both(spark, op, x, want, p)
        y = draw(2, op.range, complex_=c)
        cube = np.stack([v.reshape(op.target_shape, order="F") for v in y])
        want = np.stack([np.einsum(f"{target},{weight}->{source}", v, w.conj()).reshape(-1, order="F") for v in cube])
        both(spark, op.H, y, want, p)


def test_reduce_repartition_and_blocks(spark):
    rows = [(r, i, float(r * 10 + i)) for r in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "rank int, idx int, re double")
    out = {(r["rank"], r["idx"]): r["re"] for r in t.Reduce().apply(df).collect()}
    assert out == {(r, i): float(30 + 3 * i) for r in range(3) for i in range(4)}
    assert [t.local_size(10, r, 8) for r in range(8)] == [2, 2, 1, 1, 1, 1, 1, 1]
    assert t.range_axes((2, 1), (5, 3)) == [[(0, 3), (3, 5)], [(0, 3)]]
    op = t.Repartition((4, 3, 2), (2, 1, 2), (4, 1, 1))
    x = draw(1, 24)
    both(spark, op, x, x)
    both(spark, op.H, x, x)
    from pyspark.sql import functions as F

    moved = op.apply(table(spark, x)).select("idx", F.spark_partition_id().alias("p")).collect()
    assert all(r["p"] == r["idx"] % 4 for r in moved)
    from tensorloom.plans.grid import block_of, block_ranges

    for n in (1, 3, 7, 10):
        for p in (1, 2, 5, 11):
            got = [r[0] for r in spark.range(n).select(block_of(F.col("id"), n, p)).collect()]
            assert got == [k for k, (a, b) in enumerate(block_ranges(n, p)) for _ in range(a, b)]


def test_batched_twice_bias_and_division(spark):
    from tensorloom.plans.lower import add_bias, divide_by

    w = draw(3, 4)
    p = t.from_arrays(spark, {"W": w, "c": np.array([[1.0], [2], [3]]), "D": np.array([[1.0, -1], [0, 2]])})
    x = draw(2, 3, 4)
    rows = [(b, c, i, float(v)) for (b, c, i), v in np.ndenumerate(x)]
    df = spark.createDataFrame(rows, "b1 int, b2 int, idx int, re double")
    out = np.zeros((2, 3, 3))
    for r in t.Matrix(3, 4, "W").bind(p).apply(df).collect():
        out[r["b1"], r["b2"], r["idx"]] = r["re"]
    np.testing.assert_allclose(out, x @ w.T, atol=1e-9)
    y = draw(2, 3)
    np.testing.assert_allclose(array(add_bias(t.Matrix(3, 1, "c").bind(p), table(spark, y)), (2, 3)), y + [1, 2, 3])
    d = spark.createDataFrame([(0, 0, 0.0), (0, 1, -0.0), (1, 0, 0.0), (1, 1, 4.0)], "idx int, j int, re double")
    got = {(r["idx"], r["j"]): r["re"] for r in divide_by(t.Matrix(2, 2, "D").bind(p), d).collect()}
    assert got[0, 0] == float("inf") and got[0, 1] == float("inf") and np.isnan(got[1, 0]) and got[1, 1] == 0.5


def test_type_checks(spark):
    with pytest.raises(t.OperatorError):
        t.compose(t.Matrix(2, 3, "a"), t.Matrix(2, 3, "b"))
    with pytest.raises(t.OperatorError):
        t.compose(t.Matrix(2, 3, "a", "c64"), t.Matrix(3, 2, "b"))
    with pytest.raises(t.OperatorError):
        t.Matrix(2, 3, "a").apply(table(spark, draw(1, 3)))
    assert t.Matrix(2, 3, "a").parametricity == "parametric" and t.Identity(2).parametricity == "nonparametric"
    assert t.Matrix(2, 3, "a").H.H == t.Matrix(2, 3, "a") and t.Matrix(2, 3, "a").location == "external"


def dense(spark, rows, c=False):
    return spark.createDataFrame(rows, "b long, re array<double>" + (", im array<double>" if c else ""))


def test_dense_rows_are_checked(spark):
    """Rows of a wrong length and null values are errors; a null array stays null and moves nothing."""
    for op, rows in [(t.Identity(4), [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0, 4.0, 5.0])]), (t.Fourier(4, "f64"), [(0, [1.0] * 8)]), (t.Identity(2), [(0, [1.0, None])])]:
        with pytest.raises(Exception, match="elements where|a value is null"):
            op.apply(dense(spark, rows)).collect()
    got = {r["b"]: r["re"] for r in t.Identity(2).apply(dense(spark, [(0, [1.0, 2.0]), (1, None), (2, [3.0, 4.0])])).collect()}
    assert got == {0: [1, 2], 1: None, 2: [3, 4]}
    half = t.Fourier(4, "f64").H.apply(dense(spark, [(0, [4.0, 0.0, 0.0], [0.0, 0.0, 0.0]), (1, [4.0, 0.0, 0.0], None)], True))
    assert {r["b"]: r["re"] for r in half.collect()} == {0: [1, 1, 1, 1], 1: None}
    assert t.Identity(3).apply(dense(spark, [])).count() == 0


@pytest.mark.parametrize("fast", [False, True])
def test_long_rows_are_checked(spark, fast):
    for op in (t.Fourier(2), t.Identity(2, "c64"), t.Restriction(2, ((0, 1),), "c64")):
        for row in [(0, 7, 1.0, 0.0), (0, -1, 1.0, 0.0), (0, 0, None, 0.0), (0, 0, 1.0, None)]:
            with pytest.raises(Exception, match="outside of 2 elements"):
                op.apply(spark.createDataFrame([(0, 1, 1.0, 0.0), row], "b long, idx int, re double, im double"), fast=fast).collect()


def test_sparse_items(spark):
    """Positions that an item lacks are zero, whichever they are; null keys are items."""
    df = spark.createDataFrame([(0, 1, 5.0), (None, 0, 2.0)], "b long, idx int, re double")
    r = t.Restriction(4, ((1, 3),))
    for fast in (False, True):
        got = {(x["b"], x["idx"]): x["re"] for x in r.H.apply(df, fast=fast).collect()}
        assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 5, (0, 3): 0, (None, 0): 0, (None, 1): 2, (None, 2): 0, (None, 3): 0}
        y = {(x["b"], x["idx"]): x["re"] for x in t.Fourier(2, "f64").apply(df, fast=fast).collect()}
        assert y == {(0, 0): 5, (0, 1): -5, (None, 0): 2, (None, 1): 2}
    assert r.H.apply(df.where("false")).count() == 0


@pytest.mark.parametrize("ranges", [((0, 5), (2, 4)), ((2, 4), (0, 5), (1, 3)), ((0, 3), (3, 6)), ((4, 6), (0, 2))])
def test_overlaps(spark, ranges):
    r = t.Restriction(6, ranges)
    y = draw(2, r.range)
    want = np.zeros((2, 6))
    at = 0
    for a, b in ranges:
        want[:, a:b] = y[:, at : at + b - a]
        at += b - a
    both(spark, r.H, y, want)
    assert r.disjoint() == (len({i for a, b in ranges for i in range(a, b)}) == r.range)


@pytest.mark.parametrize("ranges", [((0, 5), (2, 4)), ((2, 4), (5, 6)), ((0, 3), (3, 6)), ((4, 6), (0, 2)), ((90, 91),), ()])
def test_complete_items(spark, ranges):
    """Zeros that come with the rows: the same as those that are found by bits, each position once, null keys too."""
    r = t.Restriction(100, ranges)
    y = draw(3, r.range)
    rows = [(b or None, i, float(v)) for (b, i), v in np.ndenumerate(y)]
    df = spark.createDataFrame(rows, "b long, idx int, re double")
    got, want = (sorted(map(repr, r.H.apply(df, complete=c).collect())) for c in (True, False))
    assert got == want and len(got) == (300 if ranges else 0)
    assert r.H.apply(df.where("false"), complete=True).count() == 0


def test_scatter_without_keys(spark, monkeypatch):
    """One item alone, over more words than one row unfolds."""
    from tensorloom.plans import lower

    monkeypatch.setattr(lower, "WORDS", 3)
    df = spark.range(500).selectExpr("CAST(id AS INT) AS idx", "CAST(id + 1 AS DOUBLE) AS re").where("idx != 7")
    rows = {r["idx"]: r["re"] for r in t.Restriction(1000, ((100, 350), (700, 950))).H.apply(df).collect()}
    assert sorted(rows) == list(range(1000)) and rows[107] == 0 and rows[100] == 1 and rows[949] == 500 and rows[99] == rows[950] == 0
    assert t.Restriction(1000, ((100, 350), (700, 950))).H.apply(df.where("false")).count() == 0


def test_positions_beyond_int(spark):
    """A product of 4.9e9 positions: applied to the few that are not zero, its positions are longs."""
    op = t.kron(t.Identity(70_000), t.Matrix(2, 1, "W"), t.Identity(35_000)).bind(t.from_arrays(spark, {"W": np.array([[1.0], [2.0]])}))
    assert op.range == 4_900_000_000
    df = spark.createDataFrame([(0, 69_999 * 35_000 + 34_999, 3.0)], "b long, idx long, re double")
    got = {r["idx"]: r["re"] for r in op.apply(df).collect()}
    assert got == {(69_999 * 2 + k) * 35_000 + 34_999: 3.0 * (k + 1) for k in range(2)}
    back = {r["idx"]: r["re"] for r in op.H.apply(op.apply(df)).collect()}
    assert back == {69_999 * 35_000 + 34_999: 15.0}


def test_many_ranges(spark):
    """A hundred thousand ranges over 10^8 positions are looked up without a row for a position; overlaps are cut in one sweep."""
    n = 10**8
    ranges = tuple((k * 1000 + k % 7, k * 1000 + 500) for k in range(100_000))
    r = t.Restriction(n, ranges)
    df = spark.range(2000).selectExpr("id % 3 AS b", "CAST(pmod(xxhash64(id), 100000000) AS INT) AS idx", "CAST(id AS DOUBLE) AS re")
    out = r.apply(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    starts = np.cumsum([0] + [b - a for a, b in ranges])
    want = sorted((x["b"], int(starts[x["idx"] // 1000] + x["idx"] - ranges[x["idx"] // 1000][0]), x["re"]) for x in df.collect() if ranges[x["idx"] // 1000][0] <= x["idx"] < ranges[x["idx"] // 1000][1])
    assert sorted(map(tuple, out.collect())) == want and len(want) > 500
    over = t.Restriction(10**6, tuple((k * 10, k * 10 + 25) for k in range(90_000)))
    moves = over.scattered()
    assert sum(b - a for a, b, _ in moves) == 90_000 * 10 + 15 and len(moves) == 90_000


def test_large_restriction_stays_small(spark):
    """A range of many positions is one move, not a list of positions."""
    r = t.Restriction(10**12, ((0, 10**11), (5 * 10**11, 10**12)))
    assert len(r.gathered()) == 2 == len(r.scattered()) and r.disjoint()


def test_long_transforms(spark, monkeypatch):
    """Fibres, and items too large to be gathered."""
    from tensorloom.plans import lower

    x = draw(2, 100)
    np.testing.assert_allclose(array(t.Fourier(100, "f64").apply(table(spark, x), fast=False), (2, 51)), np.fft.rfft(x), atol=1e-9)
    z = draw(2, 6 * 70)
    op = t.kron(t.Fourier(6), t.Fourier(70, "f64"))
    want = np.fft.rfft2(z.reshape(2, 6, 70)).reshape(2, -1)
    both(spark, op, z, want)
    monkeypatch.setattr(lower, "ITEM_CELLS", 10)
    np.testing.assert_allclose(array(op.apply(table(spark, z)), want.shape), want, atol=1e-9)
    monkeypatch.setattr(lower, "BATCH_CELLS", 100)
    both(spark, op, z, want)


def test_outer_product(spark, monkeypatch):
    from tensorloom.operators import nodes

    w, x = draw(3), draw(2, 4)
    op = t.Tensor(("o",), (3,), ("i",), (4,), ("o", "i"), (3, 4), "T")
    want = np.einsum("o,bi->bio", w, x).reshape(2, -1)
    both(spark, op, x, want, t.from_arrays(spark, {"T": w}))
    monkeypatch.setattr(nodes, "BROADCAST_BYTES", 1)
    np.testing.assert_allclose(array(op.bind(t.from_arrays(spark, {"T": w})).apply(table(spark, x)), want.shape), want, atol=1e-9)
