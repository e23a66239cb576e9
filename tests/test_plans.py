"""Rewrites, costs, hashes, JSON, rendering, distribution, parameters, gradients and streams."""

import json
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

import tensorloom as t
from tensorloom.plans import types
from tensorloom.plans.rewrite import Optimizer
from tests.test_operators import array, draw, table

M = lambda i, j, op_id, kind="f64": t.Matrix(i, j, op_id, kind)


def values(op):
    return t.plans.lower.gathered(op)


def result(op, x, w):
    """The operator in NumPy, with its leaves' values by id."""
    from tensorloom.plans.lower import evaluate

    return evaluate(op, x, w)


def expressions():
    a, b, c, d = M(4, 4, "a"), M(4, 4, "b"), M(4, 4, "c"), M(4, 4, "d")
    yield t.compose(a, b, c)
    yield t.composed([a, t.composed([b, c]), d])
    yield t.kron(a, b, c)
    yield t.compose(t.kron(a, b), t.kron(c, d))
    yield t.compose(t.kron(a, b).H, t.kron(c, d))
    yield t.compose(t.kron(a, M(4, 3, "e")), t.kron(b, M(3, 2, "f")))
    yield t.compose(t.kron(M(2, 4, "g", "c64"), M(3, 3, "h", "c64")), t.kron(t.Fourier(4), t.Fourier(4, "f64")))


@pytest.mark.parametrize("k", range(7))
@pytest.mark.parametrize("depth", [1, 2])
def test_rewrites_keep_the_result(k, depth):
    op = list(expressions())[k]
    rng = np.random.default_rng(3)
    shape = lambda leaf: rng.normal(size=leaf.shape) + (1j * rng.normal(size=leaf.shape) if leaf.dtype[0] == "c" else 0)
    w = {i: shape(leaf) for i, leaf in op.slots().items()}
    x = rng.normal(size=(2, op.domain))
    want = result(op, x, w)
    front, seen = [op], set()
    for _ in range(depth):
        found = [y for o in front[:40] for y in t.transforms(o)]
        front = []
        for y in found:
            if t.merkle_hash(y) not in seen:
                seen.add(t.merkle_hash(y))
                front.append(y)
                assert (y.domain, y.range, y.ddt, y.rdt) == (op.domain, op.range, op.ddt, op.rdt)
                np.testing.assert_allclose(result(y, x, w), want, atol=1e-9)
    assert len(seen) >= 2


def test_mixed_product_is_found():
    op = t.compose(t.kron(M(4, 3, "a"), M(5, 2, "b")), t.kron(M(3, 6, "c"), M(2, 7, "d")))
    fused = [x for x in t.transforms(op) if isinstance(x, t.Kron)]
    assert fused and all(isinstance(c, t.Compose) for c in fused[0].ops)


def test_costs_and_optimizer():
    a, b, c = M(10, 20, "A"), M(30, 50, "B"), M(60, 90, "C")
    k = t.kron(c, b, a)
    assert t.complexity(k) == 15_120_000
    best = t.optimize(k)
    assert t.complexity(best) == 7_740_000
    chain = M(3, 3, "c0")
    for i in range(1, 7):
        chain = t.composed([chain, M(3, 3, f"c{i}")])
    assert t.complexity(chain) == pytest.approx(126 + 6e-5, abs=1e-9)
    flat = t.optimize(chain)
    assert len(flat.ops) == 7 and t.complexity(flat) == pytest.approx(126 + 1e-5, abs=1e-9)
    f = t.kron(*[t.Fourier(n) for n in (12, 14, 16)])
    m = t.kron(*[M(8, n, f"M{n}", "c64") for n in (12, 14, 16)])
    assert t.complexity(t.compose(m, f)) == pytest.approx(276_090.19694, abs=1e-4)
    assert t.complexity(t.optimize(t.compose(m, f))) <= 228_089.34815
    search = Optimizer(k, population=3, bfs_rounds=1, bfs_threshold=1)
    search.run()
    assert search.bfs_runs >= 1 and search.best_score == 7_740_000 and len(search.best) <= 3
    assert t.complexity(t.Repartition((4, 4), (4, 1), (1, 4))) == 100 * 8 * 12
    assert t.complexity(t.Restriction(8, ((0, 2),))) == 0
    assert t.complexity(t.Tensor(("i", "o"), (2, 3), ("i",), (2,), ("o",), (3,), "T")) == 12


def test_types():
    assert types.subset_type("f64", "c32") == "f64" and types.subset_type("f64", "f32") == "f32"
    assert types.superset_type("f64", "c32") == "c64"
    assert [types.multiplication_cost(k) for k in types.NAMES] == [0.5, 1, 2, 1, 2, 4]
    with pytest.raises(t.OperatorError):
        types.checked("int")


def test_hashes():
    assert t.merkle_hash(M(4, 4, "x")) == t.merkle_hash(M(4, 4, "y"))
    forms = [M(4, 4, "x"), M(4, 8, "x"), M(4, 4, "x", "f32"), t.Identity(4), t.Diagonal(4, "d"), t.Fourier(4), M(4, 4, "x").H, t.broadcasted(M(4, 4, "x")), t.compose(M(4, 4, "x"), M(4, 4, "y")), t.kron(M(4, 4, "x"), M(4, 4, "y")), t.kron(M(4, 4, "x"), M(4, 4, "y")).with_order((0, 1)), t.Distributed(M(4, 4, "x"), 0, 2), t.Distributed(M(4, 4, "x"), 1, 2)]
    assert len({t.merkle_hash(f) for f in forms}) == len(forms)


@pytest.mark.parametrize("kind", types.NAMES)
def test_json(kind):
    a = M(4, 4, "1c2ff6a0-5d2a-4c5e-9f10-000000000001", kind)
    ops = [t.Identity(4, kind), t.Diagonal(4, "d", kind), a, a.H, t.Fourier(4, kind), t.Restriction(8, ((0, 2), (6, 10)), kind), t.compose(a, a), t.kron(a, M(4, 2, "b", kind)).with_order((1, 0)), t.Tensor(("i", "o"), (2, 3), ("i",), (2,), ("o",), (3,), "T", kind)]
    for op in ops:
        text = t.to_json(op)
        assert t.from_json(text) == op and t.to_json(t.from_json(text)) == text
    assert json.loads(t.to_json(a))["id"].startswith("UUID:")
    assert json.loads(t.to_json(ops[5]))["ranges"] == [[1, 2], [7, 10]] and json.loads(t.to_json(ops[7]))["order"] == [2, 1]


def test_json_errors():
    for bad in ["{}", '{"type": "Nothing"}', '{"type": "ParIdentity", "T": "Int8", "n": 4}', '{"type": "ParDFT", "T": "Float64", "n": 4, "m": 4}']:
        with pytest.raises(t.OperatorError):
            t.from_json(bad)
    with pytest.raises(t.OperatorError):
        t.to_json(t.Reduce())


def test_rendering():
    op = t.compose(M(4, 4, "a"), t.kron(t.Identity(2), M(2, 2, "b").H))
    dot = t.dot_string(op, {"size": lambda o: o.domain, "id": lambda o: o.op_id})
    assert dot.startswith("digraph g {") and "Matrix_2" in dot and "Compose_1 -> Kron_1" in dot and r"\nid = a" in dot
    tex = t.latex_string(op)
    assert r"\ast(" in tex and r"\otimes" in tex and r"^\top" in tex


def test_distribution(spark):
    w = {"A": draw(2, 4), "B": draw(3, 6)}
    p = t.from_arrays(spark, w)
    op = t.kron(M(2, 4, "A"), M(3, 6, "B"))
    plan = t.distribute(op, (2, 2))
    moves = [o for o in plan.ops if isinstance(o, t.Repartition)]
    assert [m.grid_out for m in moves] and plan.domain == op.domain and plan.range == op.range
    x = draw(2, 24)
    np.testing.assert_allclose(array(plan.bind(p).apply(table(spark, x)), (2, 6)), x @ np.kron(w["A"], w["B"]).T, atol=1e-9)
    mixed = t.distribute(t.kron(t.Fourier(4, "c64"), t.Fourier(4, "f64")), (2, 2))
    y = draw(1, 16)
    np.testing.assert_allclose(array(mixed.apply(table(spark, y)), (1, 12)), np.fft.fft(np.fft.rfft(y.reshape(4, 4)), axis=0).reshape(1, -1), atol=1e-9)
    assert t.distribute(t.kron(t.Identity(2), t.Identity(2)), (1, 1)) == t.Identity(4)
    from tensorloom.plans.distribute import grid_for

    assert [grid_for((1, 2, 1), o) for o in (2, 1, 0)] == [(1, 2, 1), (1, 1, 2), (1, 2, 1)]
    tensor = t.Tensor(("i", "o", "t"), (2, 3, 4), ("i", "t"), (2, 4), ("o", "t"), (3, 4), "T")
    assert t.distribute(tensor, (1, 2)).weight_shape == (2, 3, 2)
    for bad in [(2, 1), (1, 3)]:
        with pytest.raises(t.OperatorError):
            t.distribute(tensor, bad)
    assert t.Distributed(t.Identity(10), 0, 8).domain == 2
    d = t.Distributed(t.Identity(16), 0, 8)
    assert (d.domain, d.range) == (2, 2)
    np.testing.assert_allclose(array(d.apply(table(spark, y)), (1, 16)), y)


def test_parameters(spark):
    a = t.from_arrays(spark, {"a": np.array([1.0]), "b": np.array([2.0])})
    b = t.from_arrays(spark, {"b": np.array([0.5]), "c": np.array([7.0])})
    got = lambda df: {r["op_id"]: r["re"] for r in df.collect()}
    assert got(t.merge(a, b, "-")) == {"a": 1, "b": 1.5, "c": 7} == got(t.update(a, b))
    assert got(t.merge(a, b, "/"))["b"] == 4 and got(t.merge(a, b, "^"))["b"] == 2**0.5
    assert got(t.scale(2, a)) == {"a": 2, "b": 4}
    z = t.merge(t.from_arrays(spark, {"z": np.array([1 + 2j])}), t.from_arrays(spark, {"z": np.array([3 - 1j])}), "*").first()
    assert (z["re"], z["im"]) == (5, 5)
    w = t.init(spark, M(10, 20, "W"), M(5, 1, "bias"), M(3, 3, "Z", "c64"), t.Diagonal(4, "d"), seed=3)
    rows = w.collect()
    assert rows == t.init(spark, M(10, 20, "W"), M(5, 1, "bias"), M(3, 3, "Z", "c64"), t.Diagonal(4, "d"), seed=3).collect()
    by = lambda i: np.array([(r["re"], r["im"]) for r in rows if r["op_id"] == i])
    assert abs(by("W")[:, 0]).max() <= (24 / 30) ** 0.5 / 2 and by("W")[:, 0].std() > 0.1 and not by("bias").any()
    assert by("Z")[:, 1].any() and (by("d")[:, 0] >= 0).all() and len(by("W")) == 200
    with pytest.raises(t.OperatorError):
        t.init(spark, M(2, 2, "x"), M(3, 3, "x"))


def test_gradients(spark):
    """Against finite differences of 0.5 |A x|^2, and closed forms for complex values."""
    w, x = draw(3, 4), draw(5, 4)
    p = t.from_arrays(spark, {"W": w})
    a = M(3, 4, "W").bind(p)
    y = a.apply(table(spark, x))
    g = np.zeros((3, 4))
    for r in t.grad_params(a, table(spark, x), y).collect():
        g[r["i"], r["j"]] = r["re"]
    loss = lambda m: 0.5 * ((x @ m.T) ** 2).sum()
    for i, j in np.ndindex(3, 4):
        e = np.zeros((3, 4))
        e[i, j] = 1e-6
        assert (loss(w + e) - loss(w - e)) / 2e-6 == pytest.approx(g[i, j], rel=1e-5, abs=1e-6)
    np.testing.assert_allclose(array(t.grad_input(a, y), (5, 4)), x @ w.T @ w, atol=1e-9)
    z = draw(2, 4, complex_=True)
    d = t.Diagonal(4, "d", "c64")
    up = draw(2, 4, complex_=True)
    got = {r["i"]: complex(r["re"], r["im"]) for r in t.grad_params(d, table(spark, z), table(spark, up)).collect()}
    np.testing.assert_allclose([got[i] for i in range(4)], (up * z.conj()).sum(axis=0), atol=1e-9)
    op = t.Tensor(("i", "o", "t"), (2, 3, 4), ("i", "t"), (2, 4), ("o", "t"), (3, 4), "T")
    xs, ys = draw(2, 8), draw(2, 12)
    got = np.zeros(24)
    for r in t.grad_params(op, table(spark, xs), table(spark, ys)).collect():
        got[r["i"]] = r["re"]
    cube = lambda v, s: np.stack([q.reshape(s, order="F") for q in v])
    want = np.einsum("bit,bot->iot", cube(xs, (2, 4)), cube(ys, (3, 4))).reshape(-1, order="F")
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_bound_and_broadcast(spark):
    op = t.kron(M(2, 3, "A"), M(2, 2, "B")).with_order((1, 0))
    wrapped = t.broadcasted(op)
    assert all(isinstance(c, t.Broadcasted) for c in wrapped.ops)
    p = t.from_arrays(spark, {"A": draw(2, 3), "B": draw(2, 2)})
    x = table(spark, draw(2, 6))
    np.testing.assert_allclose(array(wrapped.bind(p).apply(x), (2, 4)), array(op.bind(p).apply(x), (2, 4)))
    assert op.bind(p).parametricity == "parameterized" and op.bind(p).order == (1, 0)
    with pytest.raises(t.OperatorError):
        t.Bound(t.Identity(2), p)


def test_one_shuffle_when_dealt_by_item(spark):
    op = t.kron(M(2, 4, "A"), M(2, 4, "B"), M(2, 4, "C")).bind(t.from_arrays(spark, {k: draw(2, 4) for k in "ABC"}))
    # more rows than collapse to one partition
    df = spark.range(64 * 64).selectExpr("id div 64 AS b", "CAST(id % 64 AS INT) AS idx", "CAST(id AS DOUBLE) AS re")
    plan = lambda **o: op.apply(df, **o)._jdf.queryExecution().executedPlan().toString()
    assert plan(partitions=8).count("Exchange hashpartitioning") == 1
    assert plan().count("Exchange hashpartitioning") == 3


def test_stream(spark, tmp_path):
    from tensorloom.streaming.apply import apply_each_batch

    table(spark, np.arange(6.0).reshape(2, 3)).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("b long, idx int, re double").parquet(str(tmp_path / "in"))
    op = t.Restriction(3, ((1, 3),))
    writer = apply_each_batch(op, source, lambda df, epoch: df.write.mode("overwrite").parquet(str(tmp_path / f"out/epoch={epoch}")))
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    np.testing.assert_allclose(array(out, (2, 2)), [[1, 2], [4, 5]])


def test_array_views(spark):
    x = draw(2, 24)
    df = table(spark, x)
    turned, shape = t.rotate_axes(df, (2, 3, 4), 1)
    want = np.stack([np.transpose(v.reshape(2, 3, 4, order="F"), (1, 2, 0)).reshape(-1, order="F") for v in x])
    assert shape == (3, 4, 2)
    np.testing.assert_array_equal(array(turned, (2, 24)), want)
    np.testing.assert_array_equal(array(t.from_matrix(t.as_matrix(df, (2, 3, 4)), (2, 3, 4)), (2, 24)), x)
    assert not array(t.zeros_like(df), (2, 24)).any() and not array(t.zeros(df.select("b").distinct(), 5, True), (2, 5)).any()
    assert t.cpu(df) is df is t.gpu(df)
    y = table(spark, np.array([[-1.0, 0.0, 2.0]])).select("b", "idx", t.gelu(F.col("re")).alias("re"))
    np.testing.assert_allclose(array(y, (1, 3)).real, [[-0.158808, 0, 1.954598]], atol=1e-6)


def test_parameter_arithmetic(spark):
    """Division and powers as IEEE doubles and complex numbers have them."""
    one = lambda z: t.from_arrays(spark, {"z": np.array([z])})
    got = lambda a, b, op: complex(*t.merge(one(a), one(b), op).select("re", "im").first())
    assert got(3.0, 0.0, "/").real == np.inf and got(-3.0, 0.0, "/").real == -np.inf and np.isnan(got(0.0, 0.0, "/").real)
    assert got(1e200, 1e200, "/") == 1 and got(1e200 + 1e200j, 1e200 + 1e200j, "/") == pytest.approx(1)
    for a, b in [(1 + 2j, 3 - 1j), (2j, 1e-3), (1.0, 4j)]:
        assert got(a, b, "/") == pytest.approx(a / b)
    for a, b in [(1 + 2j, 2), (2j, 1 - 1j), (-1 + 0.5j, 0.5)]:
        assert got(a, b, "^") == pytest.approx(a**b)
    assert got(0j, 1j, "^") == 0 and got(2.0, 3.0, "^") == 8 and np.isnan(got(-1.0, 0.5, "^").real)


def tree_cases():
    c = lambda i, j, op_id: M(i, j, op_id, "c64")
    yield t.compose(M(3, 4, "A"), t.Diagonal(4, "d"), M(4, 5, "B"))
    yield t.kron(M(2, 3, "A"), M(3, 2, "B"), M(2, 2, "C"))
    yield t.compose(M(3, 4, "A").H, t.broadcasted(M(3, 2, "B")), t.Diagonal(2, "d").H)
    yield t.compose(t.kron(c(2, 3, "A"), t.Diagonal(4, "d", "c64")), t.kron(t.Fourier(3), t.Restriction(5, ((0, 2), (3, 5)), "c64")), t.kron(t.Fourier(3, "c64"), t.Fourier(8, "f64")))
    modes = t.kron(t.Restriction(3, ((0, 2),), "c64"), t.Restriction(5, ((0, 2), (3, 5)), "c64")) @ t.kron(t.Fourier(4, "f64"), t.Fourier(5, "c64"))
    yield t.compose(modes.H, t.Diagonal(8, "d", "c64"), modes)
    yield t.compose(t.Restriction(4, ((0, 3), (1, 3))).H, M(5, 4, "A"), t.Restriction(4, ((0, 3), (1, 2))), M(4, 4, "A2"))
    yield t.compose(t.Tensor(("i", "o", "q"), (2, 3, 2), ("i", "p"), (2, 4), ("o", "p"), (3, 4), "T"), M(8, 3, "A"))
    yield t.Tensor(("i", "o"), (2, 3), ("o",), (3,), ("i",), (2,), "T").H @ M(2, 2, "A")


@pytest.mark.parametrize("k", range(8))
def test_gradients_of_trees(spark, k):
    """Against finite differences of the real product of output and upstream gradient."""
    from tensorloom.plans.lower import evaluate

    op = list(tree_cases())[k]
    rng = np.random.default_rng(k)
    number = lambda shape, c: rng.normal(size=shape) + (1j * rng.normal(size=shape) if c else 0)
    w = {i: number(leaf.shape if isinstance(leaf, t.Matrix) else int(np.prod(leaf.shape)), leaf.dtype[0] == "c") for i, leaf in op.slots().items()}
    x, up = number((3, op.domain), op.ddt[0] == "c"), number((3, op.range), op.rdt[0] == "c")
    params = t.from_arrays(spark, w)
    got = {i: np.zeros(v.shape, complex) for i, v in w.items()}
    for r in t.grad_params(op.bind(params), table(spark, x), table(spark, up)).collect():
        at = (r["i"], r["j"]) if got[r["op_id"]].ndim == 2 else r["i"]
        got[r["op_id"]][at] = complex(r["re"], r["im"])
    tree = t.plans.lower._stripped(op)
    loss = lambda v: float((evaluate(tree, x, v) * up.conj()).real.sum())
    for i, v in w.items():
        for at in np.ndindex(v.shape):
            for part in (1, 1j) if np.iscomplexobj(v) else (1,):
                e = np.zeros(v.shape, v.dtype)
                e[at] = part * 1e-6
                slope = (loss({**w, i: v + e}) - loss({**w, i: v - e})) / 2e-6
                assert slope == pytest.approx(got[i][at].imag if part == 1j else got[i][at].real, rel=1e-4, abs=1e-5)
    # the input's gradient, on the driver and as a table
    pulled = array(t.pullback(op.bind(params), table(spark, up)), x.shape)
    grads = {}
    back = t.functions.gradients.taped(tree, x, w, grads)[1](up)
    for at in [(0, 0), (2, op.domain - 1)]:
        e = np.zeros(x.shape, x.dtype)
        e[at] = 1e-6
        slope = ((evaluate(tree, x + e, w) - evaluate(tree, x - e, w)) * up.conj()).real.sum() / 2e-6
        assert slope == pytest.approx(back[at].real, rel=1e-4, abs=1e-5)
    np.testing.assert_allclose(pulled, back, atol=1e-9)
    # and both by joins, without a broadcast
    again = {i: np.zeros(v.shape, complex) for i, v in w.items()}
    with mock.patch("tensorloom.operators.nodes.BROADCAST_BYTES", 0):
        for r in t.grad_params(op.bind(params), table(spark, x), table(spark, up)).collect():
            again[r["op_id"]][(r["i"], r["j"]) if again[r["op_id"]].ndim == 2 else r["i"]] = complex(r["re"], r["im"])
        np.testing.assert_allclose(array(t.pullback(op.bind(params), table(spark, up)), x.shape), back, atol=1e-9)
    for i, v in got.items():
        np.testing.assert_allclose(again[i], v, atol=1e-9)


def test_gradients_through_a_reduction(spark):
    """A reduction's gradient is each worker's own, for a leaf alone, in a tree, in LONG and in arrays."""
    up = spark.createDataFrame([(r, k, float(r + k)) for r in range(3) for k in range(4)], "rank int, idx int, re double")
    rows = lambda df: sorted(map(tuple, df.select("rank", "idx", "re").collect()))
    assert rows(t.pullback(t.Reduce(), up)) == rows(up)
    d = t.Diagonal(4, "d").bind(t.from_arrays(spark, {"d": np.arange(4.0)}))
    op = t.compose(t.Reduce(), d)
    assert rows(t.pullback(op, up)) == sorted((r, k, float((r + k) * k)) for r in range(3) for k in range(4))
    got = {r["i"]: r["re"] for r in t.grad_params(op, up, up).collect()}
    assert got == {k: float(sum((r + k) ** 2 for r in range(3))) for k in range(4)}
    arrays = t.dense_of(up)
    assert sorted(map(tuple, t.long_of(t.pullback(op, arrays)).collect())) == rows(t.pullback(op, up))
    assert {r["i"]: r["re"] for r in t.grad_params(op, arrays, arrays).collect()} == got


@pytest.mark.parametrize("dtype, norm", [("c64", "backward"), ("f64", "ortho"), ("f64", "backward")])
def test_transforms_in_factors(spark, dtype, norm):
    """Axes of more than a piece, in two or three factors, there and back, within a product, and their derivative."""
    from tensorloom.plans.lower import evaluate

    n = 12 if dtype == "f64" else 18
    short, f = t.Fourier(n, dtype, norm), t.Fourier(n, dtype, norm, 4 if n == 12 else 3)
    x = draw(2, n, complex_=dtype == "c64")
    y = evaluate(short, x, {})
    np.testing.assert_allclose(array(f.apply(table(spark, x)), y.shape), y, atol=1e-9)
    np.testing.assert_allclose(array(f.H.apply(table(spark, y)), x.shape), x, atol=1e-9)
    np.testing.assert_allclose(array(t.pullback(f, table(spark, y), joins=True), x.shape), array(t.pullback(short, table(spark, y)), x.shape), atol=1e-9)
    op = lambda g: t.kron(t.Fourier(3, "c64"), g)
    z = draw(2, 3 * n, complex_=dtype == "c64")
    want = evaluate(op(short), z, {})
    np.testing.assert_allclose(array(op(f).apply(table(spark, z)), want.shape), want, atol=1e-9)
    with pytest.raises(t.OperatorError, match="no factor"):
        t.Fourier(17, dtype, norm, 4).apply(table(spark, draw(1, 17, complex_=dtype == "c64")))


def test_training_step(spark):
    """Steps down the gradient of a squared error through two layers lower it, and the parameters' table stays one table."""
    rng = np.random.default_rng(2)
    modes = t.kron(t.Restriction(3, ((0, 2),), "c64"), t.Restriction(4, ((0, 1), (3, 4)), "c64")) @ t.kron(t.Fourier(4, "f64"), t.Fourier(4, "c64"))
    layer = lambda k: t.compose(modes.H, t.Diagonal(4, f"g{k}", "c64"), modes)
    x, target = table(spark, rng.normal(size=(6, 16))), table(spark, rng.normal(size=(6, 16)))
    params = t.init(spark, layer(0), layer(1), seed=4)
    errors = []
    for _ in range(3):
        rows = params.toArrow()
        params = spark.createDataFrame(rows)  # a small table; on a cluster it is written and read
        first, second = (layer(k).bind(params) for k in (0, 1))
        h = first.apply(x)
        y = second.apply(h)
        off = y.alias("y").join(target.alias("t"), ["b", "idx"]).select("b", "idx", (F.col("y.re") - F.col("t.re")).alias("re"))
        errors.append(off.agg(F.sum(F.col("re") * F.col("re"))).first()[0])
        grads = t.grad_params(second, h, off).unionByName(t.grad_params(first, x, t.pullback(second, off)))
        params = t.update(params, t.scale(0.1, grads))
    assert errors[0] > errors[1] > errors[2] and params.count() == 8


def test_gradients_with_null_keys(spark):
    a = M(1, 1, "W").bind(t.from_arrays(spark, {"W": np.array([[2.0]])}))
    x = spark.createDataFrame([(None, 0, 3.0), (1, 0, 1.0)], "b long, idx int, re double")
    assert t.grad_params(a, x, a.apply(x)).first()["re"] == 20
    assert t.grad_params(a, x.drop("b").limit(1), x.drop("b").limit(1)).first()["re"] in (1, 9)


def test_large_parameters_by_joins(spark, monkeypatch):
    from tensorloom.operators import nodes

    monkeypatch.setattr(nodes, "BROADCAST_BYTES", 1)
    w, x = draw(3, 4), draw(5, 4)
    a = M(3, 4, "W").bind(t.from_arrays(spark, {"W": w}))
    y = x @ w.T
    got = {(r["i"], r["j"]): r["re"] for r in t.grad_params(a, table(spark, x), table(spark, y)).collect()}
    np.testing.assert_allclose([[got[i, j] for j in range(4)] for i in range(3)], y.T @ x, atol=1e-9)
    v = draw(4, 4)
    tree = a @ M(4, 4, "V").bind(t.from_arrays(spark, {"V": v}))
    got = {(r["op_id"], r["i"], r["j"]): r["re"] for r in t.grad_params(tree, table(spark, x), table(spark, y)).collect()}
    np.testing.assert_allclose([[got["W", i, j] for j in range(4)] for i in range(3)], y.T @ (x @ v.T), atol=1e-9)
    np.testing.assert_allclose([[got["V", i, j] for j in range(4)] for i in range(4)], (y @ w).T @ x, atol=1e-9)


def test_distribution_moves_rows_once(spark):
    """Moves between grids inside of an expression cost no exchange; the last one does."""
    op = t.distribute(t.kron(M(2, 4, "A"), M(2, 4, "B"), M(2, 4, "C")), (2, 2, 1), (1, 2, 2)).bind(t.from_arrays(spark, {k: draw(2, 4) for k in "ABC"}))
    df = spark.range(64 * 64).selectExpr("id div 64 AS b", "CAST(id % 64 AS INT) AS idx", "CAST(id AS DOUBLE) AS re")
    plan = op.apply(df, partitions=8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange ") - plan.count("BroadcastExchange") == 2


def test_cheapest_order_of_many_operands():
    k = t.kron(*[M(3 + i * 7 % 5, 4 + i * 3 % 7, f"m{i}") for i in range(5)])
    from itertools import permutations

    from tensorloom.plans.rewrite import best_order

    assert t.complexity(k.with_order(best_order(k.ops))) == min(t.complexity(k.with_order(p)) for p in permutations(range(5)))
    many = t.kron(*[M(3 + i * 7 % 5, 4 + i * 3 % 7, f"m{i}") for i in range(8)])
    assert t.complexity(t.optimize(many, bfs_rounds=1, bfs_threshold=1)) == t.complexity(many.with_order(best_order(many.ops)))
    assert best_order(t.kron(t.Fourier(8, "c64"), t.Fourier(8, "f64")).ops) == (1, 0)
