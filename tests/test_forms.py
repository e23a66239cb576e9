"""What expressions say of themselves, without a table: costs, hashes, texts, traits and initial values, each beside SQL values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tensorloom.functions.params import init
from tensorloom.functions.render import dot_string, latex_string
from tensorloom.operators import leaves as L
from tensorloom.operators import nodes as N
from tensorloom.operators.base import OperatorError
from tensorloom.plans import types
from tensorloom.plans.cost import complexity, local_complexity
from tensorloom.plans.grid import block_of, cumulative_ranges, range_axes
from tensorloom.plans.rewrite import Optimizer, merkle_hash, transforms
from tensorloom.queries import _params
from tensorloom.sources import tables
from tensorloom.sources.json_codec import from_json, to_json

FORMS = {}


def _query(sql):
    def add(f):
        FORMS[f.__name__] = (f, sql)
        return f

    return add


_TEX = r"(\mathrm{Matrix}(4 \rightarrow 2)\ast \mathrm{Diagonal}(4 \rightarrow 4))\otimes(\mathrm{Matrix}(3 \rightarrow 5)^\top)"
_DOT = r'digraph g {NEWTAdjoint_1 [label="Adjoint #1"];NEWTMatrix_1 [label="Matrix #1\nid = M"];NEWTAdjoint_1 -> Matrix_1;NEW}'


def _cost_cases():
    a, b, c = L.Matrix(10, 20, "A"), L.Matrix(30, 50, "B"), L.Matrix(60, 90, "C")
    k = N.kron(c, b, a)
    yield "greedy", k
    yield "optimized", Optimizer(k).run()
    f = N.kron(*[L.Fourier(n) for n in (12, 14, 16)])
    m = N.kron(*[L.Matrix(8, n, f"M{n}", "c64") for n in (12, 14, 16)])
    yield "unfused", N.compose(m, f)
    yield "fused", next(x for x in transforms(N.compose(m, f)) if isinstance(x, N.Kron))
    chain = [L.Matrix(3, 3, f"c{i}") for i in range(7)]
    nested = chain[0]
    for x in chain[1:]:
        nested = N.composed([nested, x])
    yield "nested chain", nested
    yield "flat chain", Optimizer(nested).run()


@_query("SELECT name, CAST(cost AS DOUBLE) AS cost FROM (VALUES ('greedy', 15120000), ('optimized', 7740000), ('unfused', 276090.19694), ('fused', 228089.34814), ('nested chain', 126.00006), ('flat chain', 126.00001)) t(name, cost)")
def optimizer_cost_table(spark, d):
    return spark.createDataFrame([(k, round(complexity(op), 5)) for k, op in _cost_cases()], "name string, cost double")


@_query("SELECT 'same' AS name, true AS equal UNION ALL SELECT 'shape', false UNION ALL SELECT 'type', false UNION ALL SELECT 'structure', false UNION ALL SELECT 'order', false UNION ALL SELECT 'wrapper', false")
def merkle_table(spark, d):
    m = lambda i, j, k="f64", op_id="x": L.Matrix(i, j, op_id, k)
    k = N.kron(m(4, 4), m(4, 8))
    pairs = {
        "same": (m(4, 4, op_id="x"), m(4, 4, op_id="y")),
        "shape": (m(4, 4), m(4, 8)),
        "type": (m(4, 4), m(4, 4, "f32")),
        "structure": (N.compose(m(4, 4), m(4, 4)), N.kron(m(4, 4), m(4, 4))),
        "order": (k.with_order((0, 1)), k.with_order((1, 0))),
        "wrapper": (N.Adjoint(m(4, 4)), N.broadcasted(m(4, 4))),
    }
    return spark.createDataFrame([(n, merkle_hash(a) == merkle_hash(b)) for n, (a, b) in pairs.items()], "name string, equal boolean")


@_query(f"SELECT 'latex' AS name, '{_TEX}' AS text UNION ALL SELECT 'dot', replace(replace('{_DOT}', 'NEWT', chr(10) || chr(9)), 'NEW', chr(10))")
def render_table(spark, d):
    op = N.kron(N.compose(L.Matrix(2, 4, "A"), L.Diagonal(4, "d")), L.Matrix(5, 3, "M").H)
    dot = dot_string(L.Matrix(5, 3, "M").H, {"id": lambda o: o.op_id})
    return spark.createDataFrame([("latex", latex_string(op)), ("dot", dot)], "name string, text string")


@_query("SELECT name, CAST(cost AS DOUBLE) AS cost FROM (VALUES ('add f16', 0.25), ('add f32', 1.5), ('add f64', 1), ('add c16', 0.5), ('add c32', 1), ('add c64', 2), ('multiply f64', 2), ('multiply c64', 4), ('transfer 3 bytes', 300), ('identity', 0), ('restriction', 0), ('tensor', 48), ('reduce', 1), ('repartition', 9600), ('local half', 16), ('local all', 32)) t(name, cost)")
def cost_table(spark, d):
    """Unit costs and the costs of single leaves, whole and on one of two workers."""
    costs = {f"add {k}": types.addition_cost(k) for k in types.NAMES}
    costs |= {f"multiply {k}": types.multiplication_cost(k) for k in ("f64", "c64")}
    m = L.Matrix(4, 4, "A")
    costs |= {
        "transfer 3 bytes": types.transfer_cost(3), "identity": complexity(L.Identity(4)), "restriction": complexity(L.Restriction(8, ((0, 2),))), "tensor": complexity(L.Tensor(("i", "o"), (4, 6), ("i",), (4,), ("o",), (6,), "T")),
        "reduce": complexity(L.Reduce()), "repartition": complexity(L.Repartition((4, 4), (4, 1), (1, 4))), "local half": local_complexity(N.Distributed(m, 0, 2)), "local all": local_complexity(m),
    }
    return spark.createDataFrame([(k, float(v)) for k, v in costs.items()], "name string, cost double")


@_query("SELECT name, text FROM (VALUES ('matrix', '{\"type\": \"ParMatrix\", \"m\": 4, \"n\": 5, \"T\": \"Float64\", \"id\": \"W\"}'), ('restriction', '{\"type\": \"ParRestriction\", \"n\": 8, \"ranges\": [[1, 2], [7, 8]], \"T\": \"Float64\"}'), ('adjoint', '{\"type\": \"ParAdjoint\", \"of\": {\"type\": \"ParDFT\", \"n\": 4, \"m\": 3, \"T\": \"Float32\"}}'), ('no type', 'OperatorError'), ('unknown type', 'OperatorError'), ('unknown element', 'OperatorError'), ('wrong length', 'OperatorError'), ('no form', 'OperatorError'), ('no program', 'OperatorError')) t(name, text)")
def text_forms(spark, d):
    """JSON texts, and what is refused when reading, writing or drawing."""
    from tensorloom.functions.render import plot_operator_graph

    def tried(make) -> str:
        try:
            return str(make())
        except OperatorError as e:
            return type(e).__name__

    forms = {
        "matrix": lambda: to_json(L.Matrix(4, 5, "W")), "restriction": lambda: to_json(L.Restriction(8, ((0, 2), (6, 8)))), "adjoint": lambda: to_json(L.Fourier(4, "f32").H),
        "no type": lambda: from_json("{}"), "unknown type": lambda: from_json('{"type": "Nothing"}'), "unknown element": lambda: from_json('{"type": "ParIdentity", "T": "Int8", "n": 4}'),
        "wrong length": lambda: from_json('{"type": "ParDFT", "T": "Float64", "n": 4, "m": 4}'), "no form": lambda: to_json(L.Reduce()), "no program": lambda: plot_operator_graph(L.Identity(1), "x", program="no such program"),
    }
    return spark.createDataFrame([(k, tried(f)) for k, f in forms.items()], "name string, text string")


@_query("SELECT name, CAST(value AS VARCHAR) AS value FROM (VALUES ('flattened', '4'), ('as given', '2'), ('single', 'Matrix'), ('parametric', 'parametric'), ('bound', 'parameterized'), ('free', 'nonparametric'), ('mixed', 'parametric'), ('linear', 'linear'), ('leaf', 'external'), ('node', 'internal'), ('types', 'f64 to c64'), ('lengths', '8 to 5'), ('children', '3'), ('rebuilt', 'True'), ('parameters', 'A,d'), ('mismatch', 'OperatorError'), ('negative', 'OperatorError'), ('unbound', 'OperatorError')) t(name, value)")
def traits_table(spark, d):
    """Flattening, traits, types, lengths, parameters and errors of expressions."""
    a, g, f = L.Matrix(4, 4, "A"), L.Diagonal(4, "d"), L.Fourier(8, "f64")
    nested = N.composed([a, N.composed([a, a])])
    bound = a.bind(_params(spark, a))
    k = N.kron(a, g, L.Identity(2))

    def fails(make) -> str:
        try:
            make()
        except OperatorError as e:
            return type(e).__name__
        return "nothing"

    rows = {
        "flattened": len(N.compose(N.compose(a, a), N.compose(a, a)).ops), "as given": len(nested.ops), "single": type(N.compose(a)).__name__,
        "parametric": a.parametricity, "bound": bound.parametricity, "free": f.parametricity, "mixed": N.composed([bound, a]).parametricity,
        "linear": k.linearity, "leaf": a.location, "node": k.location, "types": f"{f.ddt} to {f.rdt}", "lengths": f"{f.domain} to {f.range}",
        "children": len(k.children), "rebuilt": k.rebuild(k.children) == k, "parameters": ",".join(k.slots()),
        "mismatch": fails(lambda: N.compose(a, L.Matrix(3, 4, "B"))), "negative": fails(lambda: L.Identity(-1)), "unbound": fails(lambda: a.apply(tables.vectors(spark, d))),
    }
    return spark.createDataFrame([(n, str(v)) for n, v in rows.items()], "name string, value string")


@_query("SELECT op_id, CAST(n AS BIGINT) AS n, true AS within, zero FROM (VALUES ('W', 200, false), ('bias', 10, true), ('Z', 60, false), ('d', 30, false), ('T', 24, false)) t(op_id, n, zero)")
def params_init(spark, d):
    """Sizes of initial parameters, whether they keep their bounds and whether they are all zero."""
    ops = [L.Matrix(10, 20, "W"), L.Matrix(10, 1, "bias"), L.Matrix(6, 10, "Z", "c64"), L.Diagonal(30, "d"), L.Tensor(("i", "o"), (4, 6), ("i",), (4,), ("o",), (6,), "T")]
    most = {"W": (24 / 30) ** 0.5 / 2, "bias": 0.0, "Z": 60**-0.5, "d": 1.0, "T": 24**-0.5}
    limit = F.coalesce(*[F.when(F.col("op_id") == k, v) for k, v in most.items()])
    inside = (F.abs("re") <= limit) & (F.abs("im") <= limit)
    return init(spark, *ops).groupBy("op_id").agg(F.count(F.lit(1)).alias("n"), F.every(inside).alias("within"), F.every((F.col("re") == 0) & (F.col("im") == 0)).alias("zero"))


@_query("SELECT op_id, CAST(n AS BIGINT) AS n FROM (VALUES ('A', 12), ('B', 6), ('d', 4)) t(op_id, n)")
def params_init_tree(spark, d):
    """Initial values of a tree with inner, adjoint and broadcast nodes, one set for each id, kept by both devices."""
    from tensorloom.functions.arrays import cpu, gpu

    a, b, g = L.Matrix(3, 4, "A"), L.Matrix(2, 3, "B"), L.Diagonal(4, "d")
    tree = N.compose(N.broadcasted(N.kron(b, L.Identity(2))), N.kron(a, L.Identity(2)), N.kron(a.H, L.Identity(2)), N.kron(a, L.Identity(2)), N.kron(g, L.Identity(2)))
    return cpu(gpu(init(spark, tree))).groupBy("op_id").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT CAST(n AS INTEGER) AS n, CAST(p AS INTEGER) AS p, CAST(x AS INTEGER) AS x, CAST(CASE WHEN x < (n % p) * (n // p + 1) THEN x // (n // p + 1) ELSE n % p + (x - (n % p) * (n // p + 1)) // greatest(n // p, 1) END AS INTEGER) AS block FROM range(1, 12) a(n), range(1, 14) c(p), range(0, 11) e(x) WHERE x < n")
def block_table(spark, d):
    """Blocks of even divisions."""
    grid = spark.range(11).select((F.col("id") + 1).cast("int").alias("n"))
    parts = [grid.select("n", F.lit(p).alias("p"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x")) for p in range(1, 14)]
    out = None
    for p, df in enumerate(parts, 1):
        block = F.coalesce(*[F.when(F.col("n") == n, block_of(F.col("x"), n, p)) for n in range(1, 12)])
        df = df.select("n", "p", "x", block.alias("block"))
        out = df if out is None else out.unionByName(df)
    return out


@_query("SELECT CAST(k AS INTEGER) AS k, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM (VALUES (0, 0, 3), (1, 3, 3), (2, 3, 8), (3, 0, 2), (4, 2, 3), (5, 0, 3)) t(k, lo, hi)")
def ranges_table(spark, d):
    """Ranges of lengths 3, 0, 5, and the blocks of axes of 3 on 2 workers and 3 on 1."""
    ranges = [*cumulative_ranges([3, 0, 5]), *[r for axis in range_axes((2, 1), (3, 3)) for r in axis]]
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ranges)], "k int, lo int, hi int")


@_query("SELECT name, true AS equal FROM (VALUES ('identity'), ('diagonal'), ('matrix'), ('fourier'), ('restriction'), ('tensor'), ('adjoint'), ('compose'), ('kron')) t(name)")
def json_round_trip(spark, d):
    ops = {
        "identity": L.Identity(4),
        "diagonal": L.Diagonal(4, "d", "c32"),
        "matrix": L.Matrix(4, 5, "1c2ff6a0-5d2a-4c5e-9f10-000000000001"),
        "fourier": L.Fourier(4, "f16"),
        "restriction": L.Restriction(8, ((0, 2), (6, 8))),
        "tensor": L.Tensor(("i", "o"), (2, 3), ("i",), (2,), ("o",), (3,), "T"),
    }
    ops |= {"adjoint": ops["matrix"].H, "compose": N.compose(ops["matrix"], ops["matrix"].H), "kron": N.kron(ops["matrix"], ops["identity"]).with_order((1, 0))}
    return spark.createDataFrame([(k, from_json(to_json(op)) == op) for k, op in ops.items()], "name string, equal boolean")


@pytest.mark.parametrize("name", sorted(FORMS))
def test_form(spark, name):
    make, sql = FORMS[name]
    df = make(spark, "/root/testdata/sf0.001")
    want = duckdb.connect().execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    rows = df.select(*names)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, spark.createDataFrame(want.fetchall(), rows.schema).collect()))


@pytest.mark.parametrize("leaf", [L.Diagonal(64, "d"), L.Tensor(("i", "o", "t"), (8, 3, 8), ("i", "t"), (8, 8), ("o", "t"), (3, 8), "T")], ids=["diagonal", "tensor"])
def test_local_parts(spark, leaf):
    """Four workers, each with its own part of operator, parameter and rows, give what the whole operator gives."""
    from tensorloom.plans.distribute import global_rows, local_params, local_part, local_rows

    grid, shape, shape_out = ((4,), (64,), (64,)) if isinstance(leaf, L.Diagonal) else ((1, 4), (8, 8), (3, 8))
    params, x = _params(spark, leaf), spark.range(128).selectExpr("id DIV 64 AS b", "CAST(id % 64 AS INT) AS idx", "CAST(id % 7 AS DOUBLE) AS re")
    got = []
    for rank in range(4):
        local = local_part(leaf, grid, rank).bind(local_params(leaf, grid, rank, params))
        got += global_rows(local.apply(local_rows(x, shape, grid, rank)), shape_out, grid, rank).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, leaf.bind(params).apply(x).collect()))
