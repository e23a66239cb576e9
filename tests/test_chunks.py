"""Items in blocks against NumPy."""

import numpy as np
import pytest

import tensorloom as t
from tensorloom.operators.leaves import Repartition
from tensorloom.plans.chunks import chunked, matrix_blocks, moved_blocks, pieces, rotated_blocks, whole_items
from tensorloom.plans.grid import grid_block

RNG = np.random.default_rng(3)


def dense(spark, x):
    """Arrays with their first axis fastest; the item without values has the key null."""
    rows = [(k, f"c{k}", v.real.ravel(order="F").tolist(), v.imag.ravel(order="F").tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame([*rows, (None, "none", None, None)], "b long, c string, re array<double>, im array<double>")


def blocks_of(df):
    return {(r["b"], r["rank"]): None if r["re"] is None else np.array(r["re"]) + 1j * np.array(r["im"]) for r in df.collect()}


def cut(x, grid):
    n = int(np.prod(grid))
    out = {(k, r): v[tuple(slice(a, b) for a, b in grid_block(v.shape, grid, r))].ravel(order="F") for k, v in enumerate(x) for r in range(n)}
    return out | {(None, r): None for r in range(n)}


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (v is None) == (got[k] is None) and (v is None or np.array_equal(got[k], v)), k


@pytest.mark.parametrize("shape, source, target", [((10, 10, 10), (2, 2, 2), (8, 1, 1)), ((5, 7), (3, 2), (1, 4)), ((4,), (1,), (6,)), ((3, 2, 2), (1, 1, 1), (3, 2, 1))])
def test_moves(spark, shape, source, target):
    x = RNG.normal(size=(3, *shape)) + 1j * RNG.normal(size=(3, *shape))
    blocks = chunked(dense(spark, x).repartition(2), shape, source)
    full = {k: v for k, v in cut(x, source).items()}
    same(blocks_of(blocks), full)
    op = Repartition(shape, source, target)
    sent = pieces(op, blocks)
    pairs = sum(all(max(a, c) < min(b, d) for (a, b), (c, d) in zip(grid_block(shape, source, r), grid_block(shape, target, s))) for r in range(int(np.prod(source))) for s in range(int(np.prod(target))))
    assert sent.count() == 4 * pairs, "a row for each pair of overlapping blocks"
    there = moved_blocks(op, blocks)
    filled = {k: v for k, v in cut(x, target).items() if all(a < b for a, b in grid_block(shape, target, k[1]))}
    same(blocks_of(there), filled)
    back = moved_blocks(op.H, there)
    same(blocks_of(back), {k: v for k, v in full.items() if all(a < b for a, b in grid_block(shape, source, k[1]))})
    got = {r["b"]: r["re"] for r in whole_items(there, shape, target).collect()}
    assert got[None] is None and all(got[k] == v.real.ravel(order="F").tolist() for k, v in enumerate(x))


@pytest.mark.parametrize("by", [0, 1, 2])
def test_views(spark, by):
    shape, grid = (4, 5, 6), (2, 1, 3)
    x = RNG.normal(size=(2, *shape)) + 0j
    blocks = chunked(dense(spark, x), shape, grid)
    turned, new, parts = rotated_blocks(blocks, shape, grid, by)
    y = x.transpose(0, *[1 + (k + by) % 3 for k in range(3)])
    assert new == y.shape[1:] and parts == tuple(grid[(k + by) % 3] for k in range(3))
    same(blocks_of(turned), cut(y, parts))
    flat, new, parts = matrix_blocks(turned, new, parts)
    z = np.stack([v.reshape(y.shape[1], -1, order="F") for v in y])
    assert new == z.shape[1:]
    same(blocks_of(flat), cut(z, parts))


def test_what_is_refused(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "b long, re array<double>")
    with pytest.raises(t.OperatorError, match="same number"):
        chunked(df, (2,), (1, 1))
    with pytest.raises(Exception, match="elements where a block has 3"):
        chunked(df, (3,), (1,)).collect()
    assert chunked(df.where("false"), (2,), (2,)).count() == 0
    assert moved_blocks(Repartition((2,), (2,), (1,)), chunked(df, (2,), (2,)).where("false")).count() == 0
