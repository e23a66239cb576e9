"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR``: tables (default sf0.1). ``BENCH_CPUS``: threads. Each query runs
once to warm up and then three times into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tensorloom import Diagonal, Fourier, Identity, Matrix, Restriction, Tensor, compose, kron, kron_of, long_of
from tensorloom.functions.params import generated
from tensorloom.queries import QUERIES, V, W
from tensorloom.sources import tables

HEADLINE = [
    "matrix_apply", "matrix_apply_dense", "matrix_adjoint", "diagonal_apply", "rdft_apply", "cdft_apply", "irdft", "restrict_scatter", "tensor4", "tensor6",
    "reduce_sum", "repartition_blocks", "compose_chain", "kron2", "kron2_dense", "kron3", "kron_adjoint", "kron_mixed_type", "distributed_kron", "params_merge", "grad_matrix", "events_hour_dft", "spectral_convolution",
]


def dense64(spark: SparkSession, sf_dir: str, fast: bool):
    """A dense 64 x 64 matrix on all vectors, in LONG or DENSE."""
    leaf = Matrix(64, 64, "W")
    x = tables.plain_vectors(spark, sf_dir)
    x = x if fast else long_of(x)
    return leaf.bind(generated(spark, leaf, W)).apply(x, partitions=None if fast else spark.sparkContext.defaultParallelism)


def spectral_block(spark: SparkSession, sf_dir: str):
    """The same block with a diagonal over all modes and channels after a matrix of the channels."""
    ends = Restriction(64, ((0, 8), (56, 64)), "c64")
    modes = compose(kron(Restriction(11, ((0, 8),), "c64"), ends, ends, Identity(20, "c64")), kron(Fourier(20, "f64"), Fourier(64), Fourier(64), Identity(20, "c64")))
    channels, weights = Matrix(20, 20, "M", "c64"), Diagonal(40_960, "g", "c64")
    block = compose(modes.H, weights, kron(Identity(2048, "c64"), channels), modes)
    params = generated(spark, channels, W, V).unionByName(generated(spark, weights, W, V))
    return block.bind(params).apply(_arrays(spark, sf_dir, block.domain))


def _arrays(spark: SparkSession, sf_dir: str, cells: int):
    """Two arrays that the vectors of the table fill."""
    x, n = tables.vectors(spark, sf_dir), tables.read(spark, sf_dir, "embeddings").count()
    rows = spark.range(2 * cells).selectExpr(f"CAST(id DIV {cells} AS INT) AS item", f"CAST(id % {cells} AS INT) AS cell", f"(id DIV 64) % {n} AS b", "CAST(id % 64 AS INT) AS idx")
    return rows.join(F.broadcast(x), ["b", "idx"]).select(F.col("item").alias("b"), F.col("cell").alias("idx"), "re")


def spectral_full(spark: SparkSession, sf_dir: str):
    """A spectral block on two arrays of 64 x 64 x 20 with 20 channels (the fastest axis): 16 x 16 x 8 modes, from both ends
    of the full axes, channels mixed by weights of their own for each mode, and back. The vectors of the table fill the arrays."""
    ends = Restriction(64, ((0, 8), (56, 64)), "c64")
    low = kron(Restriction(11, ((0, 8),), "c64"), ends, ends)
    modes = kron_of([compose(low, kron(Fourier(20, "f64"), Fourier(64), Fourier(64))), Identity(20, "f64")])
    mix = Tensor(("o", "i", "m"), (20, 20, 2048), ("i", "m"), (20, 2048), ("o", "m"), (20, 2048), "R", "c64")
    block = compose(modes.H, mix, modes)
    return block.bind(generated(spark, mix, W, V)).apply(_arrays(spark, sf_dir, block.domain))


BASELINE = {"dense64_long": lambda s, d: dense64(s, d, False), "dense64_numpy": lambda s, d: dense64(s, d, True)}

LARGE = {"spectral_64x64x20x20": spectral_full, "spectral_block_64x64x20x20": spectral_block}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in [*BASELINE, *HEADLINE, *LARGE]:  # the large one last, as it fills memory
        query = BASELINE.get(name) or LARGE.get(name) or QUERIES[name]
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    sf = re.search(r"sf([\d.]+)/?$", sf_dir)
    print(json.dumps({"metric": "median seconds of the headline queries, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
