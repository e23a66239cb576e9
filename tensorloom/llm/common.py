"""What the operators of this subpackage share: tables, checkpoints, column names, links and components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the bytes 0x09 to 0x0D.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that all executors share and cut its lineage.

    The folder comes from ``spark.checkpoint.dir``. Only a session on one machine
    that names none gets a temporary folder; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tensorloom-checkpoint-"))
    out = df.checkpoint()
    for made in _watching:
        made.append(out)
    return out


_watching: list[list[DataFrame]] = []


@contextmanager
def watched() -> Iterator[list[DataFrame]]:
    """The checkpoints that are made within, for ``discard`` once their last reader is done."""
    made: list[DataFrame] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching.remove(made)


def discard(*checkpoints: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more."""
    for df in checkpoints:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def word_list(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def word_count(text: str) -> Column:
    """Number of words of a text column; null counts as empty."""
    return F.size(word_list(F.col(text))).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until none clashes with a column of ``df`` in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def every(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def reshuffled(key: str) -> Column:
    """The whole number ``key`` as a join key that counts as not partitioned yet.

    For the side of a join that comes out of an aggregate by the same key. Adaptive
    execution splits hot keys only between two exchanges; without one after the
    aggregate, all rows of the other side that share a key would stay in one task.
    """
    return F.col(key).bitwiseXOR(F.lit(0))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``; component: the smallest node reachable.

    Alternates large-star and small-star steps, each an aggregate with partial
    sums and an equi-join that adaptive execution splits on hot nodes. Each
    round is checkpointed and the one before deleted; only a count and a checksum
    reach the driver. Rounds end when nothing changes, after some log^2 of the
    longest path.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    last = e = checkpointed(e.distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(reshuffled("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: neighbours above u point to the smallest node around u
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours at or below u, and u itself, point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(reshuffled("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select("u", "b", "m")
        e = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, e = last, checkpointed(e.distinct())
        discard(before)
        last = e
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
