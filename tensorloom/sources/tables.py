"""Input tables as batches of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inputs are cut to multiples of 1 / GRID, so sums with integer weights are exact in any order.
GRID = 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dyadic(x: Column) -> Column:
    return F.floor(x.cast("double") * GRID) / GRID


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to the session's shuffle partitions, while a batch item still is one row: what follows needs no shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def vectors(spark: SparkSession, sf_dir: str, *keys: str, deal: bool = False) -> DataFrame:
    """``embeddings`` as LONG: ``(b, keys..., idx, re)``. ``deal``: items dealt to partitions before they are unfolded."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", *keys, "embedding")
    rows = dealt(rows, "vec_id") if deal else rows
    rows = rows.select(F.col("vec_id").alias("b"), *keys, F.posexplode("embedding").alias("idx", "e"))
    return rows.select("b", *keys, "idx", dyadic(F.col("e")).alias("re"))


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as DENSE: ``(b, re)``."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("b"), F.transform("embedding", dyadic).alias("re"))


def plain_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as DENSE, as they are: ``(b, re)``."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").cast("array<double>").alias("re"))


def complex_vectors(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Halves of the 64 values as real and imaginary parts of 32: ``(b, idx, re, im)``."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e = (dealt(rows, "vec_id") if deal else rows).select(F.col("vec_id").alias("b"), F.posexplode(F.arrays_zip(F.slice("embedding", 1, 32).alias("r"), F.slice("embedding", 33, 32).alias("i"))).alias("idx", "e"))
    return e.select("b", "idx", dyadic(F.col("e.r")).alias("re"), dyadic(F.col("e.i")).alias("im"))


def folded(x: DataFrame, n: int) -> DataFrame:
    """Positions counted modulo ``n``; values that meet are added up."""
    values = [F.sum(c).alias(c) for c in ("re", "im") if c in x.columns]
    return x.groupBy("b", (F.col("idx") % n).cast("int").alias("idx")).agg(*values)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of event values by user and hour of day, all 24 hours present: ``(b, idx, re)``."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("b"), F.hour("ts").alias("idx"), dyadic(F.coalesce("value", F.lit(0.0))).alias("re"))
    sums = events.groupBy("b").pivot("idx", list(range(24))).agg(F.sum("re"))
    hours = F.posexplode(F.array(*[F.coalesce(F.col(str(h)), F.lit(0.0)) for h in range(24)])).alias("idx", "re")
    return sums.select("b", hours)
