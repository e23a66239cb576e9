"""A training-data pipeline over ``documents``: quality, lines, near-duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.common import checkpointed, discard, table, watched
from tensorloom.llm.linededup import dedup_lines
from tensorloom.llm.minhash import keep_one
from tensorloom.llm.mixing import mixed_documents
from tensorloom.llm.packing import pack_documents
from tensorloom.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 on five-word shingles."""
    return keep_one(docs, 5, 80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in bins."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: Trained weights, MinHash and hashed draws have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage wrote on its way goes once its result is written, and so does that once it has been read."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with watched() as made:
            docs = checkpointed(stage(spark, docs, sf_dir))
        discard(*before, *made[:-1])
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
