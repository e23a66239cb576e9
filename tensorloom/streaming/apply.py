"""Operators on streams: each micro-batch is a batch of vectors, and no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.base import Operator


def apply_each_batch(op: Operator, stream: DataFrame, sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """A writer that applies ``op`` to every micro-batch of ``stream`` and hands the result to ``sink(df, epoch)``.

    Batch items must not be divided between micro-batches. With ``sink`` writing by
    epoch, a replayed epoch overwrites itself.
    """

    def step(df: DataFrame, epoch: int) -> None:
        sink(op.apply(df, **options), epoch)

    return stream.writeStream.foreachBatch(step)
