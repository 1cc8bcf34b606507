"""Span roll-up kept up to date from an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from qassay.operators.resources import span_rollup


def start_span_rollup(spans: DataFrame, out: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Write the current roll-up after every micro-batch.

    State is one row per step. Each batch replaces the same output, so a batch that is run again after
    a failure leaves the same table.
    """

    def publish(table: DataFrame, _batch: int) -> None:
        table.write.mode("overwrite").parquet(out)

    writer = (
        span_rollup(spans).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    )
    return (writer if continuous else writer.trigger(availableNow=True)).start()
