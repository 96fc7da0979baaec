"""An extension beyond batch linkage: a stream of queries is resolved against a static S1 table.

One-to-one holds within a query, so each micro-batch is independent; the S1
index is written once and reread by each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def resolve_stream(queries: DataFrame, resolve: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts a query that appends resolve(batch) to Parquet; a replayed batch replaces its own folder, so rows come once."""

    def write(batch: DataFrame, number: int) -> None:
        resolve(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
