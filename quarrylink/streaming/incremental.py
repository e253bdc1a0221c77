"""Incremental linking: new query records of a stream against a fixed index (an extension; batch results are the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarrylink.operators.index import Index
from quarrylink.plans import resolve


def link_stream(queries: DataFrame, built: Index, settings: resolve.Settings, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each micro-batch's candidates as one partition of ``out``; a batch that runs again replaces its own."""

    def link(batch: DataFrame, number: int) -> None:
        pairs = resolve.candidates(resolve.normalised(batch), built, settings)
        pairs.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
