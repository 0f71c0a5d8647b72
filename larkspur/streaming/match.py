"""Matches a stream of entries with a static library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.match import index_entries, match


def match_stream(entries: DataFrame, tracks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the matches of each micro-batch as Parquet below ``out``, one folder for each batch, so a
    batch that is repeated after a failure replaces its own result."""

    def one(batch: DataFrame, epoch: int) -> None:
        match(index_entries(batch), tracks).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
