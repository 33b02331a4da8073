"""The scan over streams: it holds no state, so a stream of texts is scanned as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bandscan.plans.match import CHUNK, match


def start_matching(patterns: DataFrame, texts: DataFrame, path: str, checkpoint: str, metric: str = "compat", unit: str = "byte", chunk: int = CHUNK, **trigger):
    """Scans a streaming table (text_id, text) against static patterns and appends results as Parquet.

    Each micro-batch is written to a folder of its number, overwritten if the
    batch is repeated, so results arrive exactly once. trigger: as for
    DataStreamWriter.trigger, everything available by default.
    """

    def one(batch: DataFrame, number: int) -> None:
        match(patterns, batch, metric, unit, chunk=chunk).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
