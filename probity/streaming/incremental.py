"""Incremental screening with Structured Streaming: logs, queues and arriving figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probity.operators import similarity


def stage_stream(log: DataFrame, key: str = "event_id", ts: str = "completed_at", late: str = "1 day") -> DataFrame:
    """Completed stages counted per day; repeated events within the watermark count once."""
    once = log.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(ts, "1 day"), "stage", "status").agg(F.count("*").alias("events"))


def scan_arrivals(figures: DataFrame, known: DataFrame, out: str, checkpoint: str, digits: int, max_distance: int) -> StreamingQuery:
    """Compares each batch of new figures (figure_id, paper_id, phash) with all known and appends
    the matches with their batch number; a repeated batch overwrites its own part."""

    def scan(batch: DataFrame, number: int) -> None:
        found = similarity.similar_pairs(known.unionByName(batch).dropDuplicates(["figure_id"]), digits, max_distance, True, batch)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return figures.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
