"""Streaming ingest: events to cell counts with a watermark, and refits of what has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaming_cells(events: DataFrame, age: Column, is_case: Column, time: str = "ts", period: str = "1 day", late: str = "2 days") -> DataFrame:
    """(period_start, age_idx, population, cases) of a stream of events; late ones count until the watermark passes."""
    rows = events.select(F.col(time).cast("timestamp").alias("ts"), age.cast("int").alias("age_idx"), is_case.alias("_case")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", period).alias("w"), "age_idx").agg(F.count("*").alias("population"), F.count(F.when(F.col("_case"), 1)).alias("cases"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("period_start"), "age_idx", "population", "cases")


def refit_on_batch(fit: Callable[[DataFrame], None], closed: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands closed cells to ``fit``; empty batches are passed over.

    With ``closed``, a path on shared storage, every batch is kept there under its number (a batch that is run again
    replaces itself) and ``fit`` gets all cells closed so far; without it, the cells of the batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not batch.limit(1).count():
            return
        if closed is None:
            fit(batch)
            return
        batch.write.mode("overwrite").parquet(f"{closed}/batch={number}")
        fit(batch.sparkSession.read.parquet(closed).drop("batch"))

    return run
