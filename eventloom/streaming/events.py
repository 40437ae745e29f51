"""Event counts and sums of a stream in time windows, and batches that reuse the query operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog, EventType
from ..operators.query import EventQuery, run


def windowed(events: DataFrame, *, time: str, keys: Sequence[str], value: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per window and keys: ``n``, ``total``, ``least`` and ``most``; rows later than ``late`` are left out."""
    d = events.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    out = d.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total", "least", "most")


def each_batch(events: DataFrame, event: Callable[[DataFrame], EventType], query: EventQuery, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``query`` over every micro-batch and hands its rows to ``sink``; a restart continues from the checkpoint."""

    def on_batch(batch: DataFrame, number: int) -> None:
        c = Catalog()
        c.add(event(batch))
        sink(run(c, query), number)

    return events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
