"""Recordings of a JVM, printed as JSON by the JDK's own tool, as event types.

The printed file holds one object with ``recording.events``: each event a ``type`` and
``values``. One JSON document is one row to Spark, and so one task; a large recording
is better given with one event a line (``lines``), which Spark splits. With
``into``, events are parsed once and written as Parquet by type, and each type reads
only its own files. Durations in ISO form turn into nanoseconds, ISO times into timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, EventType

_DURATION = r"^(-?)PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?$"


def nanoseconds(c):
    """Nanoseconds of an ISO duration such as PT1M2.5S."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, _DURATION, i), F.lit("")).cast("long"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(c, _DURATION, 5), 9, "0").cast("long")
    whole = ((part(2) * 60 + part(3)) * 60 + part(4)) * 1_000_000_000 + F.coalesce(fraction, F.lit(0))
    return F.when(c.rlike(_DURATION), F.when(F.regexp_extract(c, _DURATION, 1) == "-", -whole).otherwise(whole))


def _events(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """``type``, ``values`` and ``place``, a text that sorts as the events stand: file, start of the block, number within it."""
    if lines:
        # Numbers grow within a task, and one task reads all of a block.
        block, number, event, d = F.col("_metadata.file_block_start"), F.monotonically_increasing_id(), ("type", "values"), spark.read.json(path)
        d = d.select(F.col("_metadata.file_path").alias("file"), block.alias("block"), number.alias("number"), *event)
    else:
        d = spark.read.option("multiLine", True).json(path)
        d = d.select(F.col("_metadata.file_path").alias("file"), F.lit(0).alias("block"), F.posexplode("recording.events").alias("number", "event"))
        d = d.select("file", "block", "number", "event.type", "event.values")
    padded = [F.lpad(F.col(c).cast("string"), 20, "0") for c in ("block", "number")]
    return d.select(F.concat_ws(":", "file", *padded).alias("place"), "type", "values")


def recording(spark: SparkSession, path: str, timespans: tuple[str, ...] = ("duration",), times: tuple[str, ...] = ("startTime",), *, lines: bool = False, into: str | None = None, type_ids: dict[str, int] | None = None) -> Catalog:
    """A catalog of the printed recording's event types, each with ``startTime``, ``endTime`` and the order in the file.

    ``into`` is a folder that all executors share; ``type_ids`` are the numbers that settings name types by, which the printed form lacks.
    """
    events = _events(spark, path, lines)
    if into:
        events.write.mode("overwrite").partitionBy("type").parquet(into)
        events = spark.read.parquet(into)
    catalog = Catalog()
    # All types share one inferred struct; a type has the fields that any of its events fills. A few hundred rows at most.
    fields = events.schema["values"].dataType.names  # type: ignore[union-attr]
    filled = events.groupBy("type").agg(*[F.max(F.col(f"values.`{f}`").isNotNull()).alias(f"f{i}") for i, f in enumerate(fields)])
    for name, *has in sorted(filled.where("type is not null").collect()):
        own = [F.col(f"values.`{f}`").alias(f) for f, h in zip(fields, has, strict=True) if h]
        d = events.where(F.col("type") == name).select("place", *own)
        for c in d.columns:
            if c in times:
                d = d.withColumn(c, F.to_timestamp(c))
            elif c in timespans:
                d = d.withColumn(c, nanoseconds(F.col(c)).alias(c, metadata={"kind": "timespan"}))
        if "duration" in d.columns and "startTime" in d.columns:
            d = d.withColumn("endTime", F.timestamp_micros(F.unix_micros("startTime") + F.coalesce(F.call_function("div", F.col("duration"), F.lit(1000)), F.lit(0))))
        catalog.add(EventType(name, d, ("startTime", "place") if "startTime" in d.columns else ("place",), "startTime" if "startTime" in d.columns else None, "endTime" if "endTime" in d.columns else None, id=(type_ids or {}).get(name)))
    return catalog
