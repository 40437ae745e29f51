"""Listings of the catalog: its event types with their counts, and the fields of a type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, QueryError


def show_events(catalog: Catalog) -> DataFrame:
    """``event_type`` and ``event_count`` (null: none) of each type that isn't experimental, by name."""
    shown = [t for t in catalog.types.values() if not t.experimental]
    if not shown:
        raise QueryError("the catalog has no event types")
    counts = [t.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t.name).alias("event_type"), F.when(F.col("n") > 0, F.col("n")).alias("event_count")) for t in shown]
    return reduce(DataFrame.unionByName, counts).orderBy("event_type")


def show_fields(spark: SparkSession, catalog: Catalog, name: str) -> DataFrame:
    """``position``, ``field``, ``type``, ``kind`` and ``label`` of a type's fields; the name counts letter by letter."""
    event = catalog.types.get(name) or next((t for n, t in catalog.types.items() if n.rsplit(".", 1)[-1] == name), None)
    if event is None:
        catalog.find(name)
        raise QueryError(f"{name} is a pattern; fields are listed for one type")
    rows = [(i, f.name, f.dataType.simpleString(), (f.metadata or {}).get("kind"), (f.metadata or {}).get("label")) for i, f in enumerate(event.df.schema)]
    return spark.createDataFrame(rows, "position int, field string, type string, kind string, label string")


def related(catalog: Catalog, name: str) -> list[str]:
    """Types that share a relational field (metadata ``relation``) with the named one."""
    own = {f.metadata["relation"] for f in catalog.types[name].df.schema if (f.metadata or {}).get("relation")}
    return sorted(n for n, t in catalog.types.items() if n != name and own & {(f.metadata or {}).get("relation") for f in t.df.schema})
