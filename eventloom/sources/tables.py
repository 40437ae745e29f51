"""Parquet tables as event types: ``tpch.*`` tables by name, and one ``app.*`` type for each kind of event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, EventType

#: name: (file, order columns, start column, columns that are percentages)
TABLES = {
    "tpch.Region": ("region", ("r_regionkey",), None, ()),
    "tpch.Nation": ("nation", ("n_nationkey",), None, ()),
    "tpch.Customer": ("customer", ("c_custkey",), None, ()),
    "tpch.Supplier": ("supplier", ("s_suppkey",), None, ()),
    "tpch.Part": ("part", ("p_partkey",), None, ()),
    "tpch.Orders": ("orders", ("o_orderdate", "o_orderkey"), "o_orderdate", ()),
    "tpch.LineItem": ("lineitem", ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), "l_shipdate", ("l_discount", "l_tax")),
}
EVENTS = ("Click", "Error", "Purchase", "Signup", "View")


def with_kinds(df: DataFrame, **kinds: dict) -> DataFrame:
    """The frame with metadata on the named columns."""
    return df.select(*[F.col(c).alias(c, metadata=kinds[c]) if c in kinds else F.col(c) for c in df.columns])


def tables(spark: SparkSession, sf_dir: str) -> Catalog:
    catalog = Catalog()
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for name, (file, order, start, shares) in TABLES.items():
        catalog.add(EventType(name, with_kinds(read(file), **{c: {"kind": "percentage"} for c in shares}), order, start))
    events = read("events")
    catalog.add(EventType("app.Events", events, ("ts", "event_id"), "ts", experimental=True))
    # Durations in ns from the value, so that timespans can be asked for.
    timed = with_kinds(events.withColumn("duration", (F.col("value") * 1_000_000).cast("long")), duration={"kind": "timespan"})
    for kind in EVENTS:
        catalog.add(EventType(f"app.{kind}", timed.where(F.col("event_type") == kind.lower()).drop("event_type"), ("ts", "event_id"), "ts"))
    return catalog
