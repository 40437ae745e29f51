"""Connected components by alternating star contractions, each round cut off in the shared folder.

Defined results: edges that repeat or lead from a node to itself change nothing;
edges with a null end are left out; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def _contracted(edges: DataFrame, *, large: bool) -> DataFrame:
    """Each node's neighbours move to its smallest neighbour: the larger ones (large) or the smaller ones and itself."""
    if large:
        e = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    else:
        e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    least = e.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    moved = e.join(least, "v")
    moved = moved.filter(F.col("u") > F.col("v")) if large else moved
    out = moved.select(F.col("u").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """``node`` and ``label``, the smallest node it reaches, for each node of an edge (columns ``a`` and ``b``)."""
    shelf = shelf or Shelf(edges.sparkSession, "components")
    digest = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    e = shelf.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    before = digest(e)
    while True:
        e = shelf.stored(_contracted(shelf.stored(_contracted(e, large=True), "edges"), large=False), "edges")
        now = digest(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
