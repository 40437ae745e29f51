"""Exact values at given ranks of a group, without bringing the group into one order.

Values fall into buckets of about 1/700 of their size. Counts per bucket tell which
buckets hold the wanted ranks; only rows of those are read again, equal values
of a bucket become one row with a count, and ranks are found inside the bucket. So no
task sees a whole group, however few groups there are. What one task orders are
the different values of one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets for each doubling of a value: 2.2 million for all numbers that a double can hold.
STEPS = 512
#: Moves the buckets of the smallest numbers (about 2 ** -1074) above 0; buckets of what is not finite.
LEAST, INFINITE, NO_NUMBER = 1100 * STEPS, 2200 * STEPS, 2300 * STEPS


def bucket(v: Column) -> Column:
    """A whole number that doesn't fall as ``v`` grows; NaN is above all."""
    d = v.cast("double")
    size = F.floor(F.least(F.log2(F.abs(d)) * STEPS, F.lit(float(1030 * STEPS)))) + LEAST
    infinite = F.abs(d) == float("inf")
    above = F.when(infinite, F.lit(INFINITE).cast("long")).otherwise(size)
    return F.when(F.isnan(d), F.lit(NO_NUMBER).cast("long")).when(d == 0, F.lit(0).cast("long")).when(d > 0, above).otherwise(-above)


def at_ranks(rows: DataFrame, group: Sequence[str], value: str, wanted: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each group its columns, ``size``, and for each name of ``wanted`` ``{name}_low`` and ``{name}_high``.

    These are the values (as doubles) at two ranks, counted from 1, that are expressions of ``size``;
    ranks outside of the group mean its ends. Null keys are one group. ``value`` must not be null.
    """
    d = rows.select(*group, F.col(value).alias("v"), bucket(F.col(value)).alias("b"))
    whole = W.partitionBy(*group)
    counts = d.groupBy(*group, "b").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*group, "b", "n", F.sum("n").over(whole.orderBy("b").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(whole).alias("size"))
    inside = lambda rank: (rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))
    clipped = {name: [F.greatest(F.lit(1).cast("long"), F.least(F.col("size"), r.cast("long"))) for r in pair] for name, pair in wanted.items()}
    ranks = [r for pair in clipped.values() for r in pair]
    held = counts.where(reduce(lambda a, b: a | b, map(inside, ranks)))
    held = held.select(*[F.col(g).alias(f"held_{g}") for g in group], F.col("b").alias("held_b"), (F.col("upto") - F.col("n")).alias("below"), "size")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"held_{g}")) for g in group], F.col("b") == F.col("held_b"))
    keys = [*group, "b", "below", "size"]
    values = d.join(held, same).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("below") + F.sum("n").over(W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    values = values.select(*group, "size", "n", F.col("v").cast("double").alias("v"), upto.alias("upto"))
    found = [F.max(F.when(inside(r), F.col("v"))).alias(f"{name}_{end}") for name, pair in clipped.items() for end, r in zip(("low", "high"), pair, strict=True)]
    return values.groupBy(*group).agg(F.max("size").alias("size"), *found)
