"""Aggregates of event queries as column expressions.

``v`` is the value, ``has`` tells which rows feed the aggregate, ``ord`` orders
the events. ``documented`` chooses the meaning that the aggregates' description
gives where it differs from their long-standing behaviour, the default.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .display import FOREVER

NANOS = 1_000_000_000
QUANTILES = {"p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.9999}
NAMES = ("value", "avg", "count", "diff", "first", "last", "last_batch", "list", "max", "median", "min", *QUANTILES, "stdev", "sum", "unique")
#: What a column's header says in front of the field's label.
LABELS = {"avg": "Avg. ", "max": "Max. ", "min": "Min. ", "sum": "Total ", "count": "Count", "unique": "Unique Count ", "p90": "P90 ", "p95": "P95 ", "p99": "P99 ", "p999": "P99.9 ", "median": "Median ", "stdev": "Std. Dev. ", "diff": "Difference ", "first": "First ", "last": "Last ", "list": "", "last_batch": "", "value": ""}


@dataclass(frozen=True)
class Value:
    """One argument: its column, type, whether it is a timespan, which rows have it, and their order."""

    v: Column
    kind: T.DataType
    has: Column
    ord: Column
    timespan: bool = False
    key: Column | None = None

    @property
    def numeric(self) -> bool:
        return isinstance(self.kind, T.NumericType)

    @property
    def fractional(self) -> bool:
        return isinstance(self.kind, (T.DoubleType, T.FloatType))

    @property
    def finite(self) -> Column:
        ok = self.has & self.v.isNotNull()
        return ok & ~F.isnan(self.v) & (F.abs(self.v) != float("inf")) if self.fractional else ok


def nothing(kind: str) -> Column:
    return F.max(F.lit(None).cast(kind))


def whole_sum(v: Column) -> Column:
    """The sum of whole numbers in 64 bits, which starts over where it would be too large."""
    half, turn = F.lit(Decimal(1 << 63)), F.lit(Decimal(1 << 64))
    total = F.sum(v.cast("decimal(19,0)"))
    return (F.pmod(total + half, turn) - half).cast("long")


def average(x: Value, documented: bool) -> Column:
    if not x.numeric:
        return nothing("double")
    if not x.timespan:
        return F.avg(F.when(x.finite, x.v.cast("double")))
    n = F.count(F.when(x.finite, F.lit(1)))
    whole = lambda total: F.call_function("div", total, F.nullif(n, F.lit(0)))
    if documented:
        return whole(F.sum(F.when(x.finite, x.v)))
    seconds = F.sum(F.when(x.finite, F.call_function("div", x.v - F.pmod(x.v, F.lit(NANOS)), F.lit(NANOS))))
    nanos = F.sum(F.when(x.finite, F.pmod(x.v, F.lit(NANOS))))
    return whole(seconds) * NANOS + whole(nanos)


def difference(x: Value, documented: bool) -> Column:
    last, first = F.max_by(x.v, F.when(x.finite, x.ord)), F.min_by(x.v, F.when(x.finite, x.ord))
    if isinstance(x.kind, (T.TimestampType, T.TimestampNTZType)):
        n = F.count(F.when(x.has & x.v.isNotNull(), F.lit(1)))
        return F.when(n == 1, F.lit(FOREVER)).when(n > 1, (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) * 1000)
    if not x.numeric or x.timespan and not documented:
        return nothing("long")
    wide = "double" if isinstance(x.kind, T.DoubleType) else "float" if isinstance(x.kind, T.FloatType) else "long"
    return (last.cast(wide) - first.cast(wide)).cast(wide)


def ranks(name: str, documented: bool) -> tuple[Column, Column]:
    """The two ranks, counted from 1, between whose values a median or quantile lies, for ``size`` values in order."""
    n = F.col("size")
    if name == "median":
        return F.floor((n + 1) / 2), F.floor(n / 2) + 1
    own = F.floor((n + 1) * F.lit(probability(name, documented)))
    return own, own + 1


def probability(name: str, documented: bool) -> float:
    return 0.999 if documented and name == "p999" else QUANTILES[name]


def between(name: str, low: Column, high: Column, size: Column, timespan: bool, documented: bool) -> Column:
    """The median or quantile from the values at its ranks: with d = (n + 1) p, low + (d - i)(high - low) for i = floor(d) - 1.

    That fraction lies between 1 and 2; the documented one is d - floor(d).
    """
    if name == "median":
        found = F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)
    else:
        d = (size + 1) * F.lit(probability(name, documented))
        share = d - F.floor(d) + (0 if documented else 1)
        found = F.when(low == high, low).otherwise(low + share * (high - low))
    return found.cast("long") if timespan else found


def aggregate(name: str, x: Value, documented: bool = False) -> Column:
    """The aggregate ``name`` of ``x``; a combination without meaning is null."""
    fed = F.when(x.has, x.v)
    if name == "value":
        order = F.when(x.has & x.v.isNotNull(), x.ord)
        return F.min_by(x.v, order) if documented else F.max_by(x.v, order)
    if name == "avg":
        return average(x, documented)
    if name == "count":
        return F.count(F.when(x.has, F.lit(1)))
    if name == "diff":
        return difference(x, documented)
    if name == "first":
        return F.min_by(x.v, F.when(x.has, x.ord))
    if name in ("last", "last_batch"):
        return F.max_by(x.v, F.when(x.has, x.ord))
    if name == "list":
        pairs = F.sort_array(F.collect_list(F.when(x.has, F.struct(x.ord.alias("o"), F.coalesce(x.v.cast("string"), F.lit("null")).alias("t")))))
        return F.array_join(F.transform(pairs, lambda p: p["t"]), ", ")
    if name in ("max", "min"):
        ordered = x.numeric or isinstance(x.kind, (T.StringType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))
        return (F.max if name == "max" else F.min)(fed) if ordered else nothing("string")
    if name == "median" or name in QUANTILES:  # those of numbers are found by rank
        return nothing("double")
    if name == "stdev":
        if not x.numeric:
            return nothing("double")
        found = F.stddev_pop(F.when(x.finite, x.v.cast("double")))
        return found.cast("long") if x.timespan else found
    if name == "sum":
        if not x.numeric:
            return nothing("long")
        return whole_sum(F.when(x.finite, x.v)) if isinstance(x.kind, T.IntegralType) else F.sum(F.when(x.finite, x.v))
    if name == "unique":
        key = x.key if x.key is not None else x.v
        missing = F.max(F.when(x.has & x.v.isNull(), F.lit(1)).otherwise(F.lit(0)))
        return F.count_distinct(F.when(x.has & x.v.isNotNull(), key)) + F.coalesce(missing, F.lit(0))
    raise ValueError(f"no aggregate is named {name}")
