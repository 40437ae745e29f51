"""Display texts of values as column expressions: what filters on text compare and what reports show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "N/A"
PREFIXES = "kMGTPE"
#: Timespans with these values mean "no value" and "forever".
NO_TIMESPAN, FOREVER = -(1 << 63), (1 << 63) - 1


def number(c: Column) -> Column:
    """Grouped digits, three decimals at most, half-even."""
    return F.call_function("format_number", c, F.lit("#,##0.###"))


def percentage(c: Column) -> Column:
    return F.format_string("%.2f%%", c.cast("double") * 100)


def amount(c: Column, kind: str, rate: bool = False, largest: str = "E") -> Column:
    """Bytes or bits in powers of 1024, up to the ``largest`` prefix, with singular and per-second forms."""
    one, many, unit = {
        ("bytes", False): ("byte", "bytes", "B"), ("bits", False): ("bit", "bits", "bit"),
        ("bytes", True): ("byte/s", "byte/s", "B/s"), ("bits", True): ("bps", "bps", "bps"),
    }[kind, rate]
    n = c.cast("long")
    size = F.abs(n.cast("double"))
    text = F.when(F.abs(n) == 1, F.concat(n.cast("string"), F.lit(f" {one}"))).when(size < 1024, F.concat(n.cast("string"), F.lit(f" {many}")))
    exponent = F.least(F.floor(F.log(size) / F.log(F.lit(1024.0))).cast("int"), F.lit(PREFIXES.index(largest) + 1))
    scaled = F.format_string("%.1f", n / F.pow(F.lit(1024.0), exponent))
    return text.otherwise(F.concat(scaled, F.lit(" "), F.substring(F.lit(PREFIXES), exponent, F.lit(1)), F.lit(unit)))


def address(c: Column) -> Column:
    return F.format_string("0x%08X", c.cast("long"))


def hertz(c: Column) -> Column:
    return F.concat(c.cast("string"), F.lit(" Hz"))


def clock(c: Column) -> Column:
    """Time of day in the session's zone, cut to seconds."""
    return F.date_format(c, "HH:mm:ss")


def timespan(c: Column, wide: bool = False, days: bool = True) -> Column:
    """Nanoseconds with about three significant digits: ms below a second, s below a minute, then two units; without ``days`` hours go on. Wide: a decimal, for spans that no long holds."""
    second, minute, hour, day = 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9
    div = lambda x, by: F.call_function("div", x, F.lit(by))
    size = F.abs(c if wide else c.cast("long"))
    n = F.least(size, F.lit(day)).cast("long")
    digits = lambda x: F.length(x.cast("string"))
    step = F.greatest(F.pow(F.lit(10.0), digits(n) - 3), F.lit(1.0))
    below_second = (F.floor(n / step + 0.5) * step).cast("long")
    whole = (n / second).cast("long")
    milli = F.pmod(F.floor(n / 10**6), F.lit(1000))
    step_s = F.pow(F.lit(10.0), digits(whole))
    below_minute = (whole * second + F.floor(milli / step_s + 0.5) * step_s * 10**6).cast("long")
    rounded = (
        F.when(n < 1000, n).when(n < second, below_second).when(n < minute, below_minute)
        .when(n < hour, F.floor((n + second // 2) / second).cast("long") * second)
        .otherwise(F.floor((n + minute // 2) / minute).cast("long") * minute)
    )
    part = lambda unit, of=None: (F.floor(rounded / unit) % of if of else F.floor(rounded / unit)).cast("string")
    # The rounded value may belong to the next unit.
    ms = rounded / 10**6
    seconds = F.floor(rounded / 10**6) / 1000
    # Whole seconds decide how minutes and hours are rounded; no sum of them goes beyond a long.
    minutes, hours = div(div(size, second) + 30, 60), div(div(size, second) + 1800, 3600)
    in_hours = F.concat(div(minutes, 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" m"))
    in_days = F.concat(div(hours, 24).cast("string"), F.lit(" d "), (hours % 24).cast("string"), F.lit(" h"))
    # Rounded values have no digits beyond the shown ones, so the rest is cut off.
    cut = lambda text, places, all_places: F.regexp_replace(F.left(text, F.length(text) - (all_places - places)), r"\.$", "")
    text = (
        F.when(rounded == 0, F.lit("0 s"))
        .when(rounded < 1000, F.format_string("%.6f ms", ms))
        .when(rounded < second, F.concat(cut(F.format_string("%.6f", ms), 9 - digits(rounded), 6), F.lit(" ms")))
        .when(rounded < minute, F.concat(cut(F.format_string("%.3f", seconds), 3 - digits((rounded / second).cast("long")), 3), F.lit(" s")))
        .when(rounded < hour, F.concat(part(minute), F.lit(" m "), part(second, 60), F.lit(" s")))
        .when((rounded < day) if days else F.lit(True), in_hours).otherwise(in_days)
    )
    return F.when(c == FOREVER, F.lit("Indefinite")).when((c < 0) & (rounded != 0), F.concat(F.lit("-"), text)).otherwise(text)


def one_line(c: Column) -> Column:
    return F.translate(c, "\n\r\t", "   ")


def class_name(c: Column) -> Column:
    """A class name; array descriptors such as ``[I`` or ``[Lx.Y;`` in source form."""
    letters = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean"}
    dimensions = F.length(F.regexp_extract(c, r"^(\[+)", 1))
    element = F.regexp_replace(c, r"^\[+", "")
    base = F.when(element.startswith("L"), F.regexp_replace(element, "^L|;$", ""))
    for letter, name in letters.items():
        base = base.when(element == letter, F.lit(name))
    plain = F.translate(base.otherwise(element), "/", ".")
    return F.when(dimensions > 0, F.concat(plain, F.repeat(F.lit("[]"), dimensions))).otherwise(c)


def method(c: Column, compact: bool = False) -> Column:
    """``Class.name(Type, Type)`` with simple parameter names; compact: three dots for the parameters."""
    if compact:
        inside = F.when(c["descriptor"].startswith("()"), F.lit("")).otherwise(F.lit("..."))
        return F.concat(c["type"]["name"], F.lit("."), c["name"], F.lit("("), inside, F.lit(")"))
    inner = F.regexp_extract(c["descriptor"], r"^\((.*)\)", 1)
    tokens = F.regexp_extract_all(inner, F.lit(r"(\[*(?:[BCDFIJSZ]|L[^;]*;))"), F.lit(1))
    # One dimension more makes every descriptor an array one; it is taken off again.
    names = F.transform(tokens, lambda x: F.regexp_replace(F.regexp_replace(class_name(F.concat(F.lit("["), x)), r"\[\]$", ""), r"^.*[.$]", ""))
    return F.concat(c["type"]["name"], F.lit("."), c["name"], F.lit("("), F.array_join(names, ", "), F.lit(")"))


def thread(c: Column) -> Column:
    return F.when(c["javaThreadId"] > 0, c["javaName"]).otherwise(c["osName"])


def in_java(c: Column) -> Column:
    return c["type"].isin("Interpreted", "JIT compiled", "Inlined")


def frame(c: Column, compact: bool = False) -> Column:
    return F.when(in_java(c), method(c["method"], compact)).otherwise(F.lit("<unknown>"))


def is_stack(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {"truncated", "frames"} <= set(kind.names)


def stack_lines(c: Column, height: int, compact: bool = False) -> Column:
    """The methods of the first ``height`` frames, without those that are not Java's."""
    return F.transform(F.filter(F.slice(c["frames"], 1, height), in_java), lambda f: method(f["method"], compact))


def recorded(c: Column, kind: T.DataType, compact: bool = False) -> Column | None:
    """Text of a recorded object, told by its fields; None for other structs. Compact texts are for cells that the whole one doesn't fit."""
    names = set(kind.names) if isinstance(kind, T.StructType) else set()
    named = lambda x: F.regexp_replace(class_name(x), r"^.*\.", "") if compact else class_name(x)
    if {"javaName", "osName", "javaThreadId"} <= names:
        return thread(c)
    if {"truncated", "frames"} <= names:
        return frame(F.get(c["frames"], 0), compact)
    if {"method", "lineNumber"} <= names:
        return frame(c, compact)
    if {"descriptor", "type", "name"} <= names:
        return method(c, compact)
    if {"name", "classLoader"} <= names:
        return named(c["name"])
    if {"name", "typeName"} <= names:
        return named(c["typeName"])
    if {"name", "parentName"} <= names:
        return c["name"]
    return None


def display_text(c: Column, kind: T.DataType, metadata: dict | None = None, compact: bool = False) -> Column:
    """The text of any value by its type and metadata; null and the "no value" numbers give the missing text."""
    meta = metadata or {}
    what, rate, missing = meta.get("kind"), bool(meta.get("rate")), F.lit(meta.get("missing", MISSING))
    none = c.isNull()
    if isinstance(kind, T.StringType):
        return F.when(none, missing).otherwise(one_line(c))
    if isinstance(kind, T.StructType):
        text = recorded(c, kind, compact)
        return F.coalesce(text if text is not None else c.cast("string"), missing)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        none = none | F.isnan(c) | (c == float("-inf"))
    if isinstance(kind, T.LongType):
        none = none | (c == NO_TIMESPAN)
    if isinstance(kind, T.IntegerType):
        none = none | (c == -(1 << 31))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = clock(c)
    elif isinstance(kind, (T.BooleanType, T.ArrayType, T.MapType)):
        text = c.cast("string")
    elif what == "timespan":
        text = timespan(c)
    elif what == "percentage":
        text = percentage(c)
    elif what in ("bytes", "bits"):
        text = amount(c, what, rate)
    elif what == "address":
        text = address(c)
    elif rate:
        text = hertz(c)
    else:
        text = number(c)
    return F.when(none, missing).otherwise(text)
