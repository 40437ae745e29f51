"""Text tables and forms of a result's first rows. Texts are made in Spark, only the shown rows come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.display import display_text, is_stack, stack_lines


def shown(df: DataFrame) -> list[T.StructField]:
    """The columns of a report: a value with a share is shown by its share alone."""
    return [f for f in df.schema if not (f.metadata or {}).get("only_share")]


def headers(df: DataFrame) -> list[str]:
    return [(f.metadata or {}).get("label") or f.name for f in shown(df)]


def texts(df: DataFrame) -> DataFrame:
    """The shown columns as display texts."""
    return df.select(*[display_text(F.col(f"`{f.name}`"), f.dataType, f.metadata).alias(f.name) for f in shown(df)])


def _cut(text: str, width: int, at_start: bool) -> str:
    if len(text) <= width:
        return text
    if width <= 3:
        return "..."[:width]
    return "..." + text[len(text) - width + 3 :] if at_start else text[: width - 3] + "..."


def _lines(cell: tuple, width: int, height: int, at_start: bool) -> list[str]:
    """A cell's lines: its text over ``height`` lines, the compact one if that is too long, or the methods of a stack."""
    text, compact, methods, compact_methods = cell
    if methods is not None:
        return [_cut(m if len(m) <= width else c, width, at_start) for m, c in zip(methods, compact_methods, strict=True)] or [""]
    text = _cut(text if len(text) <= width * height else compact, width * height, at_start)
    return [text[i : i + width] for i in range(0, max(1, len(text)), max(1, width))]


def table(df: DataFrame, *, rows: int = 100, width: int = 200, title: str | None = None, cut_start: bool = False) -> str:
    """At most ``rows`` rows in columns that share ``width``: first the narrow ones get what they need."""
    fields, names = shown(df), headers(df)
    heights = [(f.metadata or {}).get("height", 1) for f in fields]
    cells = []
    for i, (f, height) in enumerate(zip(fields, heights, strict=True)):
        c, deep = F.col(f"`{f.name}`"), is_stack(f.dataType) and height > 1
        forms = [display_text(c, f.dataType, f.metadata, compact).alias(n) for n, compact in (("text", False), ("compact", True))]
        forms += [(stack_lines(c, height, compact) if deep else F.lit(None).cast("array<string>")).alias(n) for n, compact in (("lines", False), ("short", True))]
        cells.append(F.struct(*forms).alias(f"c{i}"))
    found = df.select(*cells).limit(rows).collect()
    if not found:
        return f"No events found for '{title}'." if title else ""
    if 2 * len(names) > width:
        return f"Too many columns to fit into a width of {width}."
    need = [max(len(n), *(max(map(len, r[i][2]), default=0) if r[i][2] is not None else len(r[i][0]) for r in found)) for i, n in enumerate(names)]
    room, sizes = width - len(need) + 1, dict.fromkeys(range(len(need)), 0)
    for k, i in enumerate(sorted(sizes, key=lambda i: need[i])):
        sizes[i] = min(need[i], room // (len(need) - k))
        room -= sizes[i]
    numbers = [f.dataType.typeName() not in ("string", "struct") for f in fields]

    def put(row: list[list[str]]) -> list[str]:
        out = []
        for k in range(max(map(len, row))):
            parts = [lines[k] if k < len(lines) else "" for lines in row]
            out.append(" ".join((p.rjust if numbers[i] else p.ljust)(sizes[i]) for i, p in enumerate(parts)).rstrip())
        return out

    lines = put([[_cut(n, sizes[i], cut_start)] for i, n in enumerate(names)]) + [" ".join("-" * sizes[i] for i in range(len(names)))]
    for r in found:
        lines += put([_lines(r[i], sizes[i], heights[i], cut_start) for i in range(len(names))])
    return "\n".join(([title.center(width).rstrip(), ""] if title else []) + lines)


def form(df: DataFrame, *, title: str | None = None) -> str:
    """The first row, one ``label: value`` a line."""
    first = texts(df).limit(1).collect()
    if not first:
        return f"No events found for '{title}'." if title else ""
    lines = [f"{n}: {v}" for n, v in zip(headers(df), first[0], strict=True)]
    return "\n".join(([title, "-" * len(title)] if title else []) + lines)
