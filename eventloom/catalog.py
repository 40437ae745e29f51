"""Event types: a DataFrame each, with its name, label, time and order columns.

A column's metadata may say what it holds: ``kind`` (timespan in ns, percentage,
bytes, bits, address), ``rate`` (per second), ``label`` and ``missing``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class QueryError(ValueError):
    """A query that names what the catalog does not have, or combines what can't be combined."""


@dataclass(frozen=True)
class EventType:
    """``order`` lists columns that together order all rows of the type; ``start`` and ``end`` are timestamp columns, ``id`` the number that settings name the type by, if any."""

    name: str
    df: DataFrame
    order: tuple[str, ...]
    start: str | None = None
    end: str | None = None
    label: str = ""
    experimental: bool = False
    id: int | None = None

    def __post_init__(self) -> None:
        if not self.label:
            simple = self.name.rsplit(".", 1)[-1]
            object.__setattr__(self, "label", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", simple))

    def type_of(self, path: str) -> T.DataType | None:
        """Type of a dotted path; None where there is no such field."""
        kind: T.DataType = self.df.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind = kind[part].dataType
        return kind

    def metadata(self, path: str) -> dict:
        kind: T.DataType = self.df.schema
        found: dict = {}
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return {}
            found, kind = kind[part].metadata or {}, kind[part].dataType
        return found


@dataclass
class Catalog:
    types: dict[str, EventType] = field(default_factory=dict)

    def add(self, event: EventType) -> EventType:
        self.types[event.name] = event
        return event

    def find(self, pattern: str) -> list[EventType]:
        """Types whose full name matches (``*``, ``?``), or else the first whose name ends with ``.pattern``; case counts."""
        glob = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern), re.DOTALL)
        found = [t for n, t in self.types.items() if glob.fullmatch(n)]
        if not any(c in pattern for c in "*?"):
            found = found or [t for n, t in self.types.items() if n.endswith("." + pattern)][:1]
        if not found:
            near = suggestion(pattern, [n.rsplit(".", 1)[-1] for n in self.types] + list(self.types))
            raise QueryError(f"no event type is named {pattern}" + (f"; {near} is near" if near else ""))
        return found


def suggestion(name: str, known: list[str]) -> str | None:
    """A known name that differs in letter case, in one letter more or less, in one other letter, or, from six letters on, in two."""

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= (1 if len(a) < 6 else 2)
        short, long = sorted((a, b), key=len)
        letters = iter(long)
        return len(long) - len(short) == 1 and all(c in letters for c in short)

    return next((k for k in known if k != name and near(name.lower(), k.lower())), None)
