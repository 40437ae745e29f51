"""Event queries: columns and aggregates of one or several event types, as one DataFrame.

Several types are a union that feeds one set of groups: each type contributes to
the columns whose field it has, under the group key they share. A type that
appears under several aliases with different filters is read once; its rows
carry which aliases they belong to.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, EventType, QueryError, suggestion
from ..functions import aggregates, display, recorded
from .quantiles import at_ranks


@dataclass(frozen=True)
class From:
    """An event type by name or glob; an alias needs a single type."""

    type: str
    alias: str | None = None


@dataclass(frozen=True)
class Col:
    """An output column: a field, plain or aggregated by ``fn``.

    A field may be ``path``, ``Alias.path``, ``Type.path``, ``[A|B].path`` or
    ``*`` (the start time). ``share`` adds the value's share of the total of all
    rows as a further column, which stands for the value in reports; ``missing`` is the text for null,
    ``height`` the lines of a cell.
    """

    field: str
    fn: str = "value"
    alias: str | None = None
    label: str | None = None
    share: bool = False
    missing: str | None = None
    height: int = 1

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        plain = self.field.replace("*", "all").translate(str.maketrans(".|", "__", "[]"))
        return plain if self.fn == "value" else f"{self.fn}_{plain}"


@dataclass(frozen=True)
class EventQuery:
    """``columns`` None: all fields of the (single) type. ``where``: pairs of field and text. ``order``: fields, aliases, each alone or with "asc" or "desc"."""

    sources: Sequence[From]
    columns: Sequence[Col] | None = None
    where: Sequence[tuple[str, str]] = ()
    group: Sequence[str] = ()
    order: Sequence[str | tuple[str, str]] = ()
    limit: int | None = None
    form: bool = False
    documented: bool = False


@dataclass(frozen=True)
class Source:
    index: int
    event: EventType
    alias: str | None


@dataclass(frozen=True)
class Field:
    """A path as one event type has it."""

    value: Column
    kind: T.DataType
    metadata: dict

    @property
    def text(self) -> Column:
        return display.display_text(self.value, self.kind, self.metadata)


def field_of(event: EventType, path: str, type_labels: dict[int, str] | None = None) -> Field | None:
    """The column of a path, with the fields that every type has and those that stacks give; a setting's id is the label of its type."""
    if path == "id" and event.name == "jdk.ActiveSetting" and type_labels and event.type_of(path) is not None:
        known = F.create_map(*[F.lit(x) for pair in sorted(type_labels.items()) for x in pair])
        return Field(F.try_element_at(known, F.col(path).cast("long")), T.StringType(), {"label": "Event Type"})
    if path in ("eventType.label", "eventType.name"):
        return Field(F.lit(event.label if path.endswith("label") else event.name), T.StringType(), {})
    for name, column in (("startTime", event.start), ("endTime", event.end or event.start)):
        if path == name and column and event.type_of(name) is None:
            return Field(F.col(column), T.TimestampType(), {"label": "Time"})
    head, _, last = path.rpartition(".")
    if last in recorded.SYNTHETIC and head and event.type_of(head) is not None:
        column = recorded.SYNTHETIC[last](F.col(head))
        frame = event.type_of(head)["frames"].dataType.elementType  # type: ignore[index]
        return Field(column, frame, {"label": last})
    kind = event.type_of(path)
    return None if kind is None else Field(F.col(path), kind, event.metadata(path))


class Resolver:
    def __init__(self, catalog: Catalog, query: EventQuery) -> None:
        self.query = query
        self.sources: list[Source] = []
        for f in query.sources:
            types = catalog.find(f.type)
            if f.alias and len(types) > 1:
                raise QueryError(f"{f.type} names {len(types)} event types; an alias needs one")
            self.sources += [Source(len(self.sources) + i, t, f.alias) for i, t in enumerate(types)]
        self.aliases = {c.alias: c for c in query.columns or () if c.alias}
        self.type_labels = {t.id: t.label for t in catalog.types.values() if t.id is not None}

    def sources_of(self, name: str) -> tuple[list[Source], str]:
        """The sources that a field name may mean, and the path within them."""
        if name == "*":
            return self.sources, "startTime"
        if name.startswith("["):
            choices, _, path = name[1:].partition("].")
            return [s for a in choices.split("|") for s in self.sources_of(f"{a}.{path}")[0]], path
        for s in self.sources:
            full = s.event.name
            for prefix in (s.alias, full, full.rsplit(".", 1)[-1]):
                if prefix and name.startswith(prefix + "."):
                    path = name[len(prefix) + 1 :]
                    same = [x for x in self.sources if (x.alias == prefix if prefix == s.alias else x.event.name == full)]
                    return same, path
        return self.sources, name

    def fields(self, name: str, required: bool = True) -> dict[int, Field]:
        sources, path = self.sources_of(name)
        found = {s.index: f for s in sources if (f := field_of(s.event, path, self.type_labels))}
        if not found and path == "startTime":  # rows of types without a time still count
            found = {s.index: Field(F.lit(None).cast("timestamp"), T.TimestampType(), {}) for s in sources}
        if not found and required:
            near = suggestion(path, [n for s in sources for n in s.event.df.columns])
            raise QueryError(f"no event type of the query has a field {name}" + (f"; {near} is near" if near else ""))
        return found

    def predicates(self) -> dict[int, Column]:
        """For each source the filter on display texts."""
        out: dict[int, Column] = {}
        for name, text in self.query.where:
            through = self.aliases.get(name)
            found = self.fields(through.field if through else name, required=self.query.documented)
            if through:  # an alias stands for the first type that has its field
                found = dict(list(found.items())[:1])
            for i, f in found.items():
                meta = f.metadata | ({"missing": through.missing} if through and through.missing is not None else {})
                test = equals_text(f, text, meta)
                out[i] = out[i] & test if i in out else test
        return out


def equals_text(f: Field, text: str, metadata: dict | None = None) -> Column:
    """Whether the display text is ``text``; on plain strings a comparison that readers can push down."""
    meta = f.metadata if metadata is None else metadata
    if isinstance(f.kind, T.StringType) and text != meta.get("missing", display.MISSING):
        if any(c in text for c in "\n\r\t"):
            return F.lit(False)
        if " " not in text:
            return f.value == F.lit(text)
    return display.display_text(f.value, f.kind, meta) == F.lit(text)


def _order(event: EventType, alone: bool, index: int) -> Column:
    """Orders events: by time, then by the type's own order; comparable between types."""
    if alone:
        return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(event.order)])
    ties = [F.lpad(F.col(c).cast("string"), 20, "0") if isinstance(event.type_of(c), T.IntegralType) else F.col(c).cast("string") for c in event.order]
    time = F.unix_micros(F.col(event.end or event.start).cast("timestamp")) if event.start else F.lit(None).cast("long")
    return F.struct(time.alias("t"), F.lit(index).alias("k"), F.array(*ties).alias("o"))


def _common(found: dict[int, Field]) -> tuple[T.DataType, bool]:
    """The type of a column fed by several sources, and whether it has to be text."""
    kinds = {f.kind.simpleString() for f in found.values()}
    return (next(iter(found.values())).kind, False) if len(kinds) == 1 else (T.StringType(), True)


def _value(f: Field, as_text: bool) -> Column:
    return f.text if as_text else f.value


def run(catalog: Catalog, query: EventQuery) -> DataFrame:
    """The query's rows: its columns, their shares, no hidden ones; each column's metadata says how to show it."""
    if query.columns is None:
        return _everything(catalog, query)
    r = Resolver(catalog, query)
    grouped = bool(query.group) or any(c.fn != "value" for c in query.columns)
    hidden = []
    for o in query.order:
        name = o if isinstance(o, str) else o[0]
        if name not in {c.name for c in query.columns} | {c.field for c in query.columns}:
            hidden.append(Col(name, alias=f"hidden_{len(hidden)}"))
    columns = [*query.columns, *hidden]
    out = _grouped(r, columns) if grouped else _plain(r, columns)
    return _finished(r, out, columns, hidden, grouped)


def _everything(catalog: Catalog, query: EventQuery) -> DataFrame:
    r = Resolver(catalog, query)
    if len({s.event.name for s in r.sources}) > 1 and not query.documented:
        raise QueryError("all fields of several event types at once are not one table; name the columns")
    frames = []
    tests = r.predicates()
    for s in r.sources:
        d = s.event.df if s.index not in tests else s.event.df.where(tests[s.index])
        flat = []
        for f in s.event.df.schema:
            known = not isinstance(f.dataType, T.StructType) or display.recorded(F.lit(None).cast(f.dataType), f.dataType) is not None
            flat += [(f.name, F.col(f.name))] if known else [(f"{f.name}.{g.name}", F.col(f"{f.name}.{g.name}")) for g in f.dataType]  # type: ignore[union-attr]
        frames.append(d.select(*[c.alias(n) for n, c in flat]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    first = out.columns[0]
    order = [(o, None) if isinstance(o, str) else o for o in query.order] or [(first, None)]
    out = out.orderBy(*[_directed(F.col(f"`{n}`"), d or "asc") for n, d in order]) if not query.form else out
    return out.limit(1 if query.form else query.limit) if query.form or query.limit is not None else out


def _by_type(r: Resolver) -> list[tuple[EventType, list[Source], DataFrame, dict[int, Column]]]:
    """Each event type once, with a condition per source, and filtered to what any source wants."""
    tests, out = r.predicates(), []
    for name in dict.fromkeys(s.event.name for s in r.sources):
        own = [s for s in r.sources if s.event.name == name]
        d = own[0].event.df
        if all(s.index in tests for s in own):
            d = d.where(reduce(lambda a, b: a | b, [tests[s.index] for s in own]))
        wanted = {s.index: F.coalesce(tests[s.index], F.lit(False)) if s.index in tests and len(own) > 1 else F.lit(True) for s in own}
        out.append((own[0].event, own, d, wanted))
    return out


def _plain(r: Resolver, columns: list[Col]) -> DataFrame:
    frames = []
    found = [r.fields(c.field) for c in columns]
    for _, own, d, wanted in _by_type(r):
        for s in own:
            values = []
            for c, fields in zip(columns, found, strict=True):
                kind, text = _common(fields)
                values.append(_value(fields[s.index], text).alias(c.name) if s.index in fields else F.lit(None).cast(kind).alias(c.name))
            frames.append((d if len(own) == 1 else d.where(wanted[s.index])).select(*values, _order(s.event, len(r.sources) == 1, s.index).alias("__ord")))
    return reduce(DataFrame.unionByName, frames)


def _set_key(keys: list[tuple[str, T.DataType]]) -> list[Column]:
    """A composite key as the set of its values without leading nulls: (1, 2) is (2, 1), and (null, x) is x alone."""
    if len(keys) < 2 or len({k.simpleString() for _, k in keys}) > 1:
        return [F.col(n) for n, _ in keys]
    names = [F.col(n) for n, _ in keys]
    later = F.lit(None)
    for i in range(len(names) - 1, -1, -1):
        rest = F.array(*names[i:])
        own = F.struct((F.lit(i == len(names) - 1)).alias("scalar"), F.array_sort(F.array_distinct(rest)).alias("values"))
        later = own if i == len(names) - 1 else F.when(names[i].isNotNull(), own).otherwise(later)
    return [later]


def _grouped(r: Resolver, columns: list[Col]) -> DataFrame:
    documented = r.query.documented
    found = [r.fields(c.field) for c in columns]
    common = [_common(f) for f in found]
    keys: list[tuple[str, T.DataType]] = []
    key_fields = []
    for name in r.query.group:
        through = r.aliases.get(name)
        if through and through.fn != "value":
            raise QueryError(f"{name} is an aggregate and can't be a group key")
        fields = r.fields(through.field if through else name)
        if lacking := [s.event.name for s in r.sources if s.index not in fields]:
            raise QueryError(f"{name} is a group key that {lacking[0]} does not have")
        key_fields.append(fields)
    frames, alone = [], len({s.event.name for s in r.sources}) == 1
    for position, (event, own, d, wanted) in enumerate(_by_type(r)):
        parts = [_order(event, alone, position).alias("ord")]
        parts.append((F.col(event.end or event.start).cast("timestamp") if event.start else F.lit(None).cast("timestamp")).alias("end"))
        for i, (fields, (kind, text)) in enumerate(zip(found, common, strict=True)):
            mine = [s for s in own if s.index in fields]
            f = fields[mine[0].index] if mine else None
            has = reduce(lambda a, b: a | b, [wanted[s.index] for s in mine]) if mine else F.lit(False)
            parts += [(_value(f, text) if f else F.lit(None).cast(kind)).alias(f"v{i}"), has.alias(f"has{i}")]
        for j, fields in enumerate(key_fields):
            kind, text = _common(fields)
            f = fields[own[0].index]
            parts.append((f.text if text else recorded.group_key(f.value, f.kind)).alias(f"k{j}"))
        frames.append(d.select(*parts))
    rows = reduce(DataFrame.unionByName, frames)
    keys = [(f"k{j}", rows.schema[f"k{j}"].dataType) for j in range(len(key_fields))]
    by = [F.col(n) for n, _ in keys] if documented else _set_key(keys)
    by = [b.alias(f"g{j}") for j, b in enumerate(by)] or [F.lit(1).alias("g0")]
    rows = rows.select("*", *by)
    group = [f"g{j}" for j in range(len(by))]

    values = []
    for i, (c, fields) in enumerate(zip(columns, found, strict=True)):
        meta = next(iter(fields.values())).metadata
        kind = common[i][0]
        key = recorded.group_key(F.col(f"v{i}"), kind) if c.fn == "unique" and isinstance(kind, T.StructType) else None
        values.append(aggregates.Value(F.col(f"v{i}"), kind, F.col(f"has{i}"), F.col("ord"), meta.get("kind") == "timespan", key))
    ranked = {i for i, (c, x) in enumerate(zip(columns, values, strict=True)) if x.numeric and (c.fn == "median" or c.fn in aggregates.QUANTILES)}
    batches = [i for i, c in enumerate(columns) if c.fn == "last_batch"]
    totals = [aggregates.aggregate(c.fn, x, documented).alias(c.name) for i, (c, x) in enumerate(zip(columns, values, strict=True)) if i not in ranked]
    totals += [F.max(F.when(F.col(f"has{i}"), F.col("end"))).alias(f"__end{i}") for i in batches]
    out = rows.groupBy(*group).agg(*totals) if totals else rows.select(*group).distinct()
    if ranked:
        out = _with_quantiles(rows, out, group, columns, values, ranked, documented)
    if batches:  # one row of maxima
        last = F.broadcast(out.agg(*[F.max(f"__end{i}").alias(f"__last{i}") for i in batches]))
        same = [F.col(f"__end{i}").isNull() | (F.col(f"__end{i}") == F.col(f"__last{i}")) for i in batches]
        out = out.join(last, reduce(lambda a, b: a & b, same))
    return out


def _with_quantiles(rows: DataFrame, out: DataFrame, group: list[str], columns: list[Col], values: list[aggregates.Value], ranked: set[int], documented: bool) -> DataFrame:
    """``out`` with its medians and quantiles; those of one field are found together."""
    passes: dict[tuple[str, bool], list[int]] = {}
    for i in sorted(ranked):
        finite = documented or columns[i].fn != "median" or not values[i].fractional
        passes.setdefault((columns[i].field, finite), []).append(i)
    for (_, finite), members in passes.items():
        x = values[members[0]]
        kept = rows.where(x.finite if finite else x.has & x.v.isNotNull()).withColumn("v", x.v)
        found = at_ranks(kept, group, "v", {f"q{i}": aggregates.ranks(columns[i].fn, documented) for i in members})
        shown = [aggregates.between(columns[i].fn, F.col(f"q{i}_low"), F.col(f"q{i}_high"), F.col("size"), values[i].timespan, documented).alias(columns[i].name) for i in members]
        found = found.select(*[F.col(g).alias(f"found_{g}") for g in group], *shown)
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"found_{g}")) for g in group])
        out = out.join(found, same, "left").drop(*[f"found_{g}" for g in group])
    return out


def _directed(c: Column, direction: str) -> Column:
    """Nulls come last either way."""
    return c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()


def _finished(r: Resolver, out: DataFrame, columns: list[Col], hidden: list[Col], grouped: bool) -> DataFrame:
    q = r.query
    meta = {}
    for c in columns:
        fields = r.fields(c.field)
        m = dict(next(iter(fields.values())).metadata) if c.fn not in ("count", "unique", "list") else {}
        m["label"] = c.label or aggregates.LABELS[c.fn] + (m.get("label") or ("" if c.fn == "count" else _title(c.field, any("duration" in s.event.df.columns for s in r.sources))))
        if c.missing is not None:
            m["missing"] = c.missing
        if c.height > 1:
            m["height"] = c.height
        if c.share:
            m["only_share"] = True
        meta[c.name] = m
    shares = [c for c in columns if c.share]
    if shares:  # totals over all rows, before any limit: one row
        total = F.broadcast(out.agg(*[F.sum(c.name).cast("double").alias(f"__sum_{c.name}") for c in shares]))
        out = out.join(total, F.lit(True), "left")
        for c in shares:
            out = out.withColumn(f"{c.name}_share", F.try_divide(F.col(c.name).cast("double"), F.col(f"__sum_{c.name}")))
            meta[f"{c.name}_share"] = {"label": meta[c.name]["label"], "kind": "percentage"}
    if not q.form:
        out = out.orderBy(*_sorting(r, out, columns, meta, grouped))
        if q.limit is not None:
            out = out.limit(q.limit)
    elif not grouped:
        out = out.orderBy("__ord").limit(1)
    shown = []
    for c in q.columns or ():
        shown.append(F.col(c.name).alias(c.name, metadata=meta[c.name]))
        if c.share:
            shown.append(F.col(f"{c.name}_share").alias(f"{c.name}_share", metadata=meta[f"{c.name}_share"]))
    return out.select(*shown)


#: Words of a label that are written in capitals.
ACRONYMS = {"Cpu", "Gc", "Id", "Io", "Jvm", "Os", "Pid"}


def _title(field: str, timed: bool = True) -> str:
    """A label made of a field's name: ``gcId`` is GC ID. The start of what has no duration (not ``timed``) is just its time."""
    name = field.rsplit(".", 1)[-1]
    if name == "startTime" and not timed:
        return "Time"
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name[:1].upper() + name[1:]).split(" ")
    return " ".join(w.upper() if w in ACRONYMS else w for w in words)


def _sorting(r: Resolver, out: DataFrame, columns: list[Col], meta: dict, grouped: bool) -> list[Column]:
    """The stated order, or: by the right-most aggregate first, else by the group columns, else by the first column."""
    q = r.query
    by_name = {c.name: c for c in columns}
    stated: list[tuple[Col, str | None]] = []
    for o in q.order:
        name, direction = (o, None) if isinstance(o, str) else o
        c = by_name.get(name) or next((c for c in columns if c.field == name), None) or next(c for c in columns if c.field == name and c.alias and c.alias.startswith("hidden_"))
        stated.append((c, direction))
    if not stated:
        shown = list(q.columns or ())
        totals = [c for c in shown if c.fn != "value"]
        grouping = [c for c in shown if c.field in q.group or c.alias in q.group]
        stated = [(c, None) for c in (reversed(totals) if totals else reversed(grouping) if grouping else shown[:1])]
    keys = []
    for c, direction in stated:
        m = meta[c.name]
        down = c.share or m.get("kind") == "percentage" or m.get("kind") == "timespan" and c.fn not in ("count", "unique")
        kind = out.schema[c.name].dataType
        lexical = isinstance(kind, (T.StringType, T.StructType))
        column = display.display_text(F.col(c.name), kind, m) if lexical else F.col(c.name)
        keys.append(_directed(column, direction or ("desc" if down else "asc")))
    ties = [F.col(f"g{j}") for j in range(len(q.group)) if f"g{j}" in out.columns] if grouped else [F.col("__ord")]
    return keys + [_directed(t, "asc") for t in ties]
