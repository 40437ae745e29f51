"""Columns that recorded stacks, threads and classes give: picked frames and the keys that groups use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

JAVA_FRAMES = ("Interpreted", "JIT compiled", "Inlined")


def top_frame(trace: Column) -> Column:
    return F.get(trace["frames"], 0)


def top_application_frame(trace: Column) -> Column:
    """The first Java frame whose class has a loader other than the boot one."""

    def chosen(f: Column) -> Column:
        loader = f["method"]["type"]["classLoader"]
        return f["type"].isin(*JAVA_FRAMES) & loader.isNotNull() & (F.coalesce(loader["name"], F.lit("")) != "bootstrap")

    return F.get(F.filter(trace["frames"], chosen), 0)


def not_init(trace: Column) -> Column:
    """The first Java frame that is not a constructor."""
    return F.get(F.filter(trace["frames"], lambda f: f["type"].isin(*JAVA_FRAMES) & (f["method"]["name"] != "<init>")), 0)


SYNTHETIC = {"topFrame": top_frame, "topApplicationFrame": top_application_frame, "notInit": not_init}


def group_key(c: Column, kind: T.DataType) -> Column:
    """What equal objects have in common: ids and names, no line numbers."""
    names = set(kind.names) if isinstance(kind, T.StructType) else set()
    if {"javaName", "osName", "javaThreadId"} <= names:
        return F.struct(c["javaThreadId"].alias("java"), c["osThreadId"].alias("os") if "osThreadId" in names else c["osName"].alias("os"))
    if {"truncated", "frames"} <= names:
        frame = kind["frames"].dataType.elementType
        return F.transform(c["frames"], lambda f: group_key(f, frame))
    if {"method", "lineNumber"} <= names:
        return F.when(c["type"].isin(*JAVA_FRAMES), group_key(c["method"], kind["method"].dataType))
    if {"descriptor", "type", "name"} <= names:
        return F.concat_ws("\x00", c["type"]["name"], c["type"]["classLoader"]["name"], c["name"], c["descriptor"])
    if {"name", "classLoader"} <= names:
        return F.concat_ws("\x00", c["name"], c["classLoader"]["name"])
    if {"name", "typeName"} <= names:
        return F.concat_ws("\x00", c["name"], c["typeName"])
    if {"name", "parentName"} <= names:
        return F.concat_ws(":", c["name"], c["parentName"])
    return c
