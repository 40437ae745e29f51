"""Aggregates, keys, filters and co-groups on small inline tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.catalog import Catalog, EventType, QueryError
from eventloom.functions import display
from eventloom.functions.display import FOREVER, timespan
from eventloom.operators.query import Col, EventQuery, From, run
from eventloom.plans.views import CATALOG, all_events, all_views, report, view
from eventloom.render import form, table

T0 = datetime(2024, 1, 1, 12)


def catalog(spark, **types):
    c = Catalog()
    for name, (rows, schema) in types.items():
        timed = [(i, T0 + timedelta(seconds=i), *r) for i, r in enumerate(rows)]
        c.add(EventType(f"app.{name}", spark.createDataFrame(timed, f"seq long, startTime timestamp, {schema}"), ("startTime", "seq"), "startTime"))
    return c


def values(c, fn, documented=False, field="v", form=True):
    return [r[0] for r in run(c, EventQuery([From("A")], [Col(field, fn, "x")], form=form, documented=documented)).collect()]


def test_nulls(spark):
    c = catalog(spark, A=([(None,), (1.0,), (None,), (3.0,), (None,)], "v double"))
    assert values(c, "first") == [None] and values(c, "last") == [None]
    assert values(c, "count") == [5] and values(c, "unique") == [3]
    assert values(c, "list") == ["null, 1.0, null, 3.0, null"]
    plain = lambda d: [r.v for r in run(c, EventQuery([From("A")], [Col("v"), Col("*", "count", "n")], documented=d)).collect()]
    assert plain(False) == [3.0] and plain(True) == [1.0]


def test_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    c = catalog(spark, A=([(nan,), (inf,), (1.0,), (2.0,)], "v double"))
    assert values(c, "sum") == [3.0] and values(c, "avg") == [1.5] and values(c, "stdev") == [0.5]
    assert str(values(c, "max")[0]) == "nan" and values(c, "diff") == [1.0]


def test_quantiles(spark):
    c = catalog(spark, A=([(float(i),) for i in range(1, 11)], "v double"))
    assert values(c, "p90")[0] == pytest.approx(10.9) and values(c, "p90", True)[0] == pytest.approx(9.9)
    assert values(c, "p999") == [10.0] and values(c, "median") == [5.5]
    assert values(catalog(spark, A=([(7.0,)], "v double")), "p95") == [7.0]


def test_no_rows_no_group(spark):
    c = catalog(spark, A=([], "v double"))
    assert values(c, "count") == []


def test_durations(spark):
    c = catalog(spark, A=([(1_000_000_000,), (2_000_000_000,)], "v long"))
    event = c.types["app.A"]
    c.types["app.A"] = EventType("app.A", event.df.withColumn("v", F.col("v").alias("v", metadata={"kind": "timespan"})), event.order, event.start)
    assert values(c, "avg") == [1_000_000_000] and values(c, "avg", True) == [1_500_000_000]
    assert values(c, "sum") == [3_000_000_000] and values(c, "diff") == [None] and values(c, "diff", True) == [1_000_000_000]


def test_time_difference(spark):
    assert values(catalog(spark, A=([(1,)], "v int")), "diff", field="startTime") == [FOREVER]
    assert values(catalog(spark, A=([(1,), (2,)], "v int")), "diff", field="startTime") == [1_000_000_000]


def test_composite_keys_are_sets(spark):
    c = catalog(spark, A=([(1, 2), (2, 1), (1, 1), (None, 1), (1, None), (None, None)], "a int, b int"))
    q = lambda d: run(c, EventQuery([From("A")], [Col("*", "count", "n")], group=["a", "b"], documented=d)).count()
    assert q(False) == 5 and q(True) == 6


def test_last_batch(spark):
    rows = [(T0, 0, "a", 1), (T0, 1, "b", 2), (T0 + timedelta(10), 2, "a", 3), (T0 + timedelta(10), 3, "c", 4)]
    c = Catalog()
    c.add(EventType("app.A", spark.createDataFrame(rows, "startTime timestamp, seq int, k string, v int"), ("startTime", "seq"), "startTime"))
    out = run(c, EventQuery([From("A")], [Col("k"), Col("v", "last_batch", "x")], group=["k"]))
    assert {(r.k, r.x) for r in out.collect()} == {("a", 3), ("c", 4)}


def test_co_group_is_a_full_join(spark):
    c = catalog(spark, A=([(1, 10), (2, 20)], "k int, x int"), B=([(2, 5), (3, 6)], "k int, y int"))
    out = run(c, EventQuery([From("A"), From("B")], [Col("k"), Col("x", "sum", "sx"), Col("y", "sum", "sy")], group=["k"]))
    assert {(r.k, r.sx, r.sy) for r in out.collect()} == {(1, 10, None), (2, 20, 5), (3, None, 6)}


def test_result_does_not_depend_on_partitions(spark):
    c = catalog(spark, A=([(i % 3, float(i)) for i in range(60)], "k int, v double"))
    q = EventQuery([From("A")], [Col("k"), Col("v", "first", "a"), Col("v", "last", "b"), Col("v", "list", "c")], group=["k"])
    event = c.types["app.A"]
    results = []
    for n in (1, 5):
        c.types["app.A"] = EventType("app.A", event.df.repartition(n), event.order, event.start)
        results.append(sorted(map(tuple, run(c, q).collect())))
    assert results[0] == results[1]


def test_filters_compare_texts(spark):
    c = catalog(spark, A=([(None, 1234.0), ("x\ty", 2.0), ("z", 3.0)], "s string, v double"))
    n = lambda *w, **k: run(c, EventQuery([From("A")], [Col("v")], where=w, **k)).count()
    assert n(("s", "N/A")) == 1 and n(("s", "x y")) == 1 and n(("v", "1,234")) == 1 and n(("nowhere", "x")) == 3
    with pytest.raises(QueryError):
        n(("nowhere", "x"), documented=True)


def test_pushed_filter(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) s", "timestamp_seconds(id) startTime").write.parquet(str(tmp_path / "t"))
    c = Catalog()
    c.add(EventType("app.A", spark.read.parquet(str(tmp_path / "t")), ("startTime", "id"), "startTime"))
    out = run(c, EventQuery([From("A")], [Col("id")], where=[("s", "3")]))
    assert "EqualTo(s,3)" in out._jdf.queryExecution().executedPlan().toString() and [r.id for r in out.collect()] == [3]


def test_unknown_names(spark):
    c = catalog(spark, A=([(1,)], "value int"))
    with pytest.raises(QueryError, match="value"):
        run(c, EventQuery([From("A")], [Col("valu")]))
    with pytest.raises(QueryError, match="no event type"):
        run(c, EventQuery([From("Nothing")], [Col("value")]))


def test_order_puts_nulls_last(spark):
    c = catalog(spark, A=([(2,), (None,), (1,)], "v int"))
    for d, expected in (("asc", [1, 2, None]), ("desc", [2, 1, None])):
        assert [r.v for r in run(c, EventQuery([From("A")], [Col("v")], order=[("v", d)])).collect()] == expected


@pytest.mark.parametrize(("ns", "text"), [(0, "0 s"), (999, "0.000999 ms"), (1000, "0.00100 ms"), (1234, "0.00123 ms"), (999_999_999, "1.00 s"), (1_500_000_000, "1.50 s"), (59_950_000_000, "1 m 0 s"), (61_000_000_000, "1 m 1 s"), (3_660_000_000_000, "1 h 1 m"), (90_000_000_000_000, "1 d 1 h"), (-1_500_000_000, "-1.50 s"), (FOREVER, "Indefinite")])
def test_timespans(spark, ns, text):
    assert spark.range(1).select(timespan(F.lit(ns))).first()[0] == text


def test_long_timespans(spark):
    ns = [90_000 * 10**9 - 1, FOREVER - 1, 1_200_000 * 50_000_000_000_000]
    rows = spark.createDataFrame([(str(x),) for x in ns], "n string").select(timespan(F.col("n").cast("decimal(38,0)"), wide=True)).collect()
    assert [r[0] for r in rows] == ["1 d 1 h", "106752 d 0 h", "694444 d 11 h"]
    assert spark.range(1).select(timespan(F.lit(FOREVER - 1))).first()[0] == "106752 d 0 h"
    assert spark.range(1).select(timespan(F.lit(None).cast("long"))).first()[0] is None


@pytest.mark.parametrize(("n", "text"), [(1, "1 byte"), (-1, "-1 byte"), (0, "0 bytes"), (1023, "1023 bytes"), (1024, "1.0 kB"), (1536 * 1024, "1.5 MB")])
def test_bytes(spark, n, text):
    assert spark.range(1).select(display.amount(F.lit(n), "bytes")).first()[0] == text


def test_recorded_names(spark):
    one = spark.range(1)
    assert one.select(display.class_name(F.lit("[I")), display.class_name(F.lit("[[Ljava.lang.String;")), display.class_name(F.lit("a.B"))).first()[:] == ("int[]", "java.lang.String[][]", "a.B")
    m = F.from_json(F.lit('{"type":{"name":"a.B"},"name":"go","descriptor":"(I[Ljava/lang/String;)V"}'), "type struct<name string>, name string, descriptor string")
    assert one.select(display.method(m)).first()[0] == "a.B.go(int, String[])"


def test_rendering(spark):
    c = catalog(spark, A=([("a" * 50, 1), ("b", None)], "s string, v int"))
    d = run(c, EventQuery([From("A")], [Col("s"), Col("v")]))
    text = table(d, width=30, title="A")
    assert "..." in text and "N/A" in text and all(len(x) <= 30 for x in text.splitlines())
    assert form(d.limit(1)).splitlines()[1] == "V: 1"
    assert table(d.where("false"), title="A") == "No events found for 'A'."


FRAME = "struct<method struct<type struct<name string, classLoader struct<name string, typeName string>>, name string, descriptor string>, lineNumber int, type string>"


def test_views(spark):
    frame = lambda name, loader: ((("x.C", (loader, "l") if loader else None), name, "()V"), 1, "Interpreted")
    c = Catalog()
    trace = f"stackTrace struct<truncated boolean, frames array<{FRAME}>>"
    rows = [(0, T0, (False, [frame("sys", "bootstrap"), frame("app", "app")])), (1, T0 + timedelta(1), (False, [frame("sys", "bootstrap"), frame("app", "app")])), (2, T0 + timedelta(2), None)]
    c.add(EventType("jdk.ExecutionSample", spark.createDataFrame(rows, f"seq int, startTime timestamp, {trace}"), ("startTime", "seq"), "startTime"))
    gc = spark.createDataFrame([(0, T0, 1, "Before GC", 10), (1, T0, 1, "After GC", 4), (2, T0, 2, "Before GC", 12)], "seq int, startTime timestamp, gcId int, when string, heapUsed long")
    c.add(EventType("jdk.GCHeapSummary", gc, ("startTime", "seq"), "startTime"))
    for n, k in (("GarbageCollection", 1), ("OldGarbageCollection", 2), ("YoungGarbageCollection", 1)):
        c.add(EventType(f"jdk.{n}", spark.createDataFrame([(0, T0, k, 5)], "seq int, startTime timestamp, gcId int, longestPause long"), ("startTime", "seq"), "startTime"))
    hot = view(c, "hot-methods").collect()
    assert sorted((r.count_all, round(r.N_share, 3)) for r in hot) == [(1, 0.333), (2, 0.667)]
    rows = {r.gcId: r for r in view(c, "GC").collect()}
    assert (rows[1].B_heapUsed, rows[1].A_heapUsed, rows[2].B_heapUsed, rows[2].A_heapUsed) == (10, 4, 12, None)
    assert [r for r in rows[2]][2] == "Old Garbage Collection"
    assert len(CATALOG) == 74
    done = all_views(c)
    assert not isinstance(done["events-by-count"], QueryError) and isinstance(done["modules"], QueryError)


def test_settings_pivot(spark):
    rows = [(i, T0, 7, n, v) for i, (n, v) in enumerate([("enabled", "true"), ("threshold", "20 ms"), ("cutoff", "0")])]
    c = Catalog()
    c.add(EventType("jdk.ActiveSetting", spark.createDataFrame(rows, "seq int, startTime timestamp, id long, name string, value string"), ("startTime", "seq"), "startTime"))
    r = view(c, "active-settings").first()
    assert (r.last_batch_E_value, r.last_batch_T_value, r.last_batch_S_value, r.last_batch_C_value) == ("true", "20 ms", None, "0")


def test_labels_and_suggestions():
    from eventloom.catalog import suggestion
    from eventloom.operators.query import _title

    assert [_title(x) for x in ("gcId", "compilerId", "a.heapUsed", "startTime")] == ["GC ID", "Compiler ID", "Heap Used", "Start Time"] and _title("startTime", False) == "Time"
    assert suggestion("abcd", ["abxy"]) is None and suggestion("abcd", ["abcx"]) == "abcx" and suggestion("abcdefg", ["abcdexy"]) == "abcdexy"
    assert suggestion("filread", ["FileRead"]) == "FileRead" and suggestion("fileread", ["FileRead"]) == "FileRead" and suggestion("gc", ["heap"]) is None


def test_sums_of_whole_numbers_start_over(spark):
    c = Catalog()
    rows = [(1, 0, 2**63 - 1), (2, 0, 2), (3, 1, -(2**63)), (4, 1, -1), (5, 2, None), (6, 3, 7)]
    c.add(EventType("app.A", spark.createDataFrame(rows, "id long, k long, v long"), ("id",)))
    got = run(c, EventQuery([From("A")], [Col("k"), Col("v", "sum", "s")], group=["k"])).collect()
    assert {r.k: r.s for r in got} == {0: -(2**63) + 1, 1: 2**63 - 1, 2: None, 3: 7}


def test_views_have_titles_headers_and_formats(spark):
    assert all(v.title for v in CATALOG.values())
    c = Catalog()
    c.add(EventType("jdk.FileRead", spark.createDataFrame([(0, T0, "/a/" + "x" * 400, 5), (1, T0, None, 7)], "seq int, startTime timestamp, path string, bytesRead long"), ("startTime", "seq"), "startTime"))
    lines = report(c, "file-reads-by-path", width=60).splitlines()
    assert lines[0].strip() == "File Reads by Path" and lines[2].split() == ["Path", "Reads", "Total", "Read"]
    assert lines[4].startswith("N/A") and sum("x" in x for x in lines[4:]) == 5 and "..." in lines[-1]
    assert view(c, "types").first()[:] == ("jdk.FileRead", 2) and list(all_events(c)) == ["jdk.FileRead"]
    loaders = spark.createDataFrame([(0, T0, None, 1, 2)], "seq int, startTime timestamp, classLoader string, hiddenClassCount long, classCount long")
    c.add(EventType("jdk.ClassLoaderStatistics", loaders, ("startTime", "seq"), "startTime"))
    assert report(c, "class-loaders").splitlines()[-1].split() == ["null-bootstrap", "1", "2"]
    weights = spark.createDataFrame([(0, T0, "a", 3), (1, T0, "b", 1)], "seq int, startTime timestamp, objectClass string, weight long")
    c.add(EventType("jdk.ObjectAllocationSample", weights, ("startTime", "seq"), "startTime"))
    assert [x.split() for x in report(c, "allocation-by-class").splitlines()[2:]] == [["Object", "Type", "Allocation", "Pressure"], ["-" * 11, "-" * 19], ["a", "75.00%"], ["b", "25.00%"]]


def test_stacks_and_compact_texts(spark):
    trace = f"stackTrace struct<truncated boolean, frames array<{FRAME}>>"
    frame = lambda name, kind: ((("a.long.package.C", ("app", "l")), name, "(ILjava/lang/String;)V"), 1, kind)
    rows = [(0, T0, (False, [frame("one", "Interpreted"), frame("two", "Native"), frame("three", "Inlined")]))]
    c = Catalog()
    c.add(EventType("app.A", spark.createDataFrame(rows, f"seq int, startTime timestamp, {trace}"), ("startTime", "seq"), "startTime"))
    tall = run(c, EventQuery([From("A")], [Col("stackTrace", height=3)]))
    assert table(tall).splitlines()[2:] == ["a.long.package.C.one(int, String)", "a.long.package.C.three(int, String)"]
    assert table(tall, width=28).splitlines()[2] == "a.long.package.C.one(...)"
    assert table(run(c, EventQuery([From("A")], [Col("stackTrace")])), width=26).splitlines()[2] == "a.long.package.C.one(...)"


def test_settings_name_their_type(spark):
    rows = [(0, T0, 7, "enabled", "true"), (1, T0, 8, "enabled", "false"), (2, T0, 9, "enabled", "true")]
    c = Catalog()
    c.add(EventType("jdk.ActiveSetting", spark.createDataFrame(rows, "seq int, startTime timestamp, id long, name string, value string"), ("startTime", "seq"), "startTime", id=8))
    c.add(EventType("jdk.FileRead", spark.range(0), ("id",), id=7))
    assert [r[0] for r in view(c, "active-settings").collect()] == ["Active Setting", "File Read", None]


def test_quantiles_of_extreme_values(spark):
    """Held against sorting: every sign and size, ties, null keys, few and many values."""
    import random

    rnd = random.Random(3)
    nan, inf = float("nan"), float("inf")
    odd = [nan, inf, -inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1e15 + 1, 1e15 + 2, None]
    rows = [(k, x) for k in ("a", None, "b") for x in odd] + [("c", rnd.choice([-1, 1]) * 10 ** rnd.uniform(-3, 3)) for _ in range(500)] + [("d", float(i % 3)) for i in range(200)] + [("e", None)]
    c = catalog(spark, A=(rows, "k string, v double"))
    names = ("median", "p90", "p95", "p99", "p999")
    for documented in (True, False):
        q = EventQuery([From("A")], [Col("k"), *[Col("v", n, n) for n in names]], group=["k"], documented=documented)
        got = {r.k: r for r in run(c, q).collect()}
        assert set(got) == {"a", "b", "c", "d", "e", None}
        for k in got:
            own = [v for g, v in rows if g == k and v is not None]
            finite = sorted(v for v in own if abs(v) < inf)
            middle = finite if documented else sorted(own, key=lambda v: (v != v, v))
            n = len(middle)
            low, high = (middle[(n - 1) // 2], middle[n // 2]) if n else (None, None)
            assert got[k].median == (None if not n else low if low == high else pytest.approx(0.5 * low + 0.5 * high))
            for name, p in (("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999 if documented else 0.9999)):
                n, d = len(finite), (len(finite) + 1) * p
                i = int(d)
                want = None if not n else finite[0] if i < 1 else finite[-1] if i >= n else finite[i - 1] + (d - i + (not documented)) * (finite[i] - finite[i - 1])
                assert got[k][name] == (want if want is None or abs(want) == inf else pytest.approx(want)), (k, name)
