import json

from pyspark.sql import functions as F

from eventloom.catalog import EventType
from eventloom.operators.query import Col, EventQuery, From, run
from eventloom.sources.recordings import nanoseconds, recording
from eventloom.streaming.events import each_batch, windowed


def test_printed_recording(spark, tmp_path):
    events = [{"type": "jdk.FileRead", "values": {"startTime": "2024-01-01T00:00:00.5Z", "duration": "PT1M0.25S", "path": "a", "bytesRead": 5}}, {"type": "jdk.CPULoad", "values": {"startTime": "2024-01-01T00:00:01Z", "jvmUser": 0.5}}]
    (tmp_path / "r.json").write_text(json.dumps({"recording": {"events": events}}))
    c = recording(spark, str(tmp_path / "r.json"))
    assert run(c, EventQuery([From("FileRead")], [Col("path"), Col("bytesRead", "sum", "s"), Col("duration", "max", "d")], group=["path"])).first()[:] == ("a", 5, 60_250_000_000)
    assert spark.range(1).select(nanoseconds(F.lit("-PT2S"))).first()[0] == -2_000_000_000


def test_recording_by_lines(spark, tmp_path):
    events = [{"type": "jdk.A" if i % 2 else "jdk.B", "values": {"startTime": "2024-01-01T00:00:00Z", "a" if i % 2 else "b": i}} for i in range(200)]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, events)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for into in (None, str(tmp_path / "types")):
            c = recording(spark, str(tmp_path / "r.json"), lines=True, into=into, type_ids={"jdk.A": 5})
            assert list(c.types) == ["jdk.A", "jdk.B"] and c.types["jdk.A"].id == 5 and "b" not in c.types["jdk.A"].df.columns
            assert c.types["jdk.A"].df.rdd.getNumPartitions() > 1
            got = run(c, EventQuery([From("A"), From("B")], [Col("a", "list", "x"), Col("a", "last", "y"), Col("b", "first", "z")], form=True)).first()
            assert got[:] == (", ".join(str(i) for i in range(1, 200, 2)), 199, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream(spark, tmp_path):
    spark.sql("select timestamp_seconds(id * 60) ts, id, id % 2 k, id * 1.0D v from range(20)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, id long, k long, v double").parquet(str(tmp_path / "in"))
    q = windowed(stream, time="ts", keys=["k"], value="v").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n), sum(total) from w").first()[:] == (20, 190.0)
    got = []
    q = each_batch(stream, lambda d: EventType("app.A", d, ("ts", "id"), "ts"), EventQuery([From("A")], [Col("k"), Col("v", "sum", "s")], group=["k"]), lambda d, _: got.extend(map(tuple, d.collect())), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(got) == [(0, 90.0), (1, 100.0)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
