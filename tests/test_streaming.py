"""Streams give what the same batch gives."""

from siltstone.streaming import leases

DATA = "/root/testdata/sf0.001/events.parquet"


def drained(spark, stream, name, path, mode="append"):
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return spark.table(name)


def test_activity_and_sessions(spark, tmp_path):
    raw = spark.read.parquet(DATA)
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = raw.schema.simpleString()[7:-1].replace(":", " ")
    events = leases.event_stream(spark, str(tmp_path / "in"), schema)
    assert events.isStreaming
    got = drained(spark, leases.activity(events, "400 days"), "activity", str(tmp_path / "c1"), "complete").collect()
    batch = leases.activity(raw.withColumn("ts", raw.ts.cast("timestamp"))).collect()
    assert {(r.start, r.event_type, r.n) for r in got} == {(r.start, r.event_type, r.n) for r in batch}
    seats = leases.sessions(raw.withColumn("ts", raw.ts.cast("timestamp")))
    assert seats.agg({"beats": "sum"}).first()[0] == raw.count()
