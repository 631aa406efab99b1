"""Files in and out, and the stream."""

import json

from pyspark.sql import functions as F

from coordwave.sources import formats
from coordwave.streaming import ingest


def test_event_files(spark, tmp_path):
    meta = {"name": "a", "channels": [{"id": "x", "quantity": "numeric"}, {"id": "freq", "quantity": "frequency"}]}
    (tmp_path / "a.csv").write_text(f"﻿# recording: {json.dumps(meta)}\n# note\nt,x,freq\n0,1,2.5\n1,,null\n")
    (tmp_path / "b.csv").write_text("time,Pulse_Width,PRI\n0,1,2\n5,3,4e0\n")
    (tmp_path / "c.csv").write_text("t,weird\n0,1\n")
    (tmp_path / "d.csv").write_text("t,pri\n0,1,2\n")
    (tmp_path / "e.json").write_text('{"name":"e","channels":[{"id":"f"}],"events":[{"t":0,"values":{"f":null}},{"t":1,"values":{"f":0}}]}')
    (tmp_path / "f.json").write_text('{"channels":[{"id":"f"}],"events":[{"t":0,"values":{}}]}')
    rows = {}
    for r in formats.read_events(spark, str(tmp_path)).collect():
        rows.setdefault(r.path[-5:-4] if r.path.endswith("csv") else r.path[-6], []).append(r)
    assert [r["values"] for r in sorted(rows["a"], key=lambda r: r.event_idx)] == [{"x": 1.0, "freq": 2.5}, {"x": None, "freq": None}]
    assert json.loads(rows["b"][0].recording)["channels"][0]["quantity"] == "pulse-width" and len(rows["b"]) == 2
    assert "declared" in rows["c"][0].error and "cells" in rows["d"][0].error and "every channel" in rows["f"][0].error
    assert [r["values"]["f"] for r in rows["e"]] == [None, 0.0]
    events = formats.read_events(spark, str(tmp_path / "a.csv"))
    out = [r.value for r in formats.event_csv(meta, events, ["x", "freq"]).collect()]
    assert formats.parse_events("\n".join(out)) == formats.parse_events((tmp_path / "a.csv").read_text())


def test_cycle_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# Period: 4\n# unit: s\nt,f\n0,1\n1,\n2,3\n")
    (tmp_path / "b.csv").write_text("a,b\n")
    got = formats.read_cycles(spark, str(tmp_path / "a.csv"))
    assert [(r.t, r.f, r.missing) for r in got.orderBy("t").collect()] == [(0, 1, False), (1, None, True), (2, 3, False)]
    lines = [r.value for r in formats.cycle_csv({"period": "4", "unit": "s"}, got).collect()]
    assert formats.parse_cycle("\n".join(lines)) == formats.parse_cycle((tmp_path / "a.csv").read_text())
    assert "columns" in formats.read_cycles(spark, str(tmp_path / "b.csv")).first().error


def test_stream(spark, tmp_path, small):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(200)
    events.write.parquet(source)
    stream = ingest.event_stream(spark, source)
    for k in ("one", "two"):  # the second run reads everything again, and adds nothing
        ingest.append_new(stream, target, str(tmp_path / k)).awaitTermination()
    assert spark.read.parquet(target).count() == 200
    q = ingest.activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n_events) FROM activity").first()[0] == 200
