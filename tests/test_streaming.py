from __future__ import annotations

import datetime as dt

from plumbline.sources.sinks import read_latest
from plumbline.streaming.windows import keep_latest, read_events, session_lengths, windowed_counts
from tests.conftest import rows_of

START = dt.datetime(2025, 1, 1)
SCHEMA = "ts timestamp, kind string, value double"


def test_a_stream_ends_with_what_the_table_gives(spark, tmp_path):
    rows = [(START + dt.timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(60)]
    events = str(tmp_path / "events")
    for part in (rows[:20], rows[20:45], rows[45:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(events)
    stream = windowed_counts(read_events(spark, events, 1), "ts", "1 hour", ["kind"], "value", late="1 day")
    keep_latest(stream, str(tmp_path / "out"), ["start", "kind"], str(tmp_path / "checkpoint")).awaitTermination(120)
    table = windowed_counts(spark.read.parquet(events), "ts", "1 hour", ["kind"], "value")
    assert rows_of(read_latest(spark, str(tmp_path / "out")).drop("batch")) == rows_of(table)


def test_sessions(spark):
    rows = [(START + dt.timedelta(minutes=m), "a", 1.0) for m in (0, 10, 39, 80)]
    got = session_lengths(spark.createDataFrame(rows, SCHEMA), "ts", "30 minutes", ["kind"]).orderBy("start").collect()
    assert [(r.n, r.start.minute + 60 * r.start.hour) for r in got] == [(3, 0), (1, 80)]
    assert session_lengths(spark.createDataFrame([], SCHEMA), "ts", "30 minutes", ["kind"]).count() == 0
