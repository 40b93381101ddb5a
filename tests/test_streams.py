"""The window counts over a stream: late rows beyond the watermark are dropped."""

from datetime import datetime, timedelta

from lumenframe.operators.relations import windowed_counts


def test_late_rows_are_dropped(spark, tmp_path):
    start = datetime(2024, 1, 1)
    source, schema = str(tmp_path / "in"), "ts timestamp, event_type string"
    batches = [[(start, "a"), (start + timedelta(hours=1), "a")], [(start + timedelta(hours=20), "a")], [(start + timedelta(hours=2), "a"), (start + timedelta(hours=40), "b")], [(start + timedelta(hours=60), "b")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = windowed_counts(spark.readStream.schema(schema).parquet(source), late="2 hours")
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first = min(got)
    assert got[first] == 2 and len(got) == 3  # the row at two hours came too late
