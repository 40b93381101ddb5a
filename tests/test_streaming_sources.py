import hashlib

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import sequence
from lumenframe.sources import tables
from lumenframe.streaming.filters import filter_stream

FOLDER = "/root/testdata/sf0.001"


def test_stream_ends_where_the_fold_does(spark, tmp_path):
    rows = sequence.standard(spark, FOLDER).where("user_id < 4").select("user_id", F.timestamp_seconds("t").alias("ts"), F.col("t").alias("event_id"), F.when(F.col("seen"), F.col("x")).alias("x"))
    for k in range(2):
        rows.where(f"event_id >= 25 = {bool(k)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = filter_stream(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r["user_id"]: r for r in spark.sql("select user_id, max_by(struct(*), n) s from states group by user_id").select("s.*").collect()}
    want = sequence.kalman_filter_final(spark, FOLDER).where("user_id < 4").collect()
    for w in want:
        assert got[w["user_id"]]["n"] == w["n_steps"] and round(got[w["user_id"]]["mean"], 5) == pytest.approx(w["mean"], abs=2e-5)


def test_csv_json_and_hashes(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "k int, s string, v double")
    tables.write_csv(rows, str(tmp_path / "c"), ["k"])
    back = tables.read_csv(spark, str(tmp_path / "c"), "k int, s string, v double")
    assert sorted(map(tuple, back.collect())) == [(1, "a", 0.5), (2, "b", None)]
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "c"), "k int, other string, v double").collect()
    tables.write_json(rows, str(tmp_path / "j"))
    assert tables.read_json(spark, str(tmp_path / "j"), "k int, s string, v double").count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_bytes(b"abc")
    found = tables.file_hashes(spark, str(tmp_path / "f"))
    assert found.first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert tables.hash_differences(found, found).count() == 0
    assert [r["verdict"] for r in tables.hash_differences(found, found.limit(0)).collect()] == ["unexpected"]
