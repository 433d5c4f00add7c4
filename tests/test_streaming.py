import datetime as dt

from pyspark.sql import functions as F

from tests.test_sources import patterns, ppm
from viewlake.streaming.ingest import scans_per_window, stream_folder


def test_folder_stream(spark, tmp_path):
    for i, p in enumerate(patterns()):
        ppm(tmp_path / "in" / f"{i}.ppm", p)
    (tmp_path / "in" / "bad.ppm").write_text("x")
    q = stream_folder(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("measured").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("measured")
    assert rows.count() == 4 and rows.where("readable").count() == 3
    assert rows.where(F.col("perceptual_hash") == "cccc3333cccc3333").first()["blur_score"] == 1040400.0


def test_windows_with_late_rows(spark, tmp_path):
    day = lambda d: dt.datetime(2025, 1, d, 12, tzinfo=dt.timezone.utc)
    schema = "scanned_at timestamp, parent_relative string, readable boolean"
    for i, rows in enumerate(([(day(1), "a", True), (day(1), "a", None)], [(day(10), "a", True)], [(day(1), "a", True), (day(20), "b", True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = scans_per_window(stream).writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    first = spark.table("windows").where(F.col("window.start") == F.lit(day(1).replace(hour=0))).first()
    assert (first["parent_relative"], first["unreadable"]) == ("a", 1) and first["scans"] in (2, 3)
