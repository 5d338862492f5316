"""Streams through the memory sink, and activity files."""

import io
import time
import zipfile

from pyspark.sql import functions as F

from fallline.sources import activity
from fallline.streaming import presence

GPX = b"""<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>
<trkpt lat="39.6" lon="-106.3"><ele>3000</ele><time>2024-01-05T10:00:00Z</time><speed>-1</speed></trkpt>
<trkpt lat="39.7" lon="-106.4"><time>2024-01-05T10:00:05.5Z</time><extensions><speed>4.5</speed></extensions></trkpt></trkseg>
<trkseg><trkpt lat="39.8" lon="x"/><trkpt lat="39.8" lon="-106.5"/>"""


def streamed(spark, tmp_path, name, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}*")


def test_latest_positions(spark, tmp_path):
    first, second = [(1, 10.0, 1.0, 1.0), (1, 9.0, 2.0, 2.0), (2, 5.0, 0.0, 0.0)], [(1, 10.0, 3.0, 3.0), (1, 11.0, 4.0, 4.0), (2, 4.0, 1.0, 1.0)]
    packets = streamed(spark, tmp_path, "p", [first + second], "user_id long, at double, lat double, lon double")
    q = presence.latest_positions(packets).writeStream.format("memory").queryName("latest").option("checkpointLocation", f"{tmp_path}/c").start()
    until = time.time() + 90  # state with timeouts asks for batches without end, so it can't be awaited
    while time.time() < until and spark.table("latest").where("at IN (11, 5)").count() < 2:
        time.sleep(0.5)
    q.stop()
    got = spark.sql("SELECT user_id, max_by(lat, at) AS lat, max(at) AS at FROM latest GROUP BY user_id ORDER BY user_id").collect()
    assert [(r.user_id, r.lat, r.at) for r in got] == [(1, 4.0, 11.0), (2, 0.0, 5.0)]


def test_cell_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1, "a"), ("2024-01-01 00:20:00", 2, "a"), ("2024-01-01 03:00:00", 1, "b")]
    df = spark.createDataFrame(rows, "ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    got = presence.cell_counts(df).orderBy("window").collect()
    assert [(r.n, r.users) for r in got] == [(2, 2), (1, 1)]


def test_keep_latest_is_idempotent(spark, tmp_path):
    write = presence.keep_latest(f"{tmp_path}/t", ["user_id"], "at")
    batch = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "user_id long, at double")
    for k in range(2):
        write(batch, k)
    write(spark.createDataFrame([(2, 1.0), (3, 1.0)], "user_id long, at double"), 2)
    t = spark.read.parquet(f"{tmp_path}/t")
    last = t.agg(F.max("version")).first()[0]
    assert sorted((r.user_id, r.at) for r in t.where(F.col("version") == last).collect()) == [(1, 2.0), (2, 5.0), (3, 1.0)]


def test_gpx_and_kinds(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("in/GPS.csv", "1,2,3\n")
    rows = [("a.bin", GPX), ("b.gpx", b""), ("c", z.getvalue()), ("d", b"\x0e\x10\0\0\0\0\0\0.FIT"), ("e", b"SQLite format 3\0"), ("f", b"<TrainingCenterDatabase>"), ("g", b"?")]
    df = spark.createDataFrame(rows, "path string, content binary")
    kinds = {r.path: r.k for r in df.select("path", activity.kind(F.col("path"), F.col("content")).alias("k")).collect()}
    assert kinds == {"a.bin": "gpx", "b.gpx": "gpx", "c": "zip", "d": "fit", "e": "sqlite", "f": "tcx", "g": "unknown"}
    got = activity.tracks(df.where("path = 'a.bin'")).orderBy("segment", "seq").collect()
    assert [(r.segment, r.seq, r.lat, r.elevation, r.speed) for r in got] == [(0, 0, 39.6, 3000.0, None), (0, 1, 39.7, None, 4.5), (1, 0, 39.8, None, None)]
    assert got[1].ts.microsecond == 500_000
    members = sorted((r.path, r.name, r.content and bytes(r.content), r.problem) for r in activity.zipped(df.where("path IN ('c', 'g')"), 100).collect())
    assert members == [("c", "in/GPS.csv", b"1,2,3\n", None), ("g", None, None, "no archive")]
    assert [r.problem for r in activity.zipped(df.where("path = 'c'"), 2).collect()] == ["size"]


def test_gps_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("# comment\n1.0,39.0,-106.0,3000,0,5\n2.0,0,-100,1,1,1\n3.0,95,9,1,1,1\n1700000000,39.0,-106.0,3000,0,-1\n")
    assert [(r.ts, r.speed, r.at_s) for r in activity.gps_csv(spark, str(tmp_path / "g.csv")).collect()] == [(1.0, 5.0, 978307201.0), (1700000000.0, None, 1700000000.0)]
