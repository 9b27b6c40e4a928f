import datetime as dt
import json
import struct

from pyspark.sql import functions as F

from weftline.sources import files
from weftline.streaming.state import count_pairs, event_stream, latest_store, pool_snapshot, track_pool

PNG = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\x0dIHDR" + struct.pack(">II", 63, 88) + b"rest"
GIF = b"GIF89a" + struct.pack("<HH", 10, 20) + b"x"
BMP = b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -40) + b"x" * 10
JPG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 48, 64) + b"x" * 8


def test_pictures_and_sidecars(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("a/one.PNG", PNG), ("two.gif", GIF), ("three.bmp", BMP), ("four.jpg", JPG), ("bad.webp", b"RIFFxxxx"), ("cut.png", PNG[:18]), ("no.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "two.json").write_text(json.dumps({"expected_name": "Opt", "image_sha256": "f" * 64, "unknown": 1, "saved_detection": {"card_bbox": [1, 2, 3, 4]}}))
    (tmp_path / "three.json").write_text("{broken")
    p = files.pictures(spark, str(tmp_path))
    sizes = {r.path.rsplit("/", 1)[1]: tuple(r.h) for r in p.select("path", files.picture_header("content").alias("h")).collect()}
    assert sizes == {"one.PNG": ("png", 63, 88), "two.gif": ("gif", 10, 20), "three.bmp": ("bmp", 30, 40), "four.jpg": ("jpeg", 64, 48), "bad.webp": (None, None, None), "cut.png": (None, None, None)}
    j = {r.key.rsplit("/", 1)[1]: r for r in files.with_sidecars(p, files.sidecars(spark, str(tmp_path))).collect()}
    assert j["two"].sidecar.expected_name == "Opt" and j["two"].sha256 == "f" * 64 and j["two"].detection.card_bbox == [1, 2, 3, 4]
    assert j["three"].sidecar is None or j["three"].sidecar.expected_name is None
    assert len(j["one"].sha256) == 64 and j["one"].sidecar is None


def test_publish_tolerant_json_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    at = str(tmp_path / "out")
    files.publish(df, at)
    files.publish(df.limit(1), at)
    assert spark.read.parquet(at).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["out"]
    (tmp_path / "x.json").write_text('{"a": 1, "zzz": 5}\n{"b": 2}\n')
    assert [tuple(r) for r in files.read_tolerant(spark, str(tmp_path / "x.json"), "a int, b int", {"a": 0}).collect()] == [(1, None), (0, 2)]
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    files.write_report_csv(df, str(tmp_path / "csv"), ["s", "n"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["s", "n"]
    assert sorted(map(tuple, files.upsert(df, spark.createDataFrame([(2, "new"), (3, "c")], "n int, s string"), "n").collect())) == [(1, "a"), (2, "new"), (3, "c")]


def test_pair_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    for i in range(5):
        rows = [("e" + str(j % 3), "a" + str((i + j) % 2), t + dt.timedelta(hours=i), i * 100 + j) for j in range(20)]
        spark.createDataFrame(rows, "expected_card_id string, actual_card_id string, seen_at timestamp, seq bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    count_pairs(event_stream(spark, str(tmp_path / "ev"), 2), str(tmp_path / "store"), str(tmp_path / "cp"))
    want = spark.read.parquet(str(tmp_path / "ev")).groupBy("expected_card_id", "actual_card_id").count()
    assert sorted(map(tuple, latest_store(spark, str(tmp_path / "store")).select("expected_card_id", "actual_card_id", "seen_count").collect())) == sorted(map(tuple, want.collect()))
    count_pairs(event_stream(spark, str(tmp_path / "ev"), 2), str(tmp_path / "store"), str(tmp_path / "cp"))
    assert latest_store(spark, str(tmp_path / "store")).agg(F.sum("seen_count")).first()[0] == 100


def test_tracked_pool_keeps_fingerprints(spark, tmp_path):
    schema = "session string, name string, set_code string, collector_number string, fingerprint string, seq bigint"
    parts = [[("s", "Opt", "xln", "65", "f1", 1), ("s", "Bolt", None, None, None, 2)], [("s", "Opt", "xln", "65", None, 3), ("s", "Bolt", None, None, "f2", 4)]]
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = track_pool(event_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("pool").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.sql("select * from pool order by updates").collect():
        last[r.name] = (r.fingerprint, r.seq, r.updates)
    batch = {r.name: (r.fingerprint, r.seq, r.updates) for r in pool_snapshot(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert last == batch == {"Opt": ("f1", 3, 2), "Bolt": ("f2", 4, 2)}
