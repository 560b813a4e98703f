import datetime as dt

from rootline.streaming import live


def test_first_of_content(spark, tmp_path):
    rows = [(f"n{i}", f"h{i % 3}", float(i)) for i in range(9)]
    spark.createDataFrame(rows, "node_id string, content_hash string, created_epoch_seconds double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.first_of_content(live.read(spark, str(tmp_path / "in"), "node_id string, content_hash string, created_epoch_seconds double"))
    got = live.drain(stream, "firsts", "append", str(tmp_path / "c"))
    assert sorted(r.content_hash for r in got.collect()) == ["h0", "h1", "h2"]


def test_abandoned(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    schema = "node_id string, kind string, at timestamp"
    for i, rows in enumerate([[("a", "open", t), ("b", "open", t)], [("a", "close", t + dt.timedelta(seconds=60))], [("z", "open", t + dt.timedelta(hours=2))], [("z", "close", t + dt.timedelta(hours=3))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={i}"))
    stream = live.abandoned(live.read(spark, str(tmp_path / "in/*"), schema))
    got = live.drain(stream, "gone", "append", str(tmp_path / "c"))
    assert [r.node_id for r in got.collect()] == ["b"]
