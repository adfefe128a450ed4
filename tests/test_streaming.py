import json

from pyspark.sql import functions as F

from weftline.operators import lineage
from weftline.streaming import feeds


def test_batches_are_applied_once_and_folded(spark, tmp_path):
    sink = feeds.VersionedSink(str(tmp_path / "sink"))
    make = lambda rows: spark.createDataFrame(rows, "id long, at long, op string, v string")
    sink(make([(1, 1, "upsert", "a"), (2, 1, "upsert", "b")]), 0)
    sink(make([(1, 2, "upsert", "c"), (2, 2, "remove", None)]), 1)
    sink(make([(1, 9, "upsert", "again")]), 1)  # run again after a failure: done already
    sink(make([]), 2)
    assert [(r.id, r.v) for r in sink.read(spark, "id", ["at"], "op").collect()] == [(1, "c")]
    assert json.loads(lineage.read_text(spark, f"{sink.path}/manifest.json")) == {"batches": [0, 1]}


def test_half_written_batch_is_not_seen(spark, tmp_path):
    sink = feeds.VersionedSink(str(tmp_path / "sink"))
    rows = spark.createDataFrame([(1, 1, "upsert", "a")], "id long, at long, op string, v string")
    sink(rows, 0)
    rows.withColumn("batch_id", F.lit(1)).write.parquet(f"{sink.path}/batch-1")  # failed before the manifest moved
    assert sink.read(spark, "id", ["at"], "op").count() == 1
    sink(rows.withColumn("v", F.lit("b")), 1)
    assert sink.read(spark, "id", ["at"], "op").first().v == "b"


def test_sliding_windows_over_a_folder(spark, tmp_path):
    spark.sql("SELECT id, 'k' AS k, timestamp_seconds(id * 60) AS ts FROM range(10)").write.parquet(str(tmp_path / "in"))
    stream = feeds.source(spark, str(tmp_path / "in"), "id long, k string, ts timestamp")
    out = feeds.once(feeds.windowed(stream, "k", "ts", "4 minutes", "2 minutes", "1 minute"), "sliding", "complete", str(tmp_path / "c"))
    assert {r.began.timestamp() / 60: r.n for r in out.collect()} == {-2: 2, 0: 4, 2: 4, 4: 4, 6: 4, 8: 2}
    kept = feeds.once(feeds.deduplicated(feeds.source(spark, str(tmp_path / "in"), "id long, k string, ts timestamp"), ["k"], "ts", "1 hour").select("k"), "dedup", "append", str(tmp_path / "d"))
    assert kept.count() == 1


def test_small_files_are_replaced_whole(spark, tmp_path):
    at = f"file://{tmp_path}/m.json"
    assert lineage.read_text(spark, at) is None
    for text in ("one", "two é"):
        lineage.write_text(spark, at, text)
        assert lineage.read_text(spark, at) == text
