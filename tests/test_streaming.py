"""Streams against batches over the same files."""

from pyspark.sql import functions as F

from terrace.operators import changes as c
from terrace.streaming import jobs

ROW = "id long, name string, at long, claimed array<string>"


def files(spark, folder, batches, schema):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(writer, folder):
    writer.trigger(availableNow=True).option("checkpointLocation", folder).start().awaitTermination()


def test_snapshots_in_batches(spark, tmp_path):
    first = [(1, "a", 1, []), (2, "b", 1, ["name"]), (3, "c", 1, [])]
    second = [(1, "a2", 2, []), (1, "a3", 3, []), (2, "z", 2, []), (4, "d", 2, [])]
    stream = files(spark, f"{tmp_path}/in", [first, second], ROW)
    fields = {"name": c.text_change(F.col("old.name"), F.col("new.name"), c.MAJOR)}
    finish(jobs.snapshot_changes(stream, f"{tmp_path}/store", f"{tmp_path}/log", "id", fields, [F.desc("at")]), f"{tmp_path}/state")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert {(r.batch, r.id, r.change) for r in log.collect()} == {(0, 1, "created"), (0, 2, "created"), (0, 3, "created"), (1, 1, "updated"), (1, 2, "updated"), (1, 4, "created")}
    last = spark.read.parquet(f"{tmp_path}/store/version=1")
    assert {(r.id, r.name) for r in last.collect()} == {(1, "a3"), (2, "b"), (3, "c"), (4, "d")}


def test_first_shown_equals_batch(spark, tmp_path):
    rows = [[(u, o, b * 100 + k) for k, (u, o) in enumerate([(1, 1), (1, 2), (b, 1), (2, b)])] for b in range(4)]
    stream = files(spark, f"{tmp_path}/in", rows, "user_id long, object_id long, at long")
    finish(jobs.first_shown(stream, ["user_id", "object_id"]).writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/state")
    got = {(r.user_id, r.object_id): r.at for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for batch in rows:
        for u, o, at in batch:
            want.setdefault((u, o), at // 100)
    assert {k: v // 100 for k, v in got.items()} == want


def test_withdrawals_wait_for_arrivals(spark, tmp_path):
    batches = [
        [(1, "withdrawn", 10, 1), (1, "withdrawn", 11, 2), (2, "published", 20, 1)],
        [(1, "published", 12, 3), (2, "withdrawn", 21, 3)],
        [(1, "published", 13, 5), (2, "published", 22, 4), (1, "published", 14, 6)],
    ]
    stream = files(spark, f"{tmp_path}/in", batches, "object_id long, kind string, id long, at long")
    finish(jobs.released_withdrawals(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/state")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 10, 12), (1, 11, 13), (2, 21, 22)}


def test_answers_are_asked_for_again_when_they_expire(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    schema, folder = "key string, at timestamp", f"{tmp_path}/in"
    for rows in ([("a", at(0)), ("b", at(1))], [("a", at(2))], [("c", at(12))], [("a", at(13)), ("b", at(14))]):
        spark.createDataFrame(rows, "key string, at string").selectExpr("key", "CAST(at AS timestamp) AS at").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    finish(jobs.to_ask(stream, 4).writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/state")
    assert sorted((r.key, r["at"].hour) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 0), ("a", 13), ("b", 1), ("b", 14), ("c", 12)]
