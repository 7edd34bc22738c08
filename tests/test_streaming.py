import datetime as dt

from pyspark.sql import functions as F

from boxwright.streaming import frames


def write_frames(spark, path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, frames.FRAME).coalesce(1).write.mode("append").parquet(f"{path}")
    return path


def made(kinds, user=1, start=0):
    at = dt.datetime(2024, 1, 1)
    return [(start + i, at + dt.timedelta(seconds=20 * (start + i)), user, kind, 1.0, "{}") for i, kind in enumerate(kinds)]


def test_window_counts_stream_equals_batch(spark, tmp_path):
    path = write_frames(spark, f"{tmp_path}/in", [made(["a", "b"] * 10), made(["a"] * 5, start=20)])
    stream = frames.class_counts(frames.frames(spark, path), late="0 seconds")
    frames.drain(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.start, r.event_type): r.n for r in frames.class_counts(spark.read.parquet(path)).collect()}
    last = max(k[0] for k in want)
    assert got == {k: v for k, v in want.items() if k[0] < last}  # the last window is still open


def test_failure_state_counts_in_a_row(spark, tmp_path):
    path = write_frames(spark, f"{tmp_path}/in", [made(["error"] * 3 + ["ok"] + ["error"] * 8), made(["ok", "error"], user=2)])
    seen = []
    stream = frames.failure_states(frames.frames(spark, path, per_trigger=10))
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.user_id, r.failures, r.failed) for r in seen} == {(1, 8, True), (2, 1, False)}


def test_progress_ledger_and_isolation(spark, tmp_path):
    path = write_frames(spark, f"{tmp_path}/in", [made(["ok", "error"])])
    frames.append_progress(frames.frames(spark, path), f"{tmp_path}/ledger", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 2
    rows = spark.read.parquet(path).withColumn("props", F.when(F.col("event_id") == 0, "{").otherwise("{}"))
    assert {r.event_id: r.error for r in frames.isolated(rows).collect()} == {0: "unreadable properties", 1: "read failed"}
    assert frames.sessions(spark.read.parquet(path)).first().n == 2
