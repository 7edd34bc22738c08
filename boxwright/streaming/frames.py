"""Frame streams: detection on arrival, failure counting with state, event-time counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"
#: Read failures in a row that end a camera.
MOST_FAILURES = 8


def frames(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Frames as they arrive; ``per_trigger`` files a batch bound what a late consumer sees."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", per_trigger).option("latestFirst", False).parquet(path)


def class_counts(rows: DataFrame, late: str = "10 minutes", width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and class, closed by a watermark (R09). Works on batches too."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    marked = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A camera's sessions: frames less than ``gap`` apart."""
    marked = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def failure_states(rows: DataFrame, most: int = MOST_FAILURES) -> DataFrame:
    """(user_id, failures, failed) after each batch: failures in a row, reset by a success; ``most`` fail the camera."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames_: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, failed = state.get if state.exists else (0, False)
        batch = pd.concat(list(frames_)).sort_values(["ts", "event_id"])
        for kind in batch["event_type"]:
            count = count + 1 if kind == "error" else 0
            failed = failed or count >= most
        state.update((count, failed))
        yield pd.DataFrame([(key[0], count, failed)], columns=["user_id", "failures", "failed"])

    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, failures int, failed boolean", "failures int, failed boolean", "update", GroupStateTimeout.NoTimeout)


def drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a bounded stream to its end and stops."""
    query = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_progress(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Appends each batch with its number: a ledger that a resumed run reads first."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("event_id", "event_type", F.lit(number).alias("batch")).write.mode("append").parquet(path)

    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def isolated(rows: DataFrame) -> DataFrame:
    """Each item's result or its error; one bad item never ends the batch."""
    parsed = F.try_parse_json("props")
    return rows.select("event_id", F.when(parsed.isNull(), "unreadable properties").when(F.col("event_type") == "error", "read failed").alias("error"))
