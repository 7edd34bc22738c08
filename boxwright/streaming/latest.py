"""Streams that are worked on at their own pace: a source that skips to the newest frame, and a query that can be paused and cancelled."""

from __future__ import annotations

import json
import posixpath
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from boxwright.sources.files import _store
from boxwright.sources.sinks import _fs, exists

FORMAT = "latest_frame"
RUN, PAUSE, CANCEL = "run", "pause", "cancel"


class _Frame(InputPartition):
    def __init__(self, name: str, skipped: int) -> None:
        self.name, self.skipped = name, skipped


class LatestFrameReader(DataSourceStreamReader):
    """Offsets are names of frame files, which ascend; a batch is the newest frame alone and how many before it nobody saw."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")

    def _names(self) -> list[str]:
        from pyarrow import fs

        store, top = _store(self.path)
        return sorted(n for i in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if i.is_file and (n := posixpath.basename(i.path))[0] not in "._")

    def initialOffset(self) -> dict:
        return {"name": ""}

    def latestOffset(self) -> dict:
        return {"name": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        waiting = [n for n in self._names() if start["name"] < n <= end["name"]]
        return [_Frame(waiting[-1], len(waiting) - 1)] if waiting else []

    def read(self, partition: _Frame) -> Iterator[tuple]:
        store, top = _store(f"{self.path}/{partition.name}")
        with store.open_input_stream(top) as f:
            yield partition.name, f.read(), partition.skipped


class LatestFrame(DataSource):
    """``spark.readStream.format("latest_frame").load(folder)``: rows of name, content and skipped."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary, skipped long"

    def streamReader(self, schema) -> LatestFrameReader:
        return LatestFrameReader(self.options)


def latest_frames(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(LatestFrame)
    return spark.readStream.format(FORMAT).load(path)


class Cancelled(RuntimeError):
    """The control table says that the query is to end."""


def set_control(spark: SparkSession, path: str, state: str) -> None:
    """Adds a state to a control table: a file a change, the last by number counts."""
    if state not in (RUN, PAUSE, CANCEL):
        raise ValueError(f"unknown control state {state!r}")
    fs, make = _fs(spark, path)
    n = len(fs.listStatus(make(path))) if exists(spark, path) else 0
    out = fs.create(make(f"{path}/{n:09d}.json"), False)
    try:
        out.write(bytearray(json.dumps({"number": n, "state": state}).encode()))
    finally:
        out.close()


def control(spark: SparkSession, path: str) -> str:
    """The state that counts: ``run`` if none was set."""
    if not exists(spark, path):
        return RUN
    row = spark.read.schema("number long, state string").json(path).agg(F.max_by("state", "number").alias("state")).first()
    return row["state"] or RUN


def controlled(rows: DataFrame, handle: Callable[[DataFrame, int], None], control_path: str, checkpoint: str, every: float = 0.5, available_now: bool = False) -> StreamingQuery:
    """A query that asks its control table before each micro-batch. While paused the batch waits, so its offsets stay uncommitted; a
    cancelled query ends before the batch, which a later run from the same checkpoint begins with. State lives in the checkpoint, so
    pausing, cancelling and resuming lose and repeat nothing, as long as ``handle`` replaces what it wrote for a batch number."""
    spark = rows.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        while (state := control(spark, control_path)) == PAUSE:
            time.sleep(every)
        if state == CANCEL:
            raise Cancelled(f"cancelled before batch {number}")
        handle(batch, number)

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{every} seconds")).start()
