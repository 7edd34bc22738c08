"""Where operators keep what they materialise: tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a batch of texts for Python holds at most, so that workers stay small (a longer text is a batch of its own).
BATCH_BYTES = 8 << 20
_WORDS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local master gets a local one; on a cluster
    that is an error, as executors would write where nobody reads."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = f"file://{tempfile.gettempdir()}/boxwright-checkpoints"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands Python batches of ``BATCH_BYTES`` at most."""
    conf = df.sparkSession.conf
    now = str(conf.get(_BATCH)).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/boxwright/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # once the table is written its shuffle files are of no use
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    return materialise(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table written by :func:`materialise`, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Tables that one operator materialises, by frame, so that each can be deleted once nothing reads it."""

    def __init__(self) -> None:
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep(*materialise(df, name))

    def keep(self, df: DataFrame, path: str) -> DataFrame:
        self._paths[id(df)] = (df, path)
        return df

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the tables of these frames; other frames are passed over."""
        for df in frames:
            if id(df) in self._paths:
                _, path = self._paths.pop(id(df))
                remove(df.sparkSession, path)

    def drop_all_but(self, *frames: DataFrame) -> None:
        kept = {id(df) for df in frames}
        self.drop(*(df for df, _ in list(self._paths.values()) if id(df) not in kept))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, whose joins sort and shuffle. Spark takes rows that are exploded, and tables whose columns compress well, for as small as the file
    that they are read from, and would send them whole through the driver."""
    return df.hint("merge")


def maybe_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` (a 64-bit hash) is in ``ids`` (one column), and few others: a filter before a shuffle.

    A bit for each id in a table of 2**26 bits, of which only words with a bit are sent: at most 2**20 rows of two longs.
    """
    slot = lambda c: c.bitwiseAND(F.lit(_WORDS - 1))
    bit = lambda c: F.expr(f"shiftleft(1L, cast((`{c}` >> 20) & 63 AS INT))")
    only = ids.columns[0]
    words = ids.select(slot(F.col(only)).alias("_slot"), bit(only).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    found = df.join(F.broadcast(words), slot(F.col(column)) == F.col("_slot")).where(F.col("_bits").bitwiseAND(bit(column)) != 0)
    return found.select(*df.columns)
