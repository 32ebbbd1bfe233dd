"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans count on. All can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join may add one shuffle after it: cheaper than one task with a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows here are many times larger than their shuffled bytes: tasks of 16 MB sort in memory where those of 64 MB (default) spill, so there must
    # be enough partitions to begin with. Small shuffles are coalesced.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    # A task reads one or a few files of a stage table: its rows fill memory long before the default of 128 MB.
    "spark.sql.files.maxPartitionBytes": "16m",
    # Aggregates with struct buffers hash this many groups per task before they sort (default 128).
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to a session that may have been built elsewhere."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "specledger", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for stage tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, as in tests, the stages go under the session's warehouse, which driver and executors share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"


_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def stage_table(df: DataFrame, name: str, folder: str | None = None, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once and read it back, so later stages do not recompute it.

    The table goes to the shared folder, so a lost executor costs no recomputation of earlier stages, and its size is known to the
    planner when it picks joins. ``file_rows`` bounds the rows of a file, and so of a task that reads it (0: no bound).
    """
    spark = df.sparkSession
    path = f"{folder or stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    if (made := _made.get()) is not None:
        made.append(path)
    return out


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete stage tables that nothing reads any more, through the file system that holds them."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_stages(*frames: DataFrame) -> None:
    """Delete tables made by ``stage_table`` once all that was derived from them is stored."""
    drop_paths(frames[0].sparkSession, [f._stage_path for f in frames])


@contextmanager
def noting_stages(paths: list[str]) -> Iterator[None]:
    """Add the path of every table staged inside to ``paths``."""
    token = _made.set(paths)
    try:
        yield
    finally:
        _made.reset(token)
