"""Tables between steps of the jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the scratch() that is open, if one is.
_open: ContextVar[str | None] = ContextVar("scratch", default=None)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the one set for checkpoints."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = found.get()
    return folder.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings with these values, and as they were after it; what is to run under them has to be written within."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def small_files(spark: SparkSession) -> dict[str, str]:
    """Settings for folders of very many small files: by default a task reads some thirty of them, and a stream has a task list each for itself."""
    return {"spark.sql.files.openCostInBytes": str(1 << 16), "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(8 * spark.sparkContext.defaultParallelism)}


@contextmanager
def scratch(spark: SparkSession, parent: str | None = None) -> Iterator[str]:
    """Tables that steps write meanwhile go into one folder, which is deleted at the end.

    Frames that come of these steps read such tables, so what is to stay has to be written elsewhere within. Without a scratch,
    and those of the corpus operators always, tables stay in the checkpoint folder until who runs the job empties it.
    """
    folder = f"{parent or checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _open.set(folder)
    try:
        yield folder
    finally:
        _open.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_scratch() -> str | None:
    return _open.get()


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key to as many partitions as there are cores, for small tables that are read very often; within a partition in order of key."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key)


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the open scratch() or the checkpoint folder, read back: lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{open_scratch() or checkpoint_folder(spark)}/groups-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a table that written() gave and that nothing reads any more."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
