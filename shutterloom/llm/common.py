"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    A session on one machine (tests) that names none gets a temporary one; on a cluster that would be a
    folder of the driver's alone, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shutterloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stash(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor, and later reads prune columns. Zstd, as
    Snappy's writers hold memory outside the heap that is freed late when a task follows the other.
    """
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Tell the session to send a thousand rows at most to a Python worker at once.

    Texts are long: Spark's own default, ten thousand, makes batches that are held several times over. Queries
    and pipeline stages call this; operators leave the session as it is.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to clash with a column of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
