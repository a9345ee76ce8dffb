"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local session that names none gets one of its own, a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kinfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder, one folder for each value of the column ``by`` if given, and read it again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for this table; nothing may read it any more."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Rounds:
    """Stored tables of an iterative job, by name: a table goes when the one after its next is written, so whoever still reads the last one can.

    ``end`` deletes all that is left but the given tables, which a lazy result reads.
    """

    def __init__(self) -> None:
        self.held: dict[str, list[DataFrame]] = {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        mine = self.held.setdefault(name, [])
        mine.append(out)
        if len(mine) > 2:
            discard(mine.pop(0))
        return out

    def end(self, *keep: DataFrame) -> None:
        for mine in self.held.values():
            for df in mine:
                if not any(df is k for k in keep):
                    discard(df)
        self.held.clear()
