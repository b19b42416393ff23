"""Session helpers: reading the driver's tables and cutting lineage safely."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table below ``sf_dir``; the path may be any URI that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate rows that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, where all share one disk, may leave it unset; a temporary folder then serves.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster has to name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="emberline-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage, so that a lost executor never loses the rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint where columns compress well."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows, through the file system that Spark uses for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fill(count: int, per: int, least: int = 1) -> int:
    """How many parts of about ``per`` units hold ``count`` units."""
    return max(least, -(-int(count or 0) // per))


def spread(count: int) -> int:
    """Pieces into which to cut each key of ``count`` rows: both pieces and rows per piece grow as a root."""
    return max(1, math.isqrt(int(count or 0)) // 4)
