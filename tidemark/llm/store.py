"""Where the operators put intermediate tables.

Every cut of a lineage is a Parquet table in the folder that the cluster names
in ``spark.checkpoint.dir``: all executors share it, so a lost executor costs a
recomputation of its tasks only.  Where the setting is unset a temporary folder
is set once for the session, which only a local master can share with its
executors: anything else is an error.  The tables of an application lie in one
folder, which goes when the driver ends.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/tidemark-{sc.applicationId}"
    if getattr(sc, "_tidemark_folder", None) != folder:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        sc._tidemark_folder = folder
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back, lineage cut."""
    path = new_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let go of shuffles that nothing refers to any more: Spark removes their files when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashes(rows: DataFrame, column: str, k: int) -> DataFrame:
    """At most ``k`` rows, those with the least hashes of ``column``: the same rows under any partitioning.

    A bound on the hash, from the number of rows, leaves about ``2 k`` of them,
    so that the final cut does not gather ``k`` rows of every partition.
    """
    from pyspark.sql import functions as F

    n, h = rows.count(), F.xxhash64(column)
    if n > 8 * k:
        rows = rows.where(h <= F.lit(-(1 << 63) + (1 << 64) * 2 * k // n))
    return rows.orderBy(h, column).limit(k)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name
