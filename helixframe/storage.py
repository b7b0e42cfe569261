"""The folder that the driver and all executors share, and tables kept there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where that is unset and Spark runs on this machine alone.

    Anywhere else an unset folder is an error: what one executor wrote to its own disk, others could not read.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="helixframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    # the folder of this application's own within it
    forget_at_exit(spark, sc.getCheckpointDir())
    return d


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives lost executors.

    What came before is then unreachable, and collecting the driver's garbage lets Spark delete its shuffle files now.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    spark._jvm.System.gc()
    return out


def stored(df: DataFrame) -> DataFrame:
    """The same rows from Parquet in the shared folder, for what several plans read a few columns of; the files last as long as the application."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/helixframe-{uuid.uuid4().hex}"
    df.write.parquet(at)
    forget_at_exit(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the driver's JVM ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
