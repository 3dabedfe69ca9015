"""Tables written in the folder that all executors share, to cut lineage and to reuse a costly pass."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a local one, as in tests, but never on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        kept = context.getCheckpointDir()
        if kept.isEmpty():
            if not one_machine(spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrain-"))
            kept = context.getCheckpointDir()
        folder = kept.get()
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a work table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it again: later uses neither recompute it nor depend on lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = work_path(spark, name)
    df.write.parquet(path)
    _let_go(spark)
    out = spark.read.schema(schema).parquet(path)
    out.lexigrain_path = path
    return out


def _let_go(spark: SparkSession) -> None:
    """What the plan before had exchanged is garbage now. Spark deletes such files once the driver's collector has seen
    that, which on a large heap may be long after, so it is asked to look. Listeners hold the last query they heard of
    until they hear of another."""
    spark.sql("SELECT 1").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext._jvm.java.lang.System.gc()
