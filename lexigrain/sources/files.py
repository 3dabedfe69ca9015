"""Readers and writers of the formats that tables of names and reference data come in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are left out, and a line that isn't JSON ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(forms, id) of lines ``form, form => id``, split at the last arrow; other lines are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where(F.col("value").contains(" => "))
    return lines.select(F.split(F.regexp_extract("value", r"^(.*) => (.*)$", 1), ", ").alias("forms"), F.regexp_extract("value", r"^(.*) => (.*)$", 2).alias("id"))


def write(df: DataFrame, path: str, kind: str) -> None:
    """Writes Parquet, JSON lines, CSV, TSV or text; the folder must not exist."""
    out = df.write.mode("errorifexists")
    if kind == "tsv":
        out.option("sep", "\t").option("header", True).csv(path)
    elif kind == "csv":
        out.option("header", True).csv(path)
    elif kind in ("parquet", "json", "text"):
        getattr(out, kind)(path)
    else:
        raise ValueError(kind)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``), or a local one on one machine; gone when the session ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexigrain-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
