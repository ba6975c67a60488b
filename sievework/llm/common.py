"""What the training-data operators share: tables, scratch folders, constants."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one
    under the warehouse where that is unset and Spark is one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df below the shared folder and read it back.

    This cuts the lineage: after it, a lost executor costs a re-read of files
    rather than a recomputation, and several readers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by stored(), once nothing reads it."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    tops = {f.split(root + "/", 1)[1].split("/")[0] for f in df.inputFiles() if root + "/" in f}
    for top in tops:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{top}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """Lower-case A-Z only, in the JVM."""
    return F.translate(col, UPPER, LOWER)
