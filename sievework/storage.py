"""Tables in the folder that driver and executors share, and versioned snapshots."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder below the warehouse where that is unset and
    Spark is one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once and read back: what it took to make it, calls of models and
    services included, is not done again for later readers or lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    """A table kept as whole versions below one folder.

    `data/` holds the versions, `commits/` one file of one row for each version that
    counts: version, its data, and the (stream, batch) that made it. Spark moves that
    file into place by one rename, so a version is either there or not; data without
    a commit, left by a crash, is never read. The commits are the ledger that makes
    repeated batches harmless.
    """

    _COMMIT = "version long, data string, stream string, batch long"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def commits(self) -> DataFrame:
        """The ledger: a row for each version."""
        try:
            return self.spark.read.schema(self._COMMIT).json(f"{self.path}/commits/*/part-*")
        except Exception as e:  # nothing committed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self._COMMIT)

    def current(self) -> DataFrame:
        """The rows of the newest version; none before the first one."""
        newest = self.commits().orderBy(F.desc("version")).select("data").first()
        if newest is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{newest['data']}")

    def commit(self, rows: DataFrame, stream: str = "", batch: int | None = None) -> int:
        """Make rows the next version. Of two writers of one version, the later fails."""
        data = uuid.uuid4().hex
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(f"{self.path}/data/{data}")
        last = self.commits().agg(F.max("version")).first()[0]
        version = 0 if last is None else last + 1
        row = self.spark.createDataFrame([(version, data, stream, batch)], self._COMMIT).coalesce(1)
        row.write.mode("errorifexists").json(f"{self.path}/commits/{version:012d}")
        return version

    def done(self, stream: str, batch: int) -> bool:
        """Whether some version was made by this batch of this stream."""
        return self.commits().where((F.col("stream") == stream) & (F.col("batch") == batch)).limit(1).count() > 0

    def each_batch(self, stream: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch that makes merge(current, batch) the next version
        once for each batch, however often Spark repeats the batch."""

        def step(batch: DataFrame, batch_id: int) -> None:
            if not self.done(stream, batch_id):
                self.commit(merge(self.current(), batch), stream, batch_id)

        return step
