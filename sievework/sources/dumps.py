"""Landed search dumps as a Spark data source: partitions by file, keys pruned to a bucket.

A dump is a folder of `bucket=<n>` folders of text files; every line is one response
of a search service, {"hits": {"total": {"value": n}, "hits": [{"_id", "_source"}]}}.
A record lies in bucket crc32(_id) mod the number of buckets, so that a filter on one
key, or a list of keys, opens only their buckets.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "_id string, _source string"
PAGE = 100
BATCH = 4096


def bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _DumpReader(DataSourceReader):
    def __init__(self, path: str, buckets: int):
        self.path, self.buckets = path, buckets
        self.keys: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - name of the interface
        """Filters on the key choose buckets, and files are searched for these keys
        only; every other filter is Spark's."""
        for f in filters:
            own = f.attribute == ("_id",) if isinstance(f, EqualTo | In) else False
            if not own:
                yield f
                continue
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.keys = wanted if self.keys is None else self.keys & wanted

    def partitions(self) -> list[InputPartition]:
        where, base = fs.FileSystem.from_uri(self.path)
        wanted = None if self.keys is None else {bucket_of(k, self.buckets) for k in self.keys if k is not None}
        found = []
        for info in where.get_file_info(fs.FileSelector(base, recursive=True)):
            at = re.search(r"/bucket=(\d+)/[^/_.][^/]*$", info.path)
            if info.is_file and at and (wanted is None or int(at[1]) in wanted):
                found.append(_File(info.path))
        return sorted(found, key=lambda p: p.path) or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        """Records of one file; lines that do not parse, and hits without an id, are
        passed over, as an empty page is."""
        if not partition.path:
            return
        where, _ = fs.FileSystem.from_uri(self.path)
        ids, sources = [], []
        with where.open_input_stream(partition.path, compression="detect") as f, pa.PythonFile(f, "r") as lines:
            for line in _lines(lines):
                try:
                    hits = json.loads(line)["hits"]["hits"]
                except (ValueError, KeyError, TypeError):
                    continue
                for hit in hits:
                    key = (hit.get("_id") or "").strip()
                    if key and (self.keys is None or key in self.keys):
                        ids.append(key)
                        sources.append(json.dumps(hit.get("_source"), ensure_ascii=False))
                if len(ids) >= BATCH:
                    yield pa.record_batch([pa.array(ids, pa.string()), pa.array(sources, pa.string())], ["_id", "_source"])
                    ids, sources = [], []
        yield pa.record_batch([pa.array(ids, pa.string()), pa.array(sources, pa.string())], ["_id", "_source"])


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class SearchDump(DataSource):
    """spark.read.format("search_dump").option("buckets", n).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "search_dump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _DumpReader(self.options["path"], int(self.options.get("buckets", 1)))


def land(records: DataFrame, path: str, key: str, facet: str, buckets: int, page: int = PAGE) -> None:
    """Write records as responses: pages of `page` hits for each facet and bucket. A
    record of two facets is in two responses. Rows of a hot facet are spread over the
    buckets before they are numbered."""
    fields = F.struct(*[F.col(c) for c in records.columns if c not in (key, facet)])
    hit = F.struct(F.col(key).cast("string").alias("_id"), fields.alias("_source"))
    rows = records.select(F.col(facet).alias("_facet"), hit.alias("hit"), F.pmod(F.crc32(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias("bucket"))
    at = F.row_number().over(Window.partitionBy("_facet", "bucket").orderBy("hit._id")) - 1
    pages = rows.withColumn("_page", F.floor(at / page)).groupBy("bucket", "_facet", "_page").agg(F.collect_list("hit").alias("hits"))
    body = F.to_json(F.struct(F.struct(F.struct(F.size("hits").alias("value")).alias("total"), F.col("hits")).alias("hits")))
    pages.select("bucket", body.alias("value")).repartition("bucket").write.partitionBy("bucket").text(path)


def read_dump(spark: SparkSession, path: str, buckets: int, fields: str, keys: list[str] | None = None) -> DataFrame:
    """(_id, fields) of a landed dump, each id once: a record that several facets
    brought counts once. With keys, only their buckets are opened."""
    spark.dataSource.register(SearchDump)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("search_dump").option("buckets", buckets).load(path)
    if keys is not None:
        df = df.where(F.col("_id") == keys[0]) if len(keys) == 1 else df.where(F.col("_id").isin(keys))
    parsed = df.select("_id", F.from_json("_source", fields).alias("_s")).select("_id", "_s.*")
    return parsed.dropDuplicates(["_id"])
