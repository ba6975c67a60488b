"""A stored full-text index: postings by token bucket and impact level, kept up by increments.

A posting (token, id, n, words) says that a text of `words` words holds the token n
times; its impact is n / (1 + ln(words + 1)). Postings lie in folders by generation and
bucket (a hash of the token), sorted by token and level (the impact on a logarithmic
scale): a query opens the folders of its tokens, and of their files the row groups and
pages of its tokens, a ranked one those of the best levels. The level gives a bound
for every impact in it, which ends the search early.

Every call of `add` makes a generation and commits it by a row in the ledger; a text
that comes again counts as it is in its newest generation. Frequent tokens are spread
over several files of their folder.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Snapshots

WORD_BREAK = r"(?U)[^\w]+"
BUCKETS = 16
#: Levels for each halving of the impact.
FINE = 2
#: Files of a bucket that a frequent token is spread over.
SPREAD = 4


def impact(n: Column, words: Column) -> Column:
    return n / (1 + F.log(words + 1))


def level_of(value: float) -> int:
    """Impacts of level l are at most 2 ** (-l / FINE), and over the next level's bound."""
    return math.floor(-FINE * math.log2(value)) if value > 0 else 10**6


def query_words(query: str) -> list[str]:
    return [w for w in dict.fromkeys(re.split(r"\W+", query.lower())) if w]


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, key_type: str = "long", buckets: int = BUCKETS):
        self.spark, self.path, self.key_type, self.buckets = spark, path.rstrip("/"), key_type, buckets
        self.ledger = Snapshots(spark, f"{self.path}/ledger", "generation long")

    def generations(self) -> list[int]:
        return [r[0] for r in self.ledger.current().collect()]

    def add(self, docs: DataFrame, key: str, *columns: str) -> int:
        """Take in texts: the words of the columns. Null texts have no words; of rows
        with one key, all words count together; rows without a key are left out."""
        done = self.generations()
        generation = max(done, default=-1) + 1
        words = F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), WORD_BREAK), lambda t: t != "")
        cut = docs.where(F.col(key).isNotNull()).select(F.col(key).cast(self.key_type).alias("id"), words.alias("w"))
        sizes = cut.groupBy("id").agg(F.sum(F.size("w")).alias("words"))
        rows = cut.select("id", F.explode("w").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(sizes, "id").withColumn("level", F.floor(-FINE * F.log2(impact(F.col("n"), F.col("words")))).cast("int"))
        placed = rows.withColumns({"generation": F.lit(generation), "bucket": F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")})
        spread = F.pmod(F.xxhash64("id"), F.lit(SPREAD))
        sorted_ = placed.repartition("bucket", spread).sortWithinPartitions("generation", "bucket", "token", "level")
        sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "bucket").parquet(f"{self.path}/postings")
        sizes.withColumn("generation", F.lit(generation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(f"{self.path}/texts")
        self.ledger.commit(self.spark.createDataFrame([(g,) for g in [*done, generation]], "generation long"))
        return generation

    def _table(self, name: str, schema: str) -> DataFrame:
        done = self.generations()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("generation").isin(done))

    def _postings(self, words: list[str]) -> DataFrame:
        """Postings of the words; the folders of other buckets are not opened."""
        schema = f"id {self.key_type}, words long, n long, token string, level int, generation int, bucket int"
        buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return self._table("postings", schema).where(F.col("bucket").isin(buckets) & F.col("token").isin(words))

    def _newest(self, hits: DataFrame) -> DataFrame:
        """Hits of the newest generation of their text; nothing to do for one generation."""
        if len(self.generations()) < 2:
            return hits
        texts = self._table("texts", f"id {self.key_type}, words long, generation int")
        last = texts.join(hits.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("generation").alias("generation"))
        return hits.join(last, ["id", "generation"], "left_semi")

    def containing(self, query: str) -> DataFrame:
        """(id, n): texts that hold every word of the query, and how often, all words
        together. A query without words finds every text, with 0."""
        words = query_words(query)
        if not words:
            return self._table("texts", f"id {self.key_type}, words long, generation int").select("id", F.lit(0).cast("long").alias("n")).distinct()
        hits = self._newest(self._postings(words)).groupBy("id").agg(F.count(F.lit(1)).alias("found"), F.sum("n").alias("n"))
        return hits.where(F.col("found") == len(words)).select("id", "n")

    def ranked(self, query: str, k: int, digits: int = 6) -> DataFrame:
        """(id, rank): the k texts of the highest rank, the sum of the impacts of the
        query's words in them, rounded; ties go by id. Texts without any of them have
        no rank.

        Levels are read best first until k texts are known; the k-th partial rank is then
        a bound that every text of the result reaches, so one of its words has at least
        that impact divided by the number of words. Only texts with such a posting are
        candidates, and only these are ranked."""
        words = query_words(query)
        if not words or k < 1:
            return self.spark.createDataFrame([], f"id {self.key_type}, rank double")
        postings = self._newest(self._postings(words))
        rank = F.round(impact(F.sum("n"), F.max("words")), digits)
        per_level = sorted(map(tuple, postings.groupBy("level").agg(F.count(F.lit(1))).collect()))
        least, known = None, 0
        for level, n in per_level:
            known += n
            if known >= k * len(words):  # k texts at least, as each has a posting a word at most
                least = level
                break
        candidates = postings
        if least is not None:
            best = postings.where(F.col("level") <= least).groupBy("id").agg(rank.alias("rank")).orderBy(F.desc("rank")).limit(k)
            bound = best.agg(F.min("rank")).first()[0]
            lowest = level_of((bound - 10**-digits) / len(words) * (1 - 1e-9))
            if lowest < per_level[-1][0]:
                ids = postings.where(F.col("level") <= lowest).select("id").distinct()
                candidates = postings.join(ids, "id", "left_semi")
        return candidates.groupBy("id").agg(rank.alias("rank")).orderBy(F.desc("rank"), "id").limit(k)


def index_of(spark: SparkSession, home: str, docs: DataFrame, key: str, *columns: str) -> TextIndex:
    """The index of a table below home: made once for the table's files as they are
    now (paths, sizes, times of change), and found again by every later query."""
    seen = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    files = seen.agg(F.md5(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", "file_path", "file_size", "file_modification_time"))), *map(F.lit, (key, *columns))))).first()[0]
    index = TextIndex(spark, f"{home}/fulltext-{files}", dict(docs.dtypes)[key])
    if not index.generations():
        index.add(docs, key, *columns)
    return index
