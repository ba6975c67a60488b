"""Questions to a slow or paid service, each asked once: cache, batches, retries, fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Answers to a list of questions, by place; None where there is none. May raise.
Provider = Callable[[list[str]], list[str | None]]
BATCH = 25


def _asked(questions: DataFrame, providers: list[Provider], batch: int) -> DataFrame:
    """(question, answer) of one pass: each batch goes to the first provider that does
    not raise; where all do, or one answers short, answers are null."""

    def ask(texts: list[str]) -> list[str | None]:
        for provider in providers:
            try:
                found = list(provider(texts))
            except Exception:  # noqa: BLE001, S112 - whatever a service fails with
                continue
            found = [x if x and x.strip() else None for x in found[: len(texts)]]
            return found + [None] * (len(texts) - len(found))
        return [None] * len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            while len(waiting) >= least and waiting:
                some, waiting[:] = waiting[:batch], waiting[batch:]
                yield pa.record_batch([pa.array(some, pa.string()), pa.array(ask(some), pa.string())], ["question", "answer"])

        for part in batches:
            waiting += part["question"].to_pylist()
            yield from flush(batch)
        yield from flush(1)

    return questions.select("question").mapInArrow(run, "question string, answer string")


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Entries of cache(key, answer, expires_at) that have not expired."""
    return cache.where(F.col("expires_at") > now)


def ask_once(
    requests: DataFrame,
    question: str,
    cache: DataFrame,
    now: Column,
    ttl_seconds: int,
    providers: list[Provider],
    retry: list[Provider] | None = None,
    batch: int = BATCH,
    lanes: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """(requests with answer and answered_by, the next cache).

    Requests that the cache answers are not asked. The others are collapsed to their
    distinct questions, so that a question that a third of all requests have is one
    question, and dealt to `lanes` tasks, which is how many calls run at a time; a call
    asks up to `batch` questions. Questions without an answer are asked once more, of
    `retry` (by default the same providers). answered_by is cache, first, retry, or
    none, where the answer is null; null and empty questions are not asked.

    Answers are written before anything reads them, so later readers and lost executors
    of later stages ask nothing again. The next cache holds the live entries and the
    new answers; what has expired, and questions without an answer, are not in it.
    """
    key = F.md5(F.col(question))
    entries = live(cache, now).groupBy(F.col("key").alias("_key")).agg(F.max_by("answer", "expires_at").alias("_old"), F.max("expires_at").alias("_until"))
    wanted = requests.where(F.coalesce(F.col(question), F.lit("")) != "").select(key.alias("_key"), F.col(question).alias("question")).distinct()
    missing = wanted.join(entries.select("_key"), "_key", "left_anti").select("question")
    first = stored(_asked(missing.repartition(lanes), providers, batch), "asked")
    again = first.where("answer IS NULL").select("question").repartition(lanes)
    second = stored(_asked(again, retry if retry is not None else providers, batch), "asked-again")
    new = first.where("answer IS NOT NULL").withColumn("_by", F.lit("first")).unionByName(second.where("answer IS NOT NULL").withColumn("_by", F.lit("retry")))
    new = new.select(F.md5("question").alias("_key"), F.col("answer").alias("_new"), "_by")
    both = requests.withColumn("_key", key).join(entries.select("_key", "_old"), "_key", "left").join(new, "_key", "left")
    by = F.when(F.col("_old").isNotNull(), "cache").otherwise(F.coalesce("_by", F.lit("none")))
    out = both.withColumns({"answer": F.coalesce("_old", "_new"), "answered_by": by}).drop("_key", "_old", "_new", "_by")
    kept = entries.select(F.col("_key").alias("key"), F.col("_old").alias("answer"), F.col("_until").alias("expires_at"))
    fresh = new.select(F.col("_key").alias("key"), F.col("_new").alias("answer"), (now + F.make_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
    return out, kept.unionByName(fresh)
