"""Incremental runs: watermarks, cursors with state, upserts by micro-batch, time windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import ALPHA
from ..storage import Snapshots


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, each, checkpoint: str) -> None:
    """Process all that is there, exactly once over restarts, then stop."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def since(df: DataFrame, ts: str, watermark, now, look_back_days: int = 7) -> tuple[DataFrame, object]:
    """(rows newer than the watermark, the next watermark = now taken before the
    query). Without a watermark, or with one that is no time, the run looks back."""
    first = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(look_back_days))
    start = F.coalesce(F.lit(watermark).try_cast("timestamp"), first)
    return df.where((F.col(ts) > start) & (F.col(ts) <= F.lit(now).cast("timestamp"))), now


RUN = "source_key string, scope_key string, run_at timestamp, identities array<string>, n_new int, pages int"
CURSOR_OUT = (
    "source_key string, scope_key string, recent_identities array<string>, runs int, avg_new_jobs_per_run double, avg_pages_per_run double, "
    "consecutive_empty_runs int, last_run_at timestamp, last_empty_at timestamp"
)
#: Fixed value: identities that a cursor keeps.
MOST_RECENT = 300
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged_identities(fetched: list[str], recent: list[str], most: int = MOST_RECENT) -> list[str]:
    """The newest first, each once, without empty ones, `most` at most."""
    return list(islice((x for x in dict.fromkeys([*fetched, *recent]) if x), most))


class _Cursor(StatefulProcessor):
    """State of one (source, scope): a list of recent identities, and one value with
    runs, two averages, empty runs in a row and moments. Averages start at 0.0."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "identity string")
        self.totals = handle.getValueState("totals", "runs int, new double, pages double, empty int, last timestamp, last_empty timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names of the interface
        recent = [x[0] for x in self.recent.get()]
        runs, new, pages, empty, last, last_empty = self.totals.get() if self.totals.exists() else (0, 0.0, 0.0, 0, None, None)
        for run in sorted(rows, key=lambda r: r["run_at"]):
            recent = merged_identities(run["identities"] or [], recent, self.most)
            found = run["n_new"] or 0
            new = round((1 - ALPHA) * new + ALPHA * found, 2)
            pages = round((1 - ALPHA) * pages + ALPHA * (run["pages"] or 0), 2)
            empty = empty + 1 if found == 0 else 0
            last, last_empty, runs = run["run_at"], run["run_at"] if found == 0 else last_empty, runs + 1
        if recent:  # an empty list cannot be put
            self.recent.put([(x,) for x in recent])
        else:
            self.recent.clear()
        self.totals.update((runs, new, pages, empty, last, last_empty))
        yield Row(
            source_key=key[0], scope_key=key[1], recent_identities=recent, runs=runs, avg_new_jobs_per_run=new, avg_pages_per_run=pages,
            consecutive_empty_runs=empty, last_run_at=last, last_empty_at=last_empty,
        )

    def close(self) -> None:
        pass


def cursor_states(runs: DataFrame, most: int = MOST_RECENT) -> DataFrame:
    """The cursor of each (source_key, scope_key) after every batch of a stream of runs
    (columns of RUN). Runs of a batch are taken in their order; batches must come in
    theirs. Needs the state store STATE_STORE."""
    return runs.groupBy("source_key", "scope_key").transformWithState(
        statefulProcessor=_Cursor(most), outputStructType=CURSOR_OUT, outputMode="Update", timeMode="None"
    )


def latest_cursors(old: DataFrame, changed: DataFrame) -> DataFrame:
    """The table of cursors after a batch: changed rows stand in for old ones."""
    return old.join(changed.select("source_key", "scope_key"), ["source_key", "scope_key"], "left_anti").unionByName(changed)


def run_cursors(runs: DataFrame, table: Snapshots, checkpoint: str, most: int = MOST_RECENT) -> None:
    """Take in all runs that are there, then stop; `table` holds the cursors after it.
    A batch that Spark repeats after a crash changes nothing."""
    conf = runs.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass")
    conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        each = table.each_batch(checkpoint, latest_cursors)
        query = cursor_states(runs, most).writeStream.outputMode("update").foreachBatch(each)
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before)


def fresh_only(events: DataFrame, id_col: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Each identity once within the watermark's delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def tumbling_counts(events: DataFrame, ts: str, kind: str, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def session_counts(events: DataFrame, ts: str, user: str, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("start"), "n")


def breaker(events: DataFrame, key: str, ts: str, failed: str, failures: int = 5, reset_seconds: int = 60) -> DataFrame:
    """Circuit-breaker state of each key after its calls in order (closed, open, half_open by the last call's time)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        count, opened, state = 0, None, "closed"
        for t, bad in pdf.sort_values(ts)[[ts, failed]].itertuples(index=False):
            if state == "open" and (t - opened).total_seconds() >= reset_seconds:
                state = "half_open"
            if state == "open":
                continue
            if bad:
                count += 1
                if state == "half_open" or count >= failures:
                    state, opened = "open", t
            else:
                count, state = 0, "closed"
        return pd.DataFrame({key: [pdf[key].iloc[0]], "state": [state], "failures": [count]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandas(fold, f"{key} {kind}, state string, failures int")
