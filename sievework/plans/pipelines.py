"""The daily run as one chain of DataFrame stages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enrich import normalised
from ..functions.text import fuzzy_hash, identity_hash, posting_text
from ..operators.dedup import mark_duplicates, semantic_duplicates, stored_duplicates
from ..operators.matching import score_matches
from ..operators.merge import upsert
from ..operators.models import embedded
from ..operators.search import not_student, visible
from ..schema import POSTING, conform, valid_rows
from ..storage import Snapshots, stored


def blocked_titles(df: DataFrame, words: list[str]) -> DataFrame:
    """Without rows whose title contains a blocked word; the words are a parameter."""
    return df.where(~F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("title"), w))) if words else df


def ingest(raw: DataFrame, jobs: DataFrame, now: Column, blocked: list[str] = (), rules: dict | None = None, similar: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(the jobs table after this run, rows set aside): block list, normalisation,
    hashes, fuzzy duplicates of stored active postings and among the new rows, upsert,
    semantic duplicates."""
    rows = conform(blocked_titles(raw, list(blocked)), POSTING)
    rows = rows.withColumns({"hash": identity_hash(F.col("title"), F.col("company"), F.col("url")), "fuzzy_hash": fuzzy_hash(F.col("title"), F.col("company"))})
    good, bad = valid_rows(normalised(rows, rules))
    good = good.withColumns({"first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": now, "is_active": F.lit(True)}).dropDuplicates(["hash"])
    good = stored_duplicates(good.drop("duplicate_of"), jobs)
    good = good.withColumn("is_active", F.col("duplicate_of").isNull()).select(*POSTING.names)
    return marked_copies(upsert(jobs, good, "hash", now), similar), bad


def marked_copies(jobs: DataFrame, similar: float = 0.95) -> DataFrame:
    """jobs with semantic duplicates among the active rows marked: the oldest stays."""
    alive = jobs.where("is_active AND embedding IS NOT NULL").select(F.xxhash64("hash").alias("_i"), "hash", "embedding", F.unix_timestamp("first_seen_at").alias("_o"))
    near = semantic_duplicates(alive, similar, "_i", "embedding", "_o")
    names = alive.select("_i", "hash")
    found = near.join(names, "_i").join(names.select(F.col("_i").alias("duplicate_of"), F.col("hash").alias("_c")), "duplicate_of").select("hash", F.col("_c").alias("duplicate_of"))
    return mark_duplicates(jobs, found)


def chained(
    raw: DataFrame,
    jobs: Snapshots,
    profiles: DataFrame,
    now: Column,
    model: Callable[[list[str]], np.ndarray],
    blocked: list[str] = (),
    rules: dict | None = None,
    similar: float = 0.95,
    threshold: float = 35.0,
) -> tuple[DataFrame, DataFrame]:
    """(matches of this run, rows set aside): takes in raw postings, gives those without
    a vector one, marks copies, and scores what is visible for every profile. The jobs
    table has a version after taking in and one after the vectors; a run that is lost in
    between continues from the first of them."""
    merged, bad = ingest(raw, jobs.current(), now, blocked, rules, similar)
    jobs.commit(merged, "ingest")
    pending = jobs.current()
    text = posting_text(F.col("title"), F.col("company"), F.col("description"), F.col("tags"))
    jobs.commit(marked_copies(stored(embedded(pending, F.when(F.col("is_active"), text), model), "embedded"), similar), "embed")
    shown = jobs.current().where(visible() & not_student())
    return score_matches(shown, profiles, now, threshold), bad
