"""Views over matches, applications, documents and profiles: predicates, joins, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Feedback by sign.
NEGATIVE_FEEDBACK = ["dismissed", "thumbs_down"]
POSITIVE_FEEDBACK = ["thumbs_up", "applied"]


def not_negative(feedback: Column) -> Column:
    """Rows without feedback are kept."""
    return feedback.isNull() | ~feedback.isin(NEGATIVE_FEEDBACK)


def positive(feedback: Column) -> Column:
    return feedback.isin(POSITIVE_FEEDBACK)


def with_status(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    """All rows for None, an empty text and 'all', else those of the status."""
    return df if not status or status == "all" else df.where(F.col(column) == status)


def query_matches(df: DataFrame, query: str, columns: list[str], blocked: list[str] = (), source: str = "company") -> DataFrame:
    """Rows of a source that cannot search by itself: the query is contained in the
    columns joined by spaces, whatever the case, and the source column holds no
    blocked word."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    hit = F.contains(text, F.lit(query.lower()))
    for word in blocked:
        hit = hit & ~F.coalesce(F.contains(F.lower(source), F.lit(word.lower())), F.lit(False))
    return df.where(hit) if query or blocked else df


def match_cards(matches: DataFrame, jobs: DataFrame, schools: DataFrame | None = None, least: float = 0.0, most: int | None = None) -> DataFrame:
    """Matches with their posting and, where one is named, its school, best first. With
    `most`, that many cards and their place in the order. An inner join: a match whose
    posting is gone has no card."""
    out = matches.where(F.col("score_final") >= least).join(jobs, "job_hash")
    if schools is not None:
        out = out.join(schools, "school_id", "left")
    order = [F.desc("score_final"), F.desc("score_embedding"), F.asc("job_hash")]
    if most is None:
        return out.orderBy(*order)
    # The window's one partition holds `most` rows, taken before it.
    return out.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def by_urgency(df: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Highest sum of score and urgency first; a missing urgency is none. With `most`,
    that many rows and their place in the order."""
    order = [F.desc(F.col("score_final") + F.coalesce("urgency_score", F.lit(0.0))), F.asc(key)]
    if most is None:
        return df.orderBy(*order)
    # The window's one partition holds `most` rows, taken before it.
    return df.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def newest(df: DataFrame, moment: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(moment), key)


def documents_of(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Generated documents with the posting they were made for, if it is still there."""
    return documents.join(jobs, "job_hash", "left")


def users_with_profile(users: DataFrame, profiles: DataFrame) -> DataFrame:
    return users.join(profiles, "user_id")


def rejected_count(df: DataFrame, feedback: Column, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count_if(F.coalesce(feedback.isin(NEGATIVE_FEEDBACK), F.lit(False))).alias("rejected"))


def run_counters(df: DataFrame, group: list[str], outcome: str = "outcome") -> DataFrame:
    """Counters of a run: rows seen, and those new, updated, duplicate or failed."""
    kinds = {"new": "new", "updated": "updated", "duplicates": "duplicate", "errors": "error"}
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("fetched"), *[F.count_if(F.col(outcome) == v).alias(k) for k, v in kinds.items()])
