"""Matching of postings with profiles: candidates, factors, thresholds, re-rank hook."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import score as S
from .user_filters import pattern_hits

PROFILE = ["user_id", "cv_embedding", "salary_min", "salary_max", "locations", "languages", "skills", "score_weights"]


def without_user_filters(jobs: DataFrame, filters: DataFrame, title: str = "title", tags: str | None = "tags", limit: int = 200) -> DataFrame:
    """Postings that no active filter hits: title filters ignore case and contain
    literally, tag filters are exact and let null tags pass. As in SQL, a null title
    passes no title filter and an array with a null tag no tag filter; filters
    without a pattern hit nothing. Up to `limit` filters become one predicate
    without a join. More of them are searched for in the distinct titles by one
    automaton, and looked up among the distinct tag lists; what they hit leaves by
    equality anti joins, with the same result."""
    active = filters.where("is_active AND pattern IS NOT NULL").select("filter_type", "pattern")
    rows = active.limit(limit + 1).collect()
    if len(rows) > limit:
        by_title = F.col("filter_type").eqNullSafe("title_contains")
        titles, wanted = active.where(by_title).select(F.lower("pattern").alias("pattern")), active.where(~by_title).select("pattern").distinct()
        out = jobs
        if titles.limit(1).count():
            hit = pattern_hits(jobs.select(title).distinct(), titles, title, title).select(title).distinct()
            out = out.where(F.col(title).isNotNull()).join(hit, title, "left_anti").select(*jobs.columns)
        if tags and wanted.limit(1).count():
            lists = jobs.select(tags).where(F.size(tags) > 0).distinct()
            hit = lists.withColumn("pattern", F.explode(tags)).join(wanted, "pattern", "left_semi").select(tags).distinct()
            out = out.where(F.col(tags).isNull() | ~F.exists(tags, lambda x: x.isNull())).join(hit, tags, "left_anti").select(*jobs.columns)
        return out
    for kind, pattern in rows:
        if kind == "title_contains":
            jobs = jobs.where(~F.contains(F.lower(title), F.lit(pattern.lower())))
        elif tags:
            jobs = jobs.where(F.col(tags).isNull() | ~F.array_contains(tags, pattern))
    return jobs


def every_pair(jobs: DataFrame, profiles: DataFrame, most: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """Every posting with every profile, the work of scoring them. Up to `most`
    profiles of `most_bytes` in all (as JSON) are broadcast. More of them meet the
    postings in a grid: profiles are dealt into blocks of about that size and postings
    into as many slices, and each cell of the grid is one key of a join by shuffle, so
    that no task holds more than a block and a slice."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))
    n, held = profiles.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if n <= most and held <= most_bytes:
        return jobs.crossJoin(F.broadcast(profiles))
    cells = max(-(-n // most), -(-held // most_bytes))
    numbers = F.sequence(F.lit(0), F.lit(cells - 1))
    left = jobs.withColumn("_slice", F.pmod(F.xxhash64("hash"), F.lit(cells)).cast("int")).withColumn("_block", F.explode(numbers))
    right = profiles.withColumn("_block", F.pmod(F.xxhash64("user_id"), F.lit(cells)).cast("int")).withColumn("_slice", F.explode(numbers))
    return left.join(right, ["_block", "_slice"]).drop("_block", "_slice")


def score_matches(jobs: DataFrame, profiles: DataFrame, now: Column, threshold: float = 35.0, times: Column | None = None, most: int = 10_000) -> DataFrame:
    """Every profile with every posting that reaches the threshold. Of a profile, only
    what the score needs travels (PROFILE)."""
    j = every_pair(jobs.where(F.col("embedding").isNotNull()), profiles.where("cv_embedding IS NOT NULL").select(*PROFILE), most)
    parts = {
        "embedding": S.embedding_score(F.col("cv_embedding"), F.col("embedding")),
        "salary": S.pay_score(F.col("salary_min"), F.col("salary_max"), F.col("salary_min_chf"), F.col("salary_max_chf")),
        "location": S.location_score(F.col("locations"), F.col("location")),
        "recency": S.recency_score(S.days_old(now, F.col("first_seen_at"))),
        "language": S.language_score(F.col("languages"), F.col("language")),
        "llm": F.lit(0.0),
    }
    out = j.withColumns({f"score_{k}": v for k, v in parts.items()})
    final = S.final_score({k: F.col(f"score_{k}") for k in parts}, F.col("score_weights"))
    out = out.withColumn("score_final", F.bround(final * (times if times is not None else F.lit(1.0)), 2))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.lower(x))
    skills = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda x: F.lower(x))
    return out.where(F.col("score_final") >= threshold).withColumns(
        {"matching_skills": F.array_sort(F.array_intersect(skills, tags)), "missing_skills": F.array_sort(F.array_except(tags, skills))}
    )


def rerank(matches: DataFrame, scorer: Callable | None = None, schema: str = "user_id string, job_hash string, llm double") -> DataFrame:
    """Merge an external scorer's results. scorer: an iterator function for
    mapInPandas; None (the default) changes nothing. Only scores over 0 count."""
    if scorer is None:
        return matches
    r = matches.select("user_id", F.col("hash").alias("job_hash")).mapInPandas(scorer, schema).where("llm > 0")
    r = r.select(F.col("user_id").alias("_u"), F.col("job_hash").alias("_j"), F.col("llm").alias("_l"))
    j = matches.join(r, (matches["user_id"] == r["_u"]) & (matches["hash"] == r["_j"]), "left")
    j = j.withColumn("score_llm", F.coalesce(F.col("_l") / 100.0, "score_llm")).drop("_u", "_j", "_l")
    parts = {k: F.col(f"score_{k}") for k in S.DEFAULT_WEIGHTS}
    return j.withColumn("score_final", F.when(F.col("score_llm") > 0, S.final_score(parts, F.col("score_weights"))).otherwise(F.col("score_final")))


def nearest(vectors: DataFrame, probe: list[float], id_col: str, vector: str, k: int) -> DataFrame:
    """The k rows of least cosine distance; plans as take-ordered."""
    p = F.array(*[F.lit(float(x)) for x in probe])
    return vectors.select(id_col, F.round(S.cosine(F.col(vector), p), 6).alias("cosine")).orderBy(F.desc("cosine"), id_col).limit(k)
