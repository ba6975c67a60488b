"""Snapshot merges. Results are new tables: write them to a new path and swap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """Insert unknown keys; known ones only get last_seen_at = now and is_active =
    true, their contents and duplicate_of stay. new must not repeat a key."""
    seen = new.select(F.col(key).alias("_k"))
    kept = old.join(seen, old[key] == seen["_k"], "left")
    again = F.col("_k").isNotNull()
    kept = kept.withColumns(
        {"last_seen_at": F.when(again, now).otherwise(F.col("last_seen_at")), "is_active": F.when(again, True).otherwise(F.col("is_active"))}
    ).drop("_k")
    return kept.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_results(old: DataFrame, new: DataFrame, key: list[str], scores: list[str]) -> DataFrame:
    """Update scores of known rows, insert new ones, delete rows the run lacks
    unless someone worked with them (feedback, a status other than detected, a draft)."""
    fresh = new.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_{c}") for c in scores])
    on = [old[k] == fresh[f"_{k}"] for k in key]
    hit = F.col(f"_{key[0]}").isNotNull()
    engaged = F.col("feedback").isNotNull() | (F.coalesce("application_status", F.lit("detected")) != "detected") | F.col("draft_letter").isNotNull()
    kept = old.join(fresh, on, "left").where(hit | engaged)
    kept = kept.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in scores}).select(*old.columns)
    return kept.unionByName(new.join(old.select(*key), key, "left_anti"), allowMissingColumns=True).select(*old.columns)


def retention(jobs: DataFrame, saved: DataFrame, pipeline: DataFrame, key: str, seen: str, now: Column, days: int = 60, saved_days: int = 90, pipeline_days: int = 180) -> DataFrame:
    """Add kind (normal, saved, pipeline) and expired. Both id sets are joined once."""
    s = saved.select(F.col(key).alias("_s")).distinct()
    p = pipeline.select(F.col(key).alias("_p")).distinct()
    j = jobs.join(s, jobs[key] == s["_s"], "left").join(p, jobs[key] == p["_p"], "left")
    kind = F.when(F.col("_p").isNotNull(), "pipeline").when(F.col("_s").isNotNull(), "saved").otherwise("normal")
    limit = F.when(F.col("_p").isNotNull(), pipeline_days).when(F.col("_s").isNotNull(), saved_days).otherwise(days)
    age = F.unix_timestamp(now) - F.unix_timestamp(seen)
    return j.withColumns({"kind": kind, "expired": age > limit * 86400}).drop("_s", "_p")


def replace_pending(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pending suggestions go, reviewed ones stay, the new ones come."""
    return old.where("status <> 'pending'").unionByName(new, allowMissingColumns=True)


def review(suggestions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(suggestions with their decisions, filters made from approved ones).
    decisions(id, decision); only pending suggestions can be decided."""
    d = decisions.select(F.col("id").alias("_id"), F.col("decision").alias("_d"))
    open_ = F.col("_d").isNotNull() & (F.col("status") == "pending")
    j = suggestions.join(d, suggestions["id"] == d["_id"], "left")
    filters = j.where(open_ & (F.col("_d") == "approved")).select(
        "user_id",
        F.when(F.col("suggestion_type") == "tag_category", "tag_contains").otherwise("title_contains").alias("filter_type"),
        F.lower(F.trim("pattern")).alias("pattern"),
        F.lit(True).alias("is_active"),
        F.lit("auto").alias("source"),
    )
    return j.withColumn("status", F.when(open_, F.col("_d")).otherwise(F.col("status"))).drop("_id", "_d"), filters


def set_application_status(apps: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes(id, new_status); applied_at is set by the first 'applied' only."""
    c = changes.select(F.col("id").alias("_id"), F.col("new_status").alias("_s"))
    j = apps.join(c, apps["id"] == c["_id"], "left")
    return j.withColumns(
        {
            "applied_at": F.when(F.col("_s") == "applied", F.coalesce("applied_at", now)).otherwise(F.col("applied_at")),
            "status": F.coalesce("_s", "status"),
            "updated_at": F.when(F.col("_s").isNotNull(), now).otherwise(F.col("updated_at")),
        }
    ).drop("_id", "_s")


def latest_feedback(events: DataFrame, key: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """The last event of each key wins; one without a value clears the feedback."""
    return events.groupBy(*key).agg(F.max_by(value, F.struct(ts, tie)).alias("feedback"), F.max(ts).alias("feedback_at"))


def implicit_signals(events: DataFrame, key: list[str], action: str, value: str, ts: str, tie: str) -> DataFrame:
    """All signals of a key as an ordered array of structs."""
    item = F.struct(F.col(ts), F.col(tie), F.col(action).alias("action"), F.col(value).alias("value"))
    ordered = F.sort_array(F.collect_list(item))
    return events.groupBy(*key).agg(F.transform(ordered, lambda x: F.struct(x["action"].alias("action"), x["value"].alias("value"))).alias("signals"))


def erase_user(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    """Every child table without the user's rows."""
    return {name: df.where(F.col("user_id").isNull() | (F.col("user_id") != user_id)) for name, df in tables.items()}


def export_user(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    return {name: df.where(F.col("user_id") == user_id) for name, df in tables.items()}
