"""Table schemas and the raw posting record."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_AS = T.ArrayType(_S)


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in columns.items()])


POSTING = _table(
    hash=_S, source=_S, title=_S, company=_S, url=_S, location=_S, canton=_S, description=_S, description_snippet=_S, remote=_B, tags=_AS,
    language=_S, seniority=_S, contract_type=_S, salary_min_chf=_I, salary_max_chf=_I, salary_original=_S, salary_currency=_S, salary_period=_S,
    logo=_S, employment_type=_S, embedding=T.ArrayType(T.FloatType()), is_active=_B, first_seen_at=_TS, last_seen_at=_TS, category=_S,
    fuzzy_hash=_S, duplicate_of=_S,
)
MATCH_RESULT = _table(
    user_id=_S, job_hash=_S, score_embedding=_D, score_salary=_D, score_location=_D, score_recency=_D, score_llm=_D, score_final=_D, urgency_score=_D,
    matching_skills=_AS, missing_skills=_AS, explanation=_S, feedback=_S,
    feedback_implicit=T.ArrayType(_table(action=_S, duration_ms=_I)), application_status=_S, application_status_at=_TS, draft_letter=_S,
)
USER_PROFILE = _table(
    user_id=_S, title=_S, skills=_AS, languages=_AS, locations=_AS, salary_min=_I, salary_max=_I, remote_pref=_S, cv_text=_S,
    cv_embedding=T.ArrayType(T.FloatType()), score_weights=T.MapType(_S, _D), watchlist_schools_enabled=_B,
)
USER = _table(id=_S, email=_S, plan=_S, is_active=_B, created_at=_TS)
APPLICATION = _table(id=_S, user_id=_S, job_hash=_S, status=_S, notes=_S, applied_at=_TS, follow_up_date=_TS, updated_at=_TS)
TITLE_FILTER = _table(id=_S, user_id=_S, filter_type=_S, pattern=_S, is_active=_B, source=_S)
SUGGESTION = _table(
    id=_S, user_id=_S, suggestion_type=_S, pattern=_S, description=_S, confidence=_D,
    sample_jobs=T.ArrayType(_table(title=_S, company=_S)), affected_count=_I, status=_S, created_at=_TS,
)
SAVED_SEARCH = _table(id=_S, user_id=_S, name=_S, filters=T.MapType(_S, _S), min_score=_D, notify_frequency=_S, last_run_at=_TS, total_matches=_I, is_active=_B)
NOTIFICATION = _table(id=_S, user_id=_S, event_type=_S, data=_S, is_read=_B, created_at=_TS)
DOCUMENT = _table(id=_S, user_id=_S, job_hash=_S, doc_type=_S, content=_S, language=_S, created_at=_TS)
COMPLIANCE = _table(source_key=_S, is_allowed=_B, robots_txt_ok=_B, consecutive_blocks=_I, last_blocked_at=_TS, auto_disabled=_B, tos_reviewed_at=T.DateType())
CURSOR = _table(
    source_key=_S, scope_key=_S, recent_identities=_AS, bootstrap_complete=_B, avg_new_jobs_per_run=_D, avg_pages_per_run=_D,
    consecutive_empty_runs=_I, last_run_at=_TS, last_success_at=_TS,
)

TABLES = {
    "jobs": POSTING, "match_results": MATCH_RESULT, "user_profiles": USER_PROFILE, "users": USER, "job_applications": APPLICATION,
    "job_filters": TITLE_FILTER, "pattern_suggestions": SUGGESTION, "saved_searches": SAVED_SEARCH, "notifications": NOTIFICATION,
    "generated_documents": DOCUMENT, "source_compliance": COMPLIANCE, "source_cursors": CURSOR,
}

REQUIRED = ("hash", "source", "title", "company", "url")


def conform(df, schema: T.StructType = POSTING):
    """Project to the schema: unknown columns go, missing ones become null, types are cast."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def valid_rows(df):
    """(rows with all required values and a title and url, the others): a bad row
    is set aside and never fails its batch."""
    from pyspark.sql import functions as F

    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull()
    ok = ok & (F.trim("title") != "") & (F.trim("url") != "")
    return df.where(ok), df.where(~ok)
