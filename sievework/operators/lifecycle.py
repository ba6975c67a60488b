"""Funnels, schedules, caps, health rules, compliance, running averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.enrich import literal_map
from ..functions.score import rounded

# Intervals of saved searches in seconds, the weight of a new run in averages.
INTERVALS = {"realtime": 300, "daily": 86_400, "weekly": 604_800}
ALPHA = 0.3
# End of fixed values.


def status_counts(apps: DataFrame, status: str) -> DataFrame:
    return apps.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def funnel(apps: DataFrame, status: str, saved: str = "saved", applied: str = "applied", interview: str = "interview", offer: str = "offer") -> DataFrame:
    """Three ratios to three decimals; null where the denominator is 0."""

    def n(*values):
        return F.sum(F.when(F.col(status).isin(*values), 1).otherwise(0))

    one = apps.agg(F.count(F.lit(1)).alias("total"), n(saved).alias("s"), n(applied).alias("a"), n(interview).alias("i"), n(offer).alias("o"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 3)
    c = F.col
    return one.select(
        "total", ratio(c("total") - c("s"), c("total")).alias("application_rate"), ratio(c("i") + c("o"), c("a")).alias("interview_rate"), ratio(c("o"), c("i")).alias("offer_rate")
    )


def due(frequency: Column, last_run: Column, now: Column) -> Column:
    """A search that never ran is due, whatever its frequency; one of an unknown
    frequency that ran is not due again."""
    wait = literal_map(INTERVALS)[frequency]
    return last_run.isNull() | F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last_run) >= wait, F.lit(False))


def rolling_cap(events: DataFrame, user: str, ts: str, hours: int, cap: int) -> DataFrame:
    """Add n_before (events of the user in the hours up to this one, without it) and allowed."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(user).orderBy(seconds).rangeBetween(-hours * 3_600_000_000, 0)
    return events.withColumn("n_before", F.count(F.lit(1)).over(w) - 1).withColumn("allowed", F.col("n_before") < cap)


def compliance(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Sources that are allowed and whose robots file permits; unknown ones are not."""
    r = rules.select("source_key", (F.col("is_allowed") & F.col("robots_txt_ok")).alias("_ok"))
    return sources.join(r, "source_key", "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")


def health_issues(sources: DataFrame, now: Column, silent_hours: int = 24) -> DataFrame:
    """(source_key, issue) rows. A disabled source gets no further checks. Columns:
    has_row, auto_disabled, consecutive_blocks, last_blocked_at, last_success_at."""
    age = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(c)) / 3600
    live = ~F.coalesce(F.col("auto_disabled"), F.lit(False)) & F.col("has_row")
    checks = {
        "no_row": ~F.col("has_row"),
        "disabled": F.col("has_row") & F.coalesce(F.col("auto_disabled"), F.lit(False)),
        "blocks": live & (F.col("consecutive_blocks") > 0),
        "recently_blocked": live & (age("last_blocked_at") <= 24),
        "never_succeeded": live & F.col("last_success_at").isNull(),
        "silent": live & (age("last_success_at") > silent_hours),
    }
    issues = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return sources.select("source_key", F.explode(issues).alias("issue"))


def ema(df: DataFrame, key: list[str], order: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Final running average from 0.0 on, rounded to two decimals at every step. It
    needs a key's runs in their order, so they are one array: keys are sources, whose
    runs are few; for a stream of runs see streaming.incremental.cursor_states."""
    steps = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"].cast("double"))
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: rounded((1 - alpha) * s + alpha * x))
    return df.groupBy(*key).agg(steps.alias("_a")).select(*key, fold(F.col("_a")).alias("ema"))


def empty_streak(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Runs since the last one that brought something, counted at the end."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    back = df.withColumn("_hit", F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return back.groupBy(*key).agg(F.sum(F.when(F.col("_hit") == 0, 1).otherwise(0)).alias("streak"))


def block_counters(events: DataFrame, key: str, order: list[str], blocked: str, threshold: int = 3, may_disable: str | None = None) -> DataFrame:
    """Consecutive blocks at the end, and whether the threshold was ever reached by a
    block whose source may be disabled (a column; all may, without one)."""
    w = Window.partitionBy(key).orderBy(*order)
    g = events.withColumn("_g", F.sum(F.when(F.col(blocked), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = g.withColumn("_c", F.sum(F.when(F.col(blocked), 1).otherwise(0)).over(Window.partitionBy(key, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("_c", F.struct(*order))
    reached = (F.col("_c") >= threshold) & (F.coalesce(F.col(may_disable), F.lit(False)) if may_disable else F.lit(True))
    return g.groupBy(key).agg(last.alias("consecutive_blocks"), F.bool_or(reached).alias("auto_disabled"))


def pages_until_known(pages: DataFrame, source: str, page: str, known: str) -> DataFrame:
    """Pages up to and including the first whose rows are all known."""
    each = pages.groupBy(source, page).agg(F.bool_and(known).alias("all_known"))
    before = Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("_stop", F.coalesce(F.bool_or("all_known").over(before), F.lit(False))).where("NOT _stop").drop("_stop")


def recent_identities(df: DataFrame, key: list[str], identity: str, position: str, most: int = 300) -> DataFrame:
    """Identities in order of their first place, each once, `most` at most."""
    first = df.groupBy(*key, identity).agg(F.min(position).alias("_p"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_p", identity))
    kept = first.withColumn("_r", rank).where(F.col("_r") <= most)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_r", identity))), lambda x: x[identity])
    return kept.groupBy(*key).agg(ordered.alias("recent"))
