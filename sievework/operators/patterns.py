"""Rejection patterns: n-gram and tag counts, confidence, greedy suggestions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens

MIN_RATE = 0.55
MOST_TAGS, MOST_PER_TYPE, MOST = 50, 10, 20


def confidence(rate: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), 0.7 * rate + 0.3 * F.least(n, F.lit(10)) / 10)


def ngram_counts(df: DataFrame, title: str, rejected: str, group: list[str] = ()) -> DataFrame:
    """(group, pattern, rejected, total): occurrences, from one pass over the titles."""
    # The words are a column of their own: inside the lambda they would be cut anew for each run.
    cut = df.select(*group, F.col(rejected).cast("int").alias("_r"), tokens(F.col(title)).alias("_w"))
    rows = cut.select(*group, "_r", F.explode(F.concat(*[ngrams(F.col("_w"), n) for n in (1, 2, 3)])).alias("pattern"))
    return rows.groupBy(*group, "pattern").agg(F.sum("_r").alias("rejected"), F.count(F.lit(1)).alias("total"))


def tag_counts(df: DataFrame, tags: str, rejected: str, group: list[str] = ()) -> DataFrame:
    """The same for tags, each once a document, trimmed and lower-cased."""
    own = F.filter(F.array_distinct(F.transform(tags, lambda t: F.lower(F.trim(t)))), lambda t: t != "")
    rows = df.select(*group, F.col(rejected).cast("int").alias("_r"), F.explode(own).alias("pattern"))
    return rows.groupBy(*group, "pattern").agg(F.sum("_r").alias("rejected"), F.count(F.lit(1)).alias("total"))


def rated(counts: DataFrame, least: int = 2, rate: float = MIN_RATE) -> DataFrame:
    r = F.col("rejected") / F.col("total")
    return counts.where((F.col("rejected") >= least) & (r >= rate)).withColumns({"rate": r, "confidence": confidence(r, F.col("rejected"))})


def samples(df: DataFrame, title: str, rejected: str, order: str, patterns: DataFrame, n: int = 5) -> DataFrame:
    """The first n rejected titles of each pattern, one a document."""
    cut = df.where(F.col(rejected)).select(order, F.col(title).alias("_t"), tokens(F.col(title)).alias("_w"))
    grams = F.array_distinct(F.concat(*[ngrams(F.col("_w"), k) for k in (1, 2, 3)]))
    rows = cut.select(order, "_t", F.explode(grams).alias("pattern")).join(patterns.select("pattern"), "pattern", "left_semi")
    rank = F.row_number().over(Window.partitionBy("pattern").orderBy(order))
    top = rows.withColumn("_n", rank).where(F.col("_n") <= n)
    return top.groupBy("pattern").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]).alias("samples"))


def title_suggestions(counts: DataFrame, group: list[str], least: int = 2) -> DataFrame:
    """Greedy choice by count: at most ten patterns a group, none whose words lie in
    a chosen one. counts: the 100 most rejected of a group; ties go by the pattern."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("rejected"), "pattern"))
    top = counts.where(F.col("rejected") >= least).withColumn("_n", rank).where("_n <= 100").drop("_n")
    scored = top.withColumn("rate", F.col("rejected") / F.col("total"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, keep = [], []
        for row in pdf.sort_values(["rejected", "pattern"], ascending=[False, True]).itertuples():
            if row.rate < MIN_RATE:
                continue
            words = row.pattern.split()
            if any(all(w in p for w in words) for p in chosen):
                continue
            chosen.append(row.pattern.split())
            keep.append(row.Index)
            if len(keep) == MOST_PER_TYPE:
                break
        return pdf.loc[keep]

    picked = scored.groupBy(*group).applyInPandas(choose, scored.schema)
    return picked.withColumn("confidence", F.round(confidence(F.col("rate"), F.col("rejected")), 3))


def tag_suggestions(counts: DataFrame, group: list[str], least: int = 2) -> DataFrame:
    """Of the 50 most rejected tags of a group, the first ten with a high rate; ties
    go by the tag. counts: tag_counts of the group's documents."""
    w = Window.partitionBy(*group).orderBy(F.desc("rejected"), "pattern")
    top = counts.where(F.col("rejected") >= least).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MOST_TAGS)
    high = top.withColumn("rate", F.col("rejected") / F.col("total")).where(F.col("rate") >= MIN_RATE)
    first = high.withColumn("_m", F.row_number().over(w)).where(F.col("_m") <= MOST_PER_TYPE).drop("_n", "_m")
    return first.withColumn("confidence", confidence(F.col("rate"), F.col("rejected")))


def suggestions(df: DataFrame, title: str, tags: str, rejected: str, group: list[str], least: int = 2) -> DataFrame:
    """(group, type, pattern, rejected, total, rate, confidence, rank): title patterns
    and tags of each group together, the most confident 20. Of equal confidence, titles
    come before tags, then the more rejected, then the pattern. Groups with fewer than
    `least` rejected documents have none."""
    enough = df.groupBy(*group).agg(F.count_if(F.col(rejected)).alias("_r")).where(F.col("_r") >= least).drop("_r")
    kept = df.join(enough, group, "left_semi")
    titles = title_suggestions(ngram_counts(kept, title, rejected, group), group, least).withColumn("type", F.lit("title_pattern"))
    by_tag = tag_suggestions(tag_counts(kept, tags, rejected, group), group, least).withColumn("type", F.lit("tag_category"))
    both = titles.withColumn("confidence", confidence(F.col("rate"), F.col("rejected"))).unionByName(by_tag)
    order = [F.desc("confidence"), F.desc("type"), F.desc("rejected"), F.asc("pattern")]
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= MOST)
    return ranked.withColumn("confidence", F.round("confidence", 3))


def most_confident(suggestions: DataFrame, most: int = MOST) -> DataFrame:
    """The suggestions of all types together, the most confident first."""
    return suggestions.orderBy(F.desc("confidence"), F.desc("rejected"), "pattern").limit(most)
