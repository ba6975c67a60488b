"""Exclusion filters of many users: one automaton over all title patterns.

Titles are searched for all distinct patterns in one pass, by an Aho-Corasick
automaton in an Arrow UDF; the pattern then finds its users by an equality join, as a
tag finds its own. Candidates meet their own user's filters and their own posting's
hits only, so the work grows with the candidates and not with users times postings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns, and characters of patterns, of one automaton.
MOST_PATTERNS, MOST_CHARS = 100_000, 8_000_000
#: Filters of one user that go along with each candidate; users with more join by filter.
MOST_LISTED = 100


def active_filters(filters: DataFrame) -> DataFrame:
    """(user_id, filter_type, pattern) of filters that can hit something; title
    patterns in lower case."""
    rows = filters.where(F.col("is_active") & F.col("pattern").isNotNull())
    title = F.col("filter_type") == "title_contains"
    return rows.select("user_id", "filter_type", F.when(title, F.lower("pattern")).otherwise(F.col("pattern")).alias("pattern")).distinct()


def removed_filters(filters: DataFrame, requests: DataFrame, id_col: str = "id") -> DataFrame:
    """Filters after the deletions that their users asked for in requests(id, user_id):
    they stay and become inactive. A filter of another user is not found and stays."""
    r = requests.select(F.col(id_col).alias("_id"), F.col("user_id").alias("_user")).distinct()
    j = filters.join(r, (filters[id_col] == r["_id"]) & (filters["user_id"] == r["_user"]), "left")
    return j.withColumn("is_active", F.col("is_active") & F.col("_id").isNull()).drop("_id", "_user")


def _automaton(patterns: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for p in patterns:
        machine.add_word(p, p)
    if patterns:
        machine.make_automaton()
    return machine


def _found(machine, text: str | None) -> list[str]:
    return sorted({p for _, p in machine.iter(text.lower())}) if text and len(machine) else []


#: The automaton that a worker holds, by the key of its search.
_HELD: dict = {}


def held_automaton(key: str, patterns):
    """The automaton of broadcast patterns, made once for a worker."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = _automaton(patterns.value)
    return _HELD[key]


def pattern_hits(titles: DataFrame, patterns: DataFrame, id_col: str, title_col: str, most: int = MOST_PATTERNS) -> DataFrame:
    """(id, pattern) for every pattern contained in a title, both in lower case. The
    empty pattern is in every title; null titles hold none.

    Up to `most` patterns (and MOST_CHARS characters) are one automaton that every
    worker makes from a broadcast list. More are dealt into blocks, and titles into as
    many slices; each cell of that grid is one group of a shuffle, with the block's
    automaton and the slice's titles.
    """
    patterns = patterns.select(F.col("pattern")).where("pattern IS NOT NULL").distinct()
    t = titles.where(F.col(title_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(title_col).alias("_title"))
    real = patterns.where("pattern <> ''")
    n, chars, everywhere = patterns.agg(F.count_if(F.col("pattern") != ""), F.coalesce(F.sum(F.char_length("pattern")), F.lit(0)), F.count_if(F.col("pattern") == "") > 0).first()
    blocks = max(-(-n // most), -(-chars // MOST_CHARS), 1)
    if blocks == 1:
        spark = titles.sparkSession
        shared, key = spark.sparkContext.broadcast([r[0] for r in real.collect()]), uuid.uuid4().hex  # checked above

        @F.arrow_udf("array<string>")
        def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            machine = held_automaton(key, shared)
            for part in texts:
                yield pa.array([_found(machine, x) for x in part.to_pylist()], pa.list_(pa.string()))

        hits = t.select("_id", F.explode(found("_title")).alias("pattern"))
    else:
        numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
        id_type = titles.select(id_col).schema[0].dataType.simpleString()
        left = t.withColumn("_slice", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).withColumn("_block", F.explode(numbers))
        right = real.withColumn("_block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int")).withColumn("_slice", F.explode(numbers))

        def searched(some: pa.Table, block: pa.Table) -> pa.Table:
            machine = _automaton(block["pattern"].to_pylist())
            ids, found = [], []
            for i, text in zip(some["_id"].to_pylist(), some["_title"].to_pylist()):
                own = _found(machine, text)
                ids += [i] * len(own)
                found += own
            return pa.table({"_id": pa.array(ids, some["_id"].type), "pattern": pa.array(found, pa.string())})

        cells = left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice"))
        hits = cells.applyInArrow(searched, f"_id {id_type}, pattern string")
    if everywhere:
        hits = hits.unionByName(t.select("_id", F.lit("").alias("pattern")))
    return hits.withColumnRenamed("_id", id_col)


def hidden_pairs(jobs: DataFrame, filters: DataFrame, id_col: str = "hash", title: str = "title", tags: str = "tags", most: int = MOST_PATTERNS) -> DataFrame:
    """(user_id, id) of every posting that an active filter of the user hits: a title
    pattern contained in the title whatever the case, or a tag that equals a tag
    pattern. Postings without tags pass every tag filter."""
    active = active_filters(filters)
    titles = active.where("filter_type = 'title_contains'").select("user_id", "pattern")
    wanted = active.where("filter_type = 'tag_contains'").select("user_id", "pattern")
    by_title = pattern_hits(jobs, titles, id_col, title, most).join(titles, "pattern")
    by_tag = jobs.select(F.col(id_col), F.explode(F.array_distinct(tags)).alias("pattern")).join(wanted, "pattern")
    return by_title.select("user_id", id_col).unionByName(by_tag.select("user_id", id_col)).distinct()


def without_hidden(
    pairs: DataFrame, jobs: DataFrame, filters: DataFrame, id_col: str = "hash", title: str = "title", tags: str = "tags", most: int = MOST_PATTERNS, listed: int = MOST_LISTED
) -> DataFrame:
    """Candidate pairs (user_id, id, ...) without those that the user's own filters
    hide. As in SQL, a posting without a title passes no title filter. Users without
    filters keep all; filters of users without candidates do nothing.

    A posting has marks: the title patterns it contains, its tags, a missing title; a
    user wants none of some marks. A candidate goes where the two lists meet. Users who
    name more than `listed` marks join by user and mark instead, so that a candidate
    never brings along more than its posting's own marks."""
    active = active_filters(filters)
    of_title = F.col("filter_type") == "title_contains"
    mark = lambda kind, value: F.concat(F.lit(kind), value)
    named = F.when(of_title, F.array(mark("t", F.col("pattern")), F.lit("u"))).when(F.col("filter_type") == "tag_contains", F.array(mark("g", F.col("pattern"))))
    unwanted = active.select("user_id", F.explode(named).alias("_mark")).distinct()
    own = unwanted.groupBy("user_id").agg(F.collect_list("_mark").alias("_unwanted"))
    hits = pattern_hits(jobs, active.where(of_title).select("pattern"), id_col, title, most).select(id_col, mark("t", F.col("pattern")).alias("_mark"))
    plain = F.concat(F.transform(F.coalesce(F.array_distinct(tags), F.array().cast("array<string>")), lambda x: mark("g", x)), F.array(F.when(F.col(title).isNull(), "u")))
    marks = hits.unionByName(jobs.select(id_col, F.explode(plain).alias("_mark"))).where("_mark IS NOT NULL")
    found = marks.groupBy(id_col).agg(F.collect_set("_mark").alias("_marks"))

    few = own.where(F.size("_unwanted") <= listed)
    many = own.where(F.size("_unwanted") > listed).select("user_id")
    hidden = F.coalesce(F.arrays_overlap("_unwanted", "_marks"), F.lit(False))
    out = pairs.join(few, "user_id", "left").join(found, id_col, "left").where(~hidden).select(*pairs.columns)
    if many.isEmpty():
        return out
    strict = pairs.select("user_id", id_col).join(many, "user_id", "left_semi").distinct().join(marks, id_col).join(unwanted, ["user_id", "_mark"], "left_semi")
    return out.join(strict.select("user_id", id_col).distinct(), ["user_id", id_col], "left_anti").select(*pairs.columns)
