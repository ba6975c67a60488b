"""Search: predicates, order, pages, facets, statistics, full text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_all, search_tokens


def visible() -> Column:
    return F.col("is_active") & F.col("duplicate_of").isNull()


def not_student() -> Column:
    """Null-safe: unknown levels and contracts stay."""
    return (F.col("seniority").isNull() | (F.col("seniority") != "intern")) & (
        F.col("contract_type").isNull() | ~F.col("contract_type").isin("internship", "apprenticeship")
    )


def csv_values(text: str | None, upper: bool = False) -> list[str]:
    found = [x.strip() for x in (text or "").split(",")]
    return [x.upper() if upper else x for x in found if x]


def pay_overlap(lo: Column, hi: Column, least: int | None, most: int | None) -> Column:
    """The posting's range meets the asked one; unknown bounds drop out."""
    c = F.lit(True)
    if least is not None:
        c = c & (hi >= least)
    if most is not None:
        c = c & (lo <= most)
    return c


@dataclass
class SearchParams:
    q: str | None = None
    source: str | None = None
    canton: str | None = None
    language: str | None = None
    seniority: str | None = None
    contract_type: str | None = None
    is_remote: bool | None = None
    salary_min: int | None = None
    salary_max: int | None = None
    sort: str = "newest"
    limit: int = 20
    offset: int = 0
    columns: list[str] = field(default_factory=lambda: ["hash", "title", "company", "source", "location", "canton", "salary_min_chf", "salary_max_chf", "last_seen_at"])

    def __post_init__(self):
        if not 1 <= self.limit <= 100 or self.offset < 0:
            raise ValueError("limit must be 1 to 100, offset at least 0")

    def predicate(self) -> Column:
        c = visible() & not_student()
        if self.q:
            c = c & contains_all(search_tokens(F.col("title"), F.col("description"), F.col("company")), self.q)
        for name, values in (("source", csv_values(self.source)), ("canton", csv_values(self.canton, True))):
            if values:
                c = c & F.col(name).isin(values)
        for name in ("language", "seniority", "contract_type"):
            if getattr(self, name) is not None:
                c = c & (F.col(name) == getattr(self, name))
        if self.is_remote is not None:
            c = c & (F.col("remote") == self.is_remote)
        return c & pay_overlap(F.col("salary_min_chf"), F.col("salary_max_chf"), self.salary_min, self.salary_max)

    def order(self) -> list[Column]:
        if self.sort == "oldest":
            return [F.asc("first_seen_at"), F.asc("hash")]
        if self.sort == "salary":
            return [F.desc_nulls_last("salary_max_chf"), F.asc("hash")]
        if self.sort == "relevance" and self.q:
            rank = term_rank(search_tokens(F.col("title")), F.split(F.lower(F.concat_ws(" ", "title", "description", "company")), r"(?U)[^\w]+"), self.q)
            return [rank.desc(), F.asc("hash")]
        return [F.desc("last_seen_at"), F.asc("hash")]


def search(jobs: DataFrame, p: SearchParams) -> tuple[DataFrame, DataFrame]:
    """(the page, one row with the total and whether more follows). The primary key ends every order."""
    hits = jobs.where(p.predicate())
    page = hits.orderBy(*p.order()).offset(p.offset).limit(p.limit).select(*p.columns)
    total = hits.agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.lit(p.offset + p.limit) < F.col("total"))
    return page, total


def page_of(df: DataFrame, where: Column, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Filtered, ordered rows offset..offset+limit; plans as take-ordered, no full sort."""
    return df.where(where).orderBy(*order).offset(offset).limit(limit)


def term_rank(title_words: Column, all_words: Column, query: str) -> Column:
    """Own rank: occurrences of the query's words over 1 + ln(length), plus one for each word in the title."""
    words = [w for w in dict.fromkeys(query.lower().split()) if w]
    asked = F.array(*[F.lit(w) for w in words])
    hits = F.size(F.filter(all_words, lambda x: F.array_contains(asked, x)))
    return hits / (1 + F.log(F.size(all_words) + 1)) + F.size(F.array_intersect(title_words, asked))


def facets(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, n) for each dimension from one scan: grouping sets fuse what
    would be a query each. Null values are dropped."""
    sets = [[d] for d in dims]
    grouped = df.groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    full = (1 << len(dims)) - 1
    which = F.coalesce(*[F.when(F.col("_g") == full - (1 << (len(dims) - 1 - i)), F.lit(d)) for i, d in enumerate(dims)])
    value = F.coalesce(*[F.when(F.col("_g") == full - (1 << (len(dims) - 1 - i)), F.col(d).cast("string")) for i, d in enumerate(dims)])
    return grouped.select(which.alias("dim"), value.alias("value"), "n").where("value IS NOT NULL")


def numeric_stats(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Least lo, largest hi, mean hi over rows that have hi; all null when there is no lo."""
    one = df.where(F.col(hi).isNotNull()).agg(F.min(lo).alias("min"), F.max(hi).alias("max"), F.avg(hi).alias("avg"))
    has = F.col("min").isNotNull()
    return one.select(*[F.when(has, F.round(c, 2) if c == "avg" else F.col(c)).alias(c) for c in ("min", "max", "avg")])


def source_summary(df: DataFrame, source: str, seen: str) -> DataFrame:
    return df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.max(seen).alias("last_seen"))


def token_table(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Inverted index rows (token, key, tf), for stores searched often."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), r"(?U)[^\w]+"), lambda t: t != "")
    return df.select(F.col(key), F.explode(words).alias("token")).groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"))


def search_index(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys that hold every word of the query, with their summed tf, from token_table rows."""
    import re

    words = [w for w in dict.fromkeys(re.split(r"\W+", query.lower())) if w]
    hits = index.where(F.col("token").isin(words)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum("tf").alias("tf"))
    return hits.where(F.col("_n") == len(words)).drop("_n")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group; Spark keeps n rows a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def batched(df: DataFrame, order: list[Column], size: int, group: list[str]) -> DataFrame:
    """Batch number and place in the batch, by group."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("_at", at).withColumns({"batch": F.floor(F.col("_at") / size).cast("int"), "idx": (F.col("_at") % size).cast("int")}).drop("_at")
