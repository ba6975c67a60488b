"""Every registered query of the engine, with the SQL that it must equal.

The clock is never read: queries that need a present moment take NOW.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enrich as E
from ..functions import score as S
from ..functions import text as X
from ..operators import dedup, fulltext, lifecycle, matching, merge, models, patterns, search, views, watchlist
from ..sources import readers, sinks
from ..storage import shared_dir
from ..streaming import incremental
from . import pipelines
from .registry import EVENT_NOW, QUERIES, SQL
from .registry import events as _events
from .registry import moment as _now
from .registry import query as _query
from .registry import read as _read

def _words(c):
    return F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda t: t != "")


_WORD_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"


# --- search and statistics ---------------------------------------------------


@_query("""
WITH h AS (SELECT * FROM documents WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2', 'src3') AND n_chars >= 200 AND n_chars <= 9000)
SELECT doc_id, lang, source, n_chars, 60 < (SELECT count(*) FROM h) AS has_more
FROM h ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 10
""")
def search_filters_page(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    where = F.col("lang").isin(search.csv_values("en, de")) & F.col("source").isin(search.csv_values("src0,src1, src2,,src3"))
    where = where & search.pay_overlap(F.col("n_chars"), F.col("n_chars"), 200, 9000)
    total = docs.where(where).agg((F.lit(60) < F.count(F.lit(1))).alias("has_more"))
    return search.page_of(docs, where, [F.desc("n_chars"), F.asc("doc_id")], 50, 10).crossJoin(F.broadcast(total))


@_query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS pay FROM customer
WHERE c_mktsegment = 'BUILDING' ORDER BY pay DESC NULLS LAST, c_custkey LIMIT 100
""")
def search_salary_nulls_last(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").withColumn("pay", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return search.page_of(c, F.col("c_mktsegment") == "BUILDING", [F.desc_nulls_last("pay"), F.asc("c_custkey")], 100).select("c_custkey", "pay")


def _text_index(spark, sf_dir) -> fulltext.TextIndex:
    """The stored index of the documents' texts; the first query makes it."""
    return fulltext.index_of(spark, shared_dir(spark), _read(spark, sf_dir, "documents"), "doc_id", "text")


@_query(rf"SELECT doc_id FROM documents WHERE list_has_all({_WORD_SQL}, ['the', 'of', 'and'])")
def fulltext_conjunctive(spark, sf_dir):
    return _text_index(spark, sf_dir).containing("The of AND").select(F.col("id").alias("doc_id"))


@_query(rf"""
WITH t AS (SELECT doc_id, {_WORD_SQL} AS w FROM documents)
SELECT doc_id, round(len(list_filter(w, lambda x: x = 'the' OR x = 'der')) / (1 + ln(len(w) + 1)), 6) AS rank
FROM t ORDER BY rank DESC, doc_id LIMIT 50
""")
def fulltext_ranked(spark, sf_dir):
    return _text_index(spark, sf_dir).ranked("the der", 50).select(F.col("id").alias("doc_id"), "rank")


@_query(rf"""
WITH t AS (SELECT doc_id, unnest({_WORD_SQL}) AS token FROM documents),
i AS (SELECT token, doc_id, count(*) AS tf FROM t WHERE token IN ('la', 'de') GROUP BY ALL)
SELECT doc_id, sum(tf)::BIGINT AS tf FROM i GROUP BY doc_id HAVING count(*) = 2
""")
def fulltext_index(spark, sf_dir):
    index = search.token_table(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return search.search_index(index, "doc_id", "la de")


@_query("""
SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source
""")
def facet_counts(spark, sf_dir):
    return search.facets(_read(spark, sf_dir, "documents"), ["lang", "source"])


@_query("SELECT min(p_size) AS min, max(p_retailprice) AS max, round(avg(p_retailprice), 2) AS avg FROM part WHERE p_retailprice IS NOT NULL")
def numeric_stats(spark, sf_dir):
    return search.numeric_stats(_read(spark, sf_dir, "part"), "p_size", "p_retailprice")


@_query("SELECT event_type AS source, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY event_type")
def source_summary(spark, sf_dir):
    return search.source_summary(_events(spark, sf_dir), "event_type", "ts").withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@_query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL
""")
def volume_summary(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")
    )


# --- applications ------------------------------------------------------------


@_query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    return lifecycle.status_counts(_read(spark, sf_dir, "orders"), "o_orderstatus")


@_query("""
WITH o AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS s, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS a,
  count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS i, count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS f FROM orders)
SELECT total, round((total - s) / total, 3) AS application_rate, round((i + f) / a, 3) AS interview_rate, round(f / i, 3) AS offer_rate FROM o
""")
def status_funnel(spark, sf_dir):
    return lifecycle.funnel(_read(spark, sf_dir, "orders"), "o_orderpriority", "5-LOW", "1-URGENT", "2-HIGH", "3-MEDIUM")


@_query("SELECT o_orderkey, o_orderstatus, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def applications_left_join(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return _read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderstatus", "c_name", "c_mktsegment")


@_query("SELECT c_mktsegment AS source, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def status_by_source(spark, sf_dir):
    j = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("source"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_excluded(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return _read(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@_query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_retained(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return _read(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


_RETENTION_SQL = """
WITH s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40),
p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45),
c AS (SELECT o_orderkey, CASE WHEN p.k IS NOT NULL THEN 'pipeline' WHEN s.k IS NOT NULL THEN 'saved' ELSE 'normal' END AS kind,
  epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate) AS age FROM orders LEFT JOIN s ON s.k = o_orderkey LEFT JOIN p ON p.k = o_orderkey)
SELECT kind, age > 86400 * (CASE kind WHEN 'pipeline' THEN 180 WHEN 'saved' THEN 90 ELSE 60 END) AS expired, count(*) AS n FROM c GROUP BY ALL
"""


@_query(_RETENTION_SQL)
def retention_classes(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").withColumn("seen", F.col("o_orderdate").cast("timestamp"))
    items = _read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    saved, pipeline = items.where("l_returnflag = 'R' AND l_quantity > 40"), items.where("l_returnflag = 'A' AND l_quantity > 45")
    return merge.retention(orders, saved, pipeline, "o_orderkey", "seen", _now()).groupBy("kind", "expired").agg(F.count(F.lit(1)).alias("n"))


# --- hashes and duplicates ---------------------------------------------------


@_query("SELECT p_partkey, md5(lower(trim(p_name)) || '|' || lower(trim(p_brand)) || '|' || trim(p_type)) AS hash FROM part")
def identity_hash(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", X.identity_hash(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("hash"))


_LITERALS = r"\(all genders\)|\(m/f/d\)|\(m/w/d\)|\(f/m/d\)|\(w/m/d\)|\(m/f/x\)|\(w/m/x\)|trainee|senior|junior|intern|m/f/d|m/w/d|f/m/d|w/m/d|lead|head|sr\.|jr\.|sr|jr"


@_query(rf"""
SELECT p_partkey, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower('Senior ' || p_name || ' (m/w/d) ' || p_type), '{_LITERALS}', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))
  || '|' || array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_brand || ' AG'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('ag', 'gmbh', 'sa') AND w <> ''), ' ')) AS fuzzy
FROM part
""")
def fuzzy_hash(spark, sf_dir):
    title = F.concat(F.lit("Senior "), "p_name", F.lit(" (m/w/d) "), "p_type")
    return _read(spark, sf_dir, "part").select("p_partkey", X.fuzzy_hash(title, F.concat("p_brand", F.lit(" AG"))).alias("fuzzy"))


@_query("""
WITH f AS (SELECT doc_id, source, first_value(source) OVER w AS s, first_value(doc_id) OVER w AS i FROM documents
  WINDOW w AS (PARTITION BY lower(trim(text)) ORDER BY doc_id))
SELECT doc_id, CASE WHEN s <> source THEN i END::VARCHAR AS duplicate_of FROM f
""")
def fuzzy_dedup(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.lower(F.trim("text"))).alias("key"))
    return dedup.fuzzy_duplicates(docs, "key", "source", [F.col("doc_id")], "doc_id").select("doc_id", F.col("duplicate_of").cast("string").alias("duplicate_of"))


@_query("""
SELECT b.vec_id, min(a.vec_id) AS duplicate_of FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4 GROUP BY b.vec_id
""")
def semantic_dedup(spark, sf_dir):
    return dedup.semantic_duplicates(_read(spark, sf_dir, "embeddings"), 0.4, "vec_id", "embedding", "vec_id")


@_query("""
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cosine
FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 20
""")
def vector_topk(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    probe = vectors.where("vec_id = 0").select("embedding").first()[0]
    return matching.nearest(vectors, probe, "vec_id", "embedding", 20)


# --- matching ----------------------------------------------------------------


def _postings(spark, sf_dir) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings")
    c = F.col
    return v.select(
        c("vec_id").cast("string").alias("hash"), "embedding", (60000 + c("label") * 8000).alias("salary_min_chf"), F.when(c("label") % 3 != 0, 70000 + c("label") * 9000).alias("salary_max_chf"),
        F.when(c("label") != 7, F.concat(F.lit("Loc"), c("label"), F.lit(", Land"))).alias("location"),
        (F.unix_timestamp(_now()) - (c("vec_id") % 40) * 86400).cast("timestamp").alias("first_seen_at"),
        F.when(c("label") == 9, None).when(c("label") % 2 == 0, "en").otherwise("de").alias("language"), F.array(F.concat(F.lit("T"), c("label")), F.lit("crm")).alias("tags"),
    )


_MATCH_SQL = """
WITH p AS (SELECT embedding::DOUBLE[] AS pe FROM embeddings WHERE vec_id = 0),
j AS (SELECT vec_id, label, greatest(0, list_cosine_similarity(embedding::DOUBLE[], pe)) AS e,
  (60000 + label * 8000 + CASE WHEN label % 3 <> 0 THEN 70000 + label * 9000 ELSE 60000 + label * 8000 END) / 2 / 90000 AS r, vec_id % 40 AS d FROM embeddings, p),
f AS (SELECT vec_id, label, e, CASE WHEN r >= 1 THEN 1 WHEN r >= 0.8 THEN 0.5::DOUBLE + (r - 0.8::DOUBLE) * 2.5::DOUBLE ELSE r / 0.8::DOUBLE * 0.5::DOUBLE END AS s,
  CASE WHEN label = 7 THEN 0.3 WHEN label IN (3, 5) THEN 1 ELSE 0 END::DOUBLE AS l,
  CASE WHEN d <= 1 THEN 1 WHEN d <= 7 THEN 0.8 WHEN d <= 14 THEN 0.5 WHEN d <= 30 THEN 0.3 ELSE 0.1 END::DOUBLE AS n,
  CASE WHEN label = 9 THEN 0.5 WHEN label % 2 = 0 THEN 1 ELSE 0.2 END::DOUBLE AS g FROM j)
SELECT vec_id::VARCHAR AS hash, round_even((0.35::DOUBLE * e + 0.15::DOUBLE * s + 0.1::DOUBLE * l + 0.15::DOUBLE * n + 0.1::DOUBLE * g) * 100, 1) AS score_final,
  CASE WHEN label = 4 THEN 'crm,t4' ELSE 'crm' END AS matching_skills, CASE WHEN label = 4 THEN '' ELSE 't' || label END AS missing_skills
FROM f WHERE round_even((0.35::DOUBLE * e + 0.15::DOUBLE * s + 0.1::DOUBLE * l + 0.15::DOUBLE * n + 0.1::DOUBLE * g) * 100, 1) >= 35
"""


@_query(_MATCH_SQL)
def match_score(spark, sf_dir):
    profile = _read(spark, sf_dir, "embeddings").where("vec_id = 0").select(
        F.lit("u").alias("user_id"), F.col("embedding").alias("cv_embedding"), F.lit(80000).alias("salary_min"), F.lit(100000).alias("salary_max"),
        F.array(F.lit("loc3"), F.lit("LOC5")).alias("locations"), F.array(F.lit("English")).alias("languages"), F.array(F.lit("CRM"), F.lit("t4")).alias("skills"),
        F.lit(None).cast("map<string,double>").alias("score_weights"),
    )
    found = matching.score_matches(_postings(spark, sf_dir), profile, _now())
    return found.select("hash", "score_final", F.array_join("matching_skills", ",").alias("matching_skills"), F.array_join("missing_skills", ",").alias("missing_skills"))


@_query(r"""
WITH d AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'A' WHEN source IN ('src3', 'src4') THEN 'B' WHEN source = 'src5' THEN 'C' END AS tier, doc_id % 10 AS days,
  text || CASE WHEN doc_id % 3 = 0 THEN ' URGENT.' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' deadline: 2024-01-31' ELSE '' END AS body, doc_id % 4 = 0 AS portal FROM documents)
SELECT doc_id, CASE WHEN tier IS NULL THEN 0 ELSE greatest(0, least(100,
  CASE tier WHEN 'A' THEN 30 WHEN 'B' THEN 15 ELSE 0 END + CASE WHEN days < 2 THEN 15 WHEN days < 7 THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(body, '(?i)(^|[^\p{L}\p{N}_])(immediate|immediately|as soon as possible|asap|urgent|sofort|umgehend|dès que possible|au plus vite)([^\p{L}\p{N}_]|$)') THEN 20 ELSE 0 END
  + CASE WHEN regexp_matches(body, '(?i)(?:deadline|apply by|closing date|closes on|frist|date limite|terme)[^\d]{0,15}(\d{1,2}[./ -]\d{1,2}[./ -]\d{2,4}|\d{4}-\d{2}-\d{2})') THEN 10 ELSE 0 END
  - CASE WHEN portal THEN 10 ELSE 0 END)) END AS urgency FROM d
""")
def urgency_score(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    s, i = F.col("source"), F.col("doc_id")
    tier = F.when(s.isin("src1", "src2"), "A").when(s.isin("src3", "src4"), "B").when(s == "src5", "C")
    body = F.concat("text", F.when(i % 3 == 0, " URGENT.").otherwise(""), F.when(i % 5 == 0, " deadline: 2024-01-31").otherwise(""))
    return d.select("doc_id", S.urgency(tier, i % 10, body, F.when(i % 4 == 0, "portal_only")).alias("urgency"))


CATEGORY_RULES = {"A": ["nicht", "worthless"], "H": ["les", "pour la"], "K": ["the", "of"], "M": ["ción"]}
_W = r"[^\p{L}\p{N}_]"
_CATEGORY_CASE = " ".join(f"WHEN regexp_matches(t, '(?i)(^|{_W})({'|'.join(v)})({_W}|$)') THEN '{k}'" for k, v in CATEGORY_RULES.items())


@_query(rf"""
WITH d AS (SELECT doc_id, regexp_replace(text || ' ' || source, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g') AS t FROM documents),
c AS (SELECT doc_id, CASE {_CATEGORY_CASE} ELSE 'otros' END AS category FROM d)
SELECT doc_id, category, CASE category WHEN 'A' THEN 1.0 WHEN 'H' THEN 0.15 WHEN 'K' THEN 0.2 WHEN 'M' THEN 0.1 ELSE 0.55 END::DOUBLE AS times FROM c
""")
def category_rules(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").withColumn("category", E.category(F.col("text"), F.array("source"), CATEGORY_RULES))
    return d.select("doc_id", "category", E.category_times(F.col("category")).alias("times"))


TERMS = ["there", "ing", "ment", "schaft", "that", "ión", "heit", "der ", "ould", "pour"]


@_query(f"SELECT doc_id, array_to_string(list_filter({TERMS!r}, lambda t: contains(lower(text), t))[:4], '|') AS skills FROM documents")
def skill_extract(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.dictionary_terms(F.col("text"), TERMS, 4), "|").alias("skills"))


@_query("""
WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(['ring', 'small', 'widget'], lambda x: list_contains(w, x))), ',') AS matching,
  array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x NOT IN ('ring', 'small', 'widget')))), ',') AS missing FROM p
""")
def skill_overlap(spark, sf_dir):
    own = F.split(F.lower("p_name"), " ")
    asked = F.array(F.lit("ring"), F.lit("small"), F.lit("widget"))
    return _read(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(F.array_sort(F.array_intersect(asked, own)), ",").alias("matching"), F.array_join(F.array_sort(F.array_except(own, asked)), ",").alias("missing")
    )


# --- pages and payloads ------------------------------------------------------


@_query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_strip(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_html(F.col("html"))).alias("text_md5"))


@_query("""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS n_links, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages""")
def page_links(spark, sf_dir):
    return readers.links(_read(spark, sf_dir, "pages"))


@_query(r"""
WITH m AS (SELECT page_id, regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1) AS f FROM pages)
SELECT page_id, unnest(range(len(f)))::INTEGER AS pos, NULL::VARCHAR AS url, '' AS title, trim(regexp_replace(unnest(f), '\s+', ' ', 'g')) AS text FROM m
""")
def page_cards(spark, sf_dir):
    return readers.html_cards(_read(spark, sf_dir, "pages"), "ad").select("page_id", "pos", "url", "title", F.array_join(F.map_values("fields"), " ").alias("text"))


@_query("""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN floor((p_size + 40) * 1000 * 0.96::DOUBLE) WHEN 1 THEN floor(p_size * 100 * 0.88::DOUBLE * 12) WHEN 2 THEN floor((p_size + 10) * 1.12::DOUBLE * 2080)
    WHEN 3 THEN (p_size + 30) * 1000 WHEN 4 THEN NULL ELSE (p_size + 20) * 1000 END::INTEGER::VARCHAR AS lo,
  CASE p_size % 6 WHEN 0 THEN floor((p_size + 60) * 1000 * 0.96::DOUBLE) WHEN 1 THEN floor(p_size * 100 * 0.88::DOUBLE * 12) WHEN 2 THEN floor((p_size + 10) * 1.12::DOUBLE * 2080)
    WHEN 3 THEN (p_size + 45) * 1000 WHEN 4 THEN NULL ELSE (p_size + 35) * 1000 END::INTEGER::VARCHAR AS hi,
  CASE p_size % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CHF' END AS currency FROM part
""")
def salary_parse(spark, sf_dir):
    n = F.col("p_size")
    text = (
        F.when(n % 6 == 0, F.format_string("%d000-%d000 EUR", n + 40, n + 60)).when(n % 6 == 1, F.format_string("%d USD", n * 100)).when(n % 6 == 2, F.format_string("gbp %d an hour", n + 10))
        .when(n % 6 == 3, F.format_string("%dk - %dk CHF", n + 30, n + 45)).when(n % 6 == 4, "nach Vereinbarung").otherwise(F.format_string("%d to %dk", n + 20, n + 35))
    )
    period = E.valid_period(F.when(n % 6 == 1, "per_month").when(n % 6 == 2, "Hour").when(n % 6 == 3, "fortnight").otherwise("annual"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", E.parse_pay(text).alias("p"), period.alias("period"))
    pay = lambda c: E.annual_chf(F.col(f"p.{c}"), F.col("p.currency"), F.col("period"))
    return rows.select("p_partkey", pay("lo").cast("string").alias("lo"), pay("hi").cast("string").alias("hi"), F.col("p.currency").alias("currency"))


_LEVELS = [
    ("Head of Sales", None, None), ("Senior Editor 80%", None, None), ("Praktikum Marketing", None, "internship"), ("International Lead", None, None),
    ("Teilzeit Gärtner", None, "no such kind"), ("Koch", "director", "temporary"), ("Koch", "no such level", None), ("Stage en édition, CDD", None, None),
]


@_query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'head' WHEN 1 THEN 'senior' WHEN 2 THEN 'intern' WHEN 3 THEN 'lead' WHEN 5 THEN 'director' WHEN 7 THEN 'intern' END AS seniority,
  CASE p_partkey % 8 WHEN 1 THEN 'part_time' WHEN 2 THEN 'internship' WHEN 4 THEN 'part_time' WHEN 5 THEN 'temporary' WHEN 7 THEN 'internship' END AS contract FROM part
""")
def level_and_contract(spark, sf_dir):
    rows = F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip("tlk", r)]) for r in _LEVELS])
    p = _read(spark, sf_dir, "part").select("p_partkey", rows[(F.col("p_partkey") % 8).cast("int")].alias("r"))
    none, title = F.lit(None).cast("string"), F.concat("r.t", F.lit(" x"), "p_partkey")
    level, kind = E.valid_or_null(F.col("r.l"), E.SENIORITY_VALID), E.valid_or_null(F.col("r.k"), E.CONTRACT_VALID)
    return p.select("p_partkey", E.seniority(level, title).alias("seniority"), E.contract_type(kind, none, title, none).alias("contract"))


@_query(r"""
SELECT event_type, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS parsed,
  sum(try_cast(nullif(regexp_extract(substr(props, 1, length(props) - 1), '"k":\s*(\d+)', 1), '') AS BIGINT))::BIGINT AS salvaged FROM events GROUP BY event_type
""")
def json_salvage(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    whole = F.from_json("props", "k bigint")["k"]
    cut = F.nullif(F.regexp_extract(F.substring(F.col("props"), F.lit(1), F.length("props") - 1), r'"k":\s*(\d+)', 1), F.lit("")).try_cast("bigint")
    return e.groupBy("event_type").agg(F.sum(whole).alias("parsed"), F.sum(cut).alias("salvaged"))


# --- rejection patterns ------------------------------------------------------


def _labelled(spark, sf_dir) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("rejected"))
    return _read(spark, sf_dir, "documents").join(labels, "doc_id")


_STOPS = ", ".join(repr(w) for w in dict.fromkeys(X.STOP_WORDS))
_RATED_SQL = """SELECT pattern, rejected, total, round(rejected / total, 6) AS rate, round(least(1, 0.7::DOUBLE * (rejected / total) + 0.3::DOUBLE * least(rejected, 10) / 10), 6) AS confidence
FROM c WHERE rejected >= {least} AND rejected / total >= 0.55"""


@_query(
    rf"""
WITH t AS (SELECT quality = 0 AS r, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(text), '\(.*?\)', '', 'g'), '\d+[-–]\d+\s*%?', '', 'g'), '\d+\s*%', '', 'g'),
  '[\s/,\-|.]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOPS})) AS w FROM documents JOIN labels USING (doc_id)),
g AS (SELECT r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS pattern FROM t),
c AS (SELECT pattern, sum(r::INTEGER)::BIGINT AS rejected, count(*) AS total FROM g GROUP BY pattern)
"""
    + _RATED_SQL.format(least=2)
)
def ngram_rejection(spark, sf_dir):
    counts = patterns.ngram_counts(_labelled(spark, sf_dir), "text", "rejected")
    return patterns.rated(counts).withColumns({"rate": F.round("rate", 6), "confidence": F.round("confidence", 6)})


@_query(
    """
WITH g AS (SELECT quality = 0 AS r, unnest([lang, source]) AS pattern FROM documents JOIN labels USING (doc_id)),
c AS (SELECT pattern, sum(r::INTEGER)::BIGINT AS rejected, count(*) AS total FROM g GROUP BY pattern)
"""
    + _RATED_SQL.format(least=2).replace("0.55", "0.05")
)
def tag_rejection(spark, sf_dir):
    counts = patterns.tag_counts(_labelled(spark, sf_dir).withColumn("tags", F.array("lang", "source")), "tags", "rejected")
    return patterns.rated(counts, 2, 0.05).withColumns({"rate": F.round("rate", 6), "confidence": F.round("confidence", 6)})


@_query("SELECT p_partkey FROM part WHERE NOT contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'red') AND p_type <> 'ECONOMY'")
def user_title_filters(spark, sf_dir):
    rows = [("title_contains", "RING", True), ("title_contains", "red", True), ("tag_contains", "ECONOMY", True), ("title_contains", "widget", False)]
    filters = spark.createDataFrame(rows, "filter_type string, pattern string, is_active boolean")
    part = _read(spark, sf_dir, "part").withColumn("tags", F.array("p_type"))
    return matching.without_user_filters(part, filters, "p_name").select("p_partkey")


# --- merges and events -------------------------------------------------------


@_query("""
WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0)
SELECT o.o_orderkey, o.o_totalprice, CASE WHEN n.o_orderkey IS NULL THEN '1998-01-01' ELSE '2001-08-01' END AS last_seen, n.o_orderkey IS NOT NULL OR o.o_orderstatus <> 'F' AS is_active
FROM o LEFT JOIN n USING (o_orderkey)
UNION ALL SELECT o_orderkey, o_totalprice + 1, '2001-08-01', true FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
""")
def upsert_merge(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    old = orders.where("day < '1998-01-01'").select("o_orderkey", "o_totalprice", _now("1998-01-01").alias("last_seen_at"), (F.col("o_orderstatus") != "F").alias("is_active"))
    new = orders.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), _now().alias("last_seen_at"), F.lit(True).alias("is_active"))
    out = merge.upsert(old, new, "o_orderkey", _now())
    return out.select("o_orderkey", "o_totalprice", F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"), "is_active")


@_query("""
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS s, o_orderpriority = '1-URGENT' AS engaged FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_orderkey AS k, o_totalprice + 5 AS s FROM orders WHERE o_orderkey % 3 = 0)
SELECT o.k AS job_hash, coalesce(n.s, o.s) AS score_final, engaged FROM o LEFT JOIN n USING (k) WHERE n.k IS NOT NULL OR engaged
UNION ALL SELECT k, s, false FROM n WHERE k NOT IN (SELECT k FROM o)
""")
def result_merge(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    feedback = F.when(F.col("o_orderpriority") == "1-URGENT", "thumbs_up")
    cols = ["job_hash", "score_final", "feedback", "application_status", "draft_letter"]
    old = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", feedback, F.lit("detected"), none).toDF(*cols)
    new = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_totalprice") + 5, none, none, none).toDF(*cols)
    out = merge.merge_results(old, new, ["job_hash"], ["score_final"])
    return out.select("job_hash", "score_final", F.col("feedback").isNotNull().alias("engaged"))


@_query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS feedback, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS feedback_at FROM events GROUP BY user_id")
def latest_feedback(spark, sf_dir):
    out = merge.latest_feedback(_events(spark, sf_dir), ["user_id"], "event_type", "ts", "event_id")
    return out.withColumn("feedback_at", F.date_format("feedback_at", "yyyy-MM-dd HH:mm:ss"))


@_query("SELECT user_id, string_agg(event_type || ':' || event_id, ',' ORDER BY ts, event_id) AS signals FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def implicit_array(spark, sf_dir):
    e = _events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    out = merge.implicit_signals(e, ["user_id"], "event_type", "event_id", "ts", "event_id")
    return out.select("user_id", F.array_join(F.transform("signals", lambda x: F.concat(x["action"], F.lit(":"), x["value"])), ",").alias("signals"))


@_query("""
SELECT event_id, count(*) OVER w - 1 AS n_before, count(*) OVER w - 1 < 3 AS allowed FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)
""")
def push_cap_24h(spark, sf_dir):
    return lifecycle.rolling_cap(_events(spark, sf_dir), "user_id", "ts", 24, 3).select("event_id", "n_before", "allowed")


@_query("""
SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10
""")
def bounded_queue(spark, sf_dir):
    return sinks.bounded_queue(_events(spark, sf_dir), "user_id", "ts", "event_id", 10).select("event_id", "user_id")


@_query("""
SELECT o_custkey, o_orderkey, c_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders WHERE o_totalprice >= 40000 AND o_totalprice < 300000) JOIN customer ON o_custkey = c_custkey WHERE rank <= 5
""")
def digest_topn(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").where("o_totalprice >= 40000 AND o_totalprice < 300000")
    top = search.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
    return top.join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", "c_name", "rank")


def _per_day(spark, sf_dir) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("value") > 60, 1)).alias("n"))


@_query("""
WITH d AS (SELECT event_type, ts::DATE AS day, count(*) FILTER (WHERE value > 60)::DOUBLE AS n FROM events GROUP BY ALL),
l AS (SELECT event_type, list(n ORDER BY day) AS a FROM d GROUP BY event_type)
SELECT event_type, list_reduce([0::DOUBLE] || a, lambda s, x: printf('%.2f', 0.7::DOUBLE * s + 0.3::DOUBLE * x)::DOUBLE) AS ema FROM l
""")
def ema_runs(spark, sf_dir):
    return lifecycle.ema(_per_day(spark, sf_dir), ["event_type"], ["day"], "n")


@_query("""
WITH d AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (WHERE value > 60) AS n FROM events GROUP BY ALL)
SELECT user_id, count(*) FILTER (WHERE day > coalesce((SELECT max(day) FROM d x WHERE x.user_id = d.user_id AND x.n > 0), DATE '1900-01-01')) AS streak FROM d GROUP BY user_id
""")
def empty_streaks(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("value") > 60, 1)).alias("n"))
    return lifecycle.empty_streak(e, ["user_id"], ["day"], "n")


@_query("""
WITH p AS (SELECT event_type, event_id // 20 AS page, bool_and(value > 5) AS known FROM events GROUP BY ALL),
f AS (SELECT event_type, min(page) FILTER (WHERE known) AS stop FROM p GROUP BY event_type)
SELECT event_type, page, known AS all_known FROM p JOIN f USING (event_type) WHERE stop IS NULL OR page <= stop
""")
def early_stop_pages(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_type", F.expr("event_id div 20").alias("page"), (F.col("value") > 5).alias("known"))
    return lifecycle.pages_until_known(e, "event_type", "page", "known")


@_query("""
WITH i AS (SELECT event_type, user_id, min(event_id) AS p FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, user_id) AS n FROM i)
SELECT event_type, string_agg(user_id::VARCHAR, ',' ORDER BY n) AS recent FROM r WHERE n <= 30 GROUP BY event_type
""")
def cursor_window(spark, sf_dir):
    out = lifecycle.recent_identities(_read(spark, sf_dir, "events"), ["event_type"], "user_id", "event_id", 30)
    return out.select("event_type", F.array_join(F.transform("recent", lambda x: x.cast("string")), ",").alias("recent"))


@_query("""
WITH g AS (SELECT user_id, event_id, ts, event_type = 'error' AS b, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
c AS (SELECT *, sum(b::INTEGER) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM g)
SELECT user_id, arg_max(c, (ts, event_id))::BIGINT AS consecutive_blocks, max(c) >= 3 AND user_id % 2 = 0 AS auto_disabled FROM c GROUP BY user_id
""")
def block_counters(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("blocked", F.col("event_type") == "error")
    return lifecycle.block_counters(e.withColumn("may", F.col("user_id") % 2 == 0), "user_id", ["ts", "event_id"], "blocked", may_disable="may")


@_query("""
WITH r AS (SELECT s_suppkey AS k, s_acctbal > 0 AS ok FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT n_nationkey AS source_key, coalesce(ok, false) AS allowed FROM nation LEFT JOIN r ON k = n_nationkey
""")
def compliance_gate(spark, sf_dir):
    rules = _read(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("source_key"), (F.col("s_acctbal") > 0).alias("is_allowed"), F.lit(True).alias("robots_txt_ok"))
    return lifecycle.compliance(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source_key")), rules)


_HEALTH_SQL = """
WITH e AS (SELECT user_id AS k, max(ts) FILTER (WHERE event_type = 'error') AS bad, max(ts) FILTER (WHERE event_type = 'purchase') AS good,
  count(*) FILTER (WHERE event_type = 'error') % 4 AS blocks FROM events GROUP BY user_id),
s AS (SELECT c_custkey AS k, e.k IS NOT NULL AS has_row, c_custkey % 7 = 0 AS off, blocks, bad, good FROM customer LEFT JOIN e ON e.k = c_custkey),
x AS (SELECT *, has_row AND NOT off AS live, epoch(TIMESTAMP '2024-01-31') AS now FROM s)
SELECT k AS source_key, 'no_row' AS issue FROM x WHERE NOT has_row UNION ALL SELECT k, 'disabled' FROM x WHERE has_row AND off
UNION ALL SELECT k, 'blocks' FROM x WHERE live AND blocks > 0 UNION ALL SELECT k, 'recently_blocked' FROM x WHERE live AND now - floor(epoch(bad)) <= 86400
UNION ALL SELECT k, 'never_succeeded' FROM x WHERE live AND good IS NULL UNION ALL SELECT k, 'silent' FROM x WHERE live AND now - floor(epoch(good)) > 86400
"""


@_query(_HEALTH_SQL)
def health_issues(spark, sf_dir):
    kind = F.col("event_type")
    e = _events(spark, sf_dir).groupBy(F.col("user_id").alias("source_key")).agg(
        F.max(F.when(kind == "error", F.col("ts"))).alias("last_blocked_at"), F.max(F.when(kind == "purchase", F.col("ts"))).alias("last_success_at"),
        (F.count(F.when(kind == "error", 1)) % 4).alias("consecutive_blocks"), F.lit(True).alias("_row"),
    )
    sources = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_key")).join(e, "source_key", "left")
    sources = sources.withColumns({"has_row": F.coalesce("_row", F.lit(False)), "auto_disabled": F.col("source_key") % 7 == 0})
    return lifecycle.health_issues(sources, _now(EVENT_NOW))


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN true WHEN o_orderkey % 4 = 0 THEN o_orderkey % 11 >= 5 WHEN o_orderkey % 4 = 1 THEN o_orderkey % 2900 >= 1440
  WHEN o_orderkey % 4 = 2 THEN o_orderkey % 20000 >= 10080 ELSE false END AS due FROM orders
""")
def saved_search_due(spark, sf_dir):
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "realtime").when(key % 4 == 1, "daily").when(key % 4 == 2, "weekly").when(key % 3 == 0, "instant")
    minutes = F.when(key % 4 == 0, key % 11).when(key % 4 == 1, key % 2900).when(key % 4 == 2, key % 20_000).otherwise(10**6)
    ran = F.when(key % 7 != 0, F.timestamp_seconds(F.unix_timestamp(_now()) - 60 * minutes))
    return _read(spark, sf_dir, "orders").select("o_orderkey", lifecycle.due(kind, ran, _now()).alias("due"))


@_query(f"SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE ts > TIMESTAMP '{EVENT_NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{EVENT_NOW}'")
def watermark_window(spark, sf_dir):
    fresh, _ = incremental.since(_events(spark, sf_dir), "ts", None, EVENT_NOW)
    return fresh.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@_query("""
SELECT user_id, n, least(greatest(ceil(greatest(n, 1) / 20)::INTEGER + 1, 1), 10) AS pages, n % 6 < 3 OR 5 * (user_id % 5) >= 6 * least(pow(2, n % 6 - 2), 4) AS runs
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
""")
def crawl_budget(spark, sf_dir):
    e = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    streak = F.col("n") % 6
    return e.select("user_id", "n", S.page_budget(F.col("n"), F.lit(20), F.lit(True), 10).alias("pages"), S.should_run(streak, 5 * (F.col("user_id") % 5), 6.0).alias("runs"))


@_query("""
SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), p_type) AS body,
  (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 25 AS batch, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 25 AS idx FROM part
""")
def embedding_batches(spark, sf_dir):
    p = search.batched(_read(spark, sf_dir, "part"), [F.col("p_partkey")], 25, ["p_brand"])
    body = X.posting_text(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")), F.col("p_type"), F.array().cast("array<string>"))
    return p.select("p_partkey", body.alias("body"), F.col("batch").cast("long").alias("batch"), F.col("idx").cast("long").alias("idx"))


@_query(r"""
WITH t AS (SELECT doc_id, lang, left(text, 40) AS t, (doc_id % 10) / 10.0 AS prob, CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'pt' END AS guess FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '[äöüÄÖÜß]') THEN 'de' WHEN regexp_matches(t, '[éèêëàâîïùûçœæÉÈÊÀÂÎÙÛÇ]') THEN 'fr' WHEN regexp_matches(t, '[àèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ]') THEN 'it'
  WHEN len(list_filter(regexp_split_to_array(replace(replace(t, '*', ''), '/', ' '), '\s+'), lambda w: length(w) > 12)) > 0 THEN 'de'
  WHEN lang IN ('en', 'es') THEN CASE WHEN prob >= 0.7 AND guess <> 'pt' THEN guess END WHEN prob >= 0.35 THEN guess END AS guess FROM t
""")
def title_language(spark, sf_dir):
    key = F.col("doc_id")
    guess = F.struct(F.when(key % 3 == 0, "en").when(key % 3 == 1, "es").otherwise("pt").alias("lang"), ((key % 10) / 10.0).alias("prob"))
    d = _read(spark, sf_dir, "documents").withColumn("title", F.left("text", F.lit(40)))
    return d.select("doc_id", E.title_language(F.col("title"), F.upper("lang"), guess).alias("guess"))


@_query("""
SELECT o_custkey, count(*) AS n, string_agg('- ' || o_orderpriority || ' /o/' || o_orderkey, chr(10) ORDER BY o_orderkey) AS text
FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey
""")
def user_digest(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumn("url", F.concat(F.lit("/o/"), "o_orderkey"))
    return sinks.digest(o, "o_custkey", "o_orderpriority", "url", ["o_orderkey"]).select("o_custkey", "n", "text")


# --- watch lists and saved searches ------------------------------------------


@_query("""
WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part),
d AS (SELECT split_part(p_name, ' ', 1 + p_partkey % 2) AS tag, min(p_type) AS tier FROM part WHERE p_size >= 48 GROUP BY 1)
SELECT p_partkey, arg_min(tag, pos) AS tag, arg_min(tier, pos) AS tier FROM t JOIN d USING (tag) GROUP BY p_partkey
""")
def dimension_lookup(spark, sf_dir):
    part = _read(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " "))
    dim = part.where("p_size >= 48").groupBy(F.col("tags")[(F.col("p_partkey") % 2).cast("int")].alias("tag")).agg(F.min("p_type").alias("tier"))
    return watchlist.first_dimension(part, "p_partkey", "tags", dim, "tag")


@_query("""
SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS best, count(*) FILTER (WHERE c_acctbal >= 5000) AS high,
  count(*) FILTER (WHERE starts_with(c_mktsegment, 'BUILD') AND c_acctbal + c_custkey % 30 >= 7000) AS priority FROM customer GROUP BY c_mktsegment
""")
def grouped_view(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    flag = watchlist.is_priority(F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_custkey") % 30, "BUILD", 7000.0)
    view = watchlist.grouped_view(c, "c_mktsegment", "c_acctbal", 5000.0)
    return view.join(c.groupBy("c_mktsegment").agg(F.count(F.when(flag, 1)).alias("priority")), "c_mktsegment")


# --- views, predicates and text helpers --------------------------------------


def _feedback(c):
    """Event types stand for feedback: errors are dismissals, purchases applications."""
    return F.when(c == "error", "dismissed").when(c == "purchase", "applied").when(c == "click", "thumbs_up")


_FEEDBACK_SQL = "CASE event_type WHEN 'error' THEN 'dismissed' WHEN 'purchase' THEN 'applied' WHEN 'click' THEN 'thumbs_up' END"


@_query(f"WITH f AS (SELECT event_id, {_FEEDBACK_SQL} AS feedback FROM events) SELECT event_id, feedback, coalesce(feedback, '') IN ('thumbs_up', 'applied') AS positive FROM f WHERE feedback IS NULL OR feedback NOT IN ('dismissed', 'thumbs_down')")
def feedback_filters(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", _feedback(F.col("event_type")).alias("feedback"))
    return e.where(views.not_negative(F.col("feedback"))).withColumn("positive", F.coalesce(views.positive(F.col("feedback")), F.lit(False)))


@_query(f"SELECT user_id, count(*) FILTER (WHERE {_FEEDBACK_SQL} IN ('dismissed', 'thumbs_down')) AS rejected FROM events GROUP BY user_id")
def rejected_per_user(spark, sf_dir):
    return views.rejected_count(_read(spark, sf_dir, "events"), _feedback(F.col("event_type")), ["user_id"])


@_query("SELECT o_orderkey, o_orderstatus, 'F' AS wanted FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus, 'all' FROM orders")
def optional_status(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return views.with_status(o, "F", "o_orderstatus").withColumn("wanted", F.lit("F")).unionByName(views.with_status(o, "all", "o_orderstatus").withColumn("wanted", F.lit("all")))


@_query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 't e') AND NOT contains(lower(p_brand), '#1')")
def source_query_filter(spark, sf_dir):
    return views.query_matches(_read(spark, sf_dir, "part"), "T E", ["p_name", "p_type"], ["#1"], "p_brand").select("p_partkey")


@_query("""
SELECT o_orderkey AS match_id, c_name, n_name, o_totalprice AS score_final
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey
WHERE o_totalprice >= 150000
""")
def match_cards(spark, sf_dir):
    m = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("job_hash"), F.col("o_totalprice").alias("score_final"), F.lit(0.5).alias("score_embedding"))
    j = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_hash"), "c_name", F.col("c_nationkey").alias("school_id"))
    s = _read(spark, sf_dir, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("school_id"), "n_name")
    return views.match_cards(m, j, s, 150_000.0).select("match_id", "c_name", "n_name", "score_final")


@_query("SELECT row_number() OVER (ORDER BY round(o_totalprice / 1000, 2) + CASE o_orderpriority WHEN '1-URGENT' THEN 100 ELSE 0 END DESC, o_orderkey) AS place, o_orderkey FROM orders QUALIFY place <= 200")
def urgency_order(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1000, 2).alias("score_final"), F.when(F.col("o_orderpriority") == "1-URGENT", 100.0).alias("urgency_score"))
    return views.by_urgency(o, "o_orderkey", 200).select(F.col("place").cast("long").alias("place"), "o_orderkey")


@_query("""
SELECT l_orderkey, l_linenumber, o_orderstatus, strftime(l_shipdate, '%Y-%m-%d') AS created FROM lineitem
LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 500
""")
def generated_documents(spark, sf_dir):
    d = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_hash"), "l_orderkey", "l_linenumber", "l_shipdate")
    j = _read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("job_hash"), "o_orderstatus")
    key = d.withColumn("_key", F.struct("l_orderkey", "l_linenumber"))
    return views.newest(views.documents_of(key, j), "l_shipdate", "_key").limit(500).select("l_orderkey", "l_linenumber", "o_orderstatus", F.date_format("l_shipdate", "yyyy-MM-dd").alias("created"))


@_query("SELECT c_custkey AS user_id, c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON c_custkey = o_custkey")
def users_with_profiles(spark, sf_dir):
    users = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return views.users_with_profile(users, _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n")))


@_query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'signup') AS "new", count(*) FILTER (WHERE event_type = 'view') AS updated,
  count(*) FILTER (WHERE event_type = 'click') AS duplicates, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL
""")
def run_counters(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("signup", "new", "view", "updated", "click", "duplicate", "error", "error", "purchase", "skipped")])
    e = _events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), names[F.col("event_type")].alias("outcome"))
    return views.run_counters(e, ["day"])


@_query(r"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('“' || text || '” 5€' || chr(10) || chr(10) || chr(10) || '[x=1]  Привет?', '[^\x20-\x7E\nÀ-ÿĀ-ſ]', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g') AS t FROM documents)
SELECT doc_id, md5(trim(t, ' ' || chr(10))) AS cv_md5 FROM c
""")
def cv_cleanup(spark, sf_dir):
    raw = F.concat(F.lit("“"), "text", F.lit("” 5€\n\n\n[x=1]  Привет?"))
    return _read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(X.clean_cv(raw)).alias("cv_md5"))


@_query("""
SELECT doc_id, CASE WHEN text <> '' THEN md5(CASE WHEN lang <> '' THEN lang || ' ' ELSE '' END || text || CASE WHEN doc_id % 2 = 0 THEN ' a B' ELSE '' END) END AS profile_md5,
  array_to_string(list_sort(list_distinct([source, 'b', 'a'])), '|') AS skills FROM documents
""")
def profile_text(spark, sf_dir):
    own = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("B")))
    skills = X.skill_union(F.array("source", F.lit("b")), F.array(F.lit("a"), F.lit("b")))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(X.profile_text(F.col("lang"), F.col("text"), own)).alias("profile_md5"), F.array_join(skills, "|").alias("skills"))


@_query(r"""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || ' - ' || (p_size + 20) || ' %' END AS workload, CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE trim(p_brand) END AS employer FROM part
""")
def workload_and_employer(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    size = F.col("p_size")
    title = F.concat("p_name", F.when(size % 2 == 0, F.concat(F.lit(" ("), size, F.lit(" - "), size + 20, F.lit(" %) "))).otherwise(F.lit(" (80)")))
    name = F.when(size % 3 == 0, F.concat(F.lit("1. "), "p_brand")).otherwise(F.col("p_brand"))
    html = F.concat(F.lit("<b>x</b><div> <strong> "), name, F.lit(" </strong></div><p><strong>Other name</strong>"))
    return p.select("p_partkey", X.workload(title).alias("workload"), X.employer(html).alias("employer"))


@_query("""
WITH old AS (SELECT doc_id, source, md5(lower(trim(text))) AS k FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0),
fresh AS (SELECT doc_id, source, md5(lower(trim(text))) AS k FROM documents WHERE doc_id % 3 <> 0),
o AS (SELECT f.doc_id, min(old.doc_id) AS i FROM fresh f JOIN old ON old.k = f.k AND old.source <> f.source GROUP BY f.doc_id),
n AS (SELECT k, min(doc_id) AS i, arg_min(source, doc_id) AS s FROM fresh WHERE k NOT IN (SELECT k FROM old WHERE k IS NOT NULL) GROUP BY k)
SELECT f.doc_id, coalesce(o.i, CASE WHEN n.s <> f.source THEN n.i END) AS duplicate_of FROM fresh f LEFT JOIN o USING (doc_id) LEFT JOIN n ON n.k = f.k
""")
def stored_duplicates(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.lower(F.trim("text"))).alias("k"), F.col("doc_id").alias("seen"))
    old = d.where("doc_id % 3 = 0").withColumn("is_active", F.col("doc_id") % 2 == 0)
    return dedup.stored_duplicates(d.where("doc_id % 3 <> 0"), old, "k", "source", "doc_id", "seen").select("doc_id", "duplicate_of")


# --- stored rows: reviews, states, caches, feeds ------------------------------


def _suggestions(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 2 == 0, "tag_category").otherwise("title_ngram")
    return _read(spark, sf_dir, "part").select(
        key.alias("id"), F.concat(F.lit("u"), F.col("p_size") % 5).alias("user_id"), kind.alias("suggestion_type"),
        F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("pattern"), F.when(key % 3 == 0, "rejected").otherwise("pending").alias("status"),
    )


@_query("""
WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status, CASE p_partkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' END AS d FROM part)
SELECT id, CASE WHEN status = 'pending' AND d IS NOT NULL THEN d ELSE status END AS status FROM s
""")
def reviewed_suggestions(spark, sf_dir):
    return merge.review(_suggestions(spark, sf_dir), _decisions(spark, sf_dir))[0].select("id", "status")


def _decisions(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return _read(spark, sf_dir, "part").where(key % 4 < 2).select(key.alias("id"), F.when(key % 4 == 0, "approved").otherwise("rejected").alias("decision"))


@_query("""
SELECT 'u' || p_size % 5 AS user_id, CASE WHEN p_size % 2 = 0 THEN 'tag_contains' ELSE 'title_contains' END AS filter_type, lower(p_name) AS pattern, true AS is_active, 'auto' AS source
FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 <> 0
""")
def filters_of_reviews(spark, sf_dir):
    return merge.review(_suggestions(spark, sf_dir), _decisions(spark, sf_dir))[1]


@_query("""
SELECT p_partkey AS id, 'rejected' AS status FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000000, 'pending' FROM supplier
""")
def pending_replaced(spark, sf_dir):
    new = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.lit("pending").alias("status"))
    return merge.replace_pending(_suggestions(spark, sf_dir), new).select("id", "status")


@_query("""
WITH a AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS applied_at, CASE o_orderstatus WHEN 'F' THEN 'applied' ELSE 'saved' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'interview' END AS s FROM orders)
SELECT id, CASE WHEN s = 'applied' THEN coalesce(applied_at, '2001-08-01') ELSE applied_at END AS applied, coalesce(s, status) AS status, CASE WHEN s IS NOT NULL THEN '2001-08-01' ELSE '1990-01-01' END AS updated FROM a
""")
def application_status(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    done, key = F.col("o_orderstatus") == "F", F.col("o_orderkey")
    apps = o.select(key.alias("id"), F.when(done, F.col("o_orderdate").cast("timestamp")).alias("applied_at"), F.when(done, "applied").otherwise("saved").alias("status"), _now("1990-01-01").alias("updated_at"))
    changes = o.where(key % 3 < 2).select(key.alias("id"), F.when(key % 3 == 0, "applied").otherwise("interview").alias("new_status"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return merge.set_application_status(apps, changes, _now()).select("id", day("applied_at").alias("applied"), "status", day("updated_at").alias("updated"))


@_query("""
SELECT 'orders' AS name, count(*) FILTER (WHERE o_custkey IS DISTINCT FROM 7) AS kept, count(*) FILTER (WHERE o_custkey = 7) AS exported FROM orders
UNION ALL SELECT 'events', count(*) FILTER (WHERE user_id IS DISTINCT FROM 7), count(*) FILTER (WHERE user_id = 7) FROM events
""")
def user_erase_and_export(spark, sf_dir):
    tables = {"orders": _read(spark, sf_dir, "orders").withColumn("user_id", F.col("o_custkey").cast("string")), "events": _read(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("string"))}
    kept, out = merge.erase_user(tables, "7"), merge.export_user(tables, "7")
    parts = []
    for name in tables:
        k = kept[name].select(F.lit(name).alias("name"), F.lit(1).alias("k"), F.lit(0).alias("e"))
        parts.append(k.unionByName(out[name].select(F.lit(name).alias("name"), F.lit(0).alias("k"), F.lit(1).alias("e"))))
    return parts[0].unionByName(parts[1]).groupBy("name").agg(F.sum("k").alias("kept"), F.sum("e").alias("exported"))


@_query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size <= 24 THEN upper(p_name) END AS value, NOT (p_partkey % 2 = 0 AND p_size <= 24) AS asked FROM part
""")
def cached_answers(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    text = F.concat_ws("|", "p_name", "p_partkey")
    aged = _now() - F.make_interval(hours=F.col("p_size"))
    cache = part.where("p_partkey % 2 = 0").select(F.md5(text).alias("key"), F.upper("p_name").alias("value"), aged.alias("stored_at"))
    found, asked = sinks.cached(part, cache, text, _now(), 24 * 3600)
    return found.select("p_partkey", "value", F.lit(False).alias("asked")).unionByName(asked.select("p_partkey", F.lit(None).cast("string").alias("value"), F.lit(True).alias("asked")))


@_query(r"""
SELECT 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') || chr(13) || chr(10)
  || 'SUMMARY:' || o_orderpriority || '\; a\, b\\c\nd' || chr(13) || chr(10) || 'END:VEVENT' AS value FROM orders
""")
def calendar_entries(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), "o_orderdate", F.concat("o_orderpriority", F.lit("; a, b\\c\nd")).alias("summary"))
    return sinks.calendar(o, "uid", "o_orderdate", "summary")


@_query("SELECT 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS value FROM events WHERE event_type IS NOT NULL AND props IS NOT NULL")
def event_stream(spark, sf_dir):
    return sinks.event_stream(_events(spark, sf_dir).where("event_type IS NOT NULL AND props IS NOT NULL"), "event_type", "props")


def _order_postings(spark, sf_dir) -> DataFrame:
    o, key, i = _read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    level = F.when(key % 7 == 0, "intern").when(key % 7 != 1, "senior")
    contract = F.when(key % 11 == 0, "internship").when(key % 11 == 1, "apprenticeship").when(key % 11 != 2, "permanent")
    return o.select(
        i.alias("hash"), F.col("o_orderpriority").alias("title"), F.lit("d").alias("description"), F.concat(F.lit("C"), F.col("o_custkey")).alias("company"), F.concat(F.lit("s"), key % 4).alias("source"),
        F.lit("x").alias("location"), F.when(key % 5 != 0, F.lit("ZH")).otherwise("BE").alias("canton"), F.when(key % 2 == 0, "de").otherwise("en").alias("language"), level.alias("seniority"),
        contract.alias("contract_type"), (key % 3 == 0).alias("remote"), F.col("o_totalprice").alias("salary_min_chf"), F.when(key % 6 != 0, F.col("o_totalprice") + 10_000).alias("salary_max_chf"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen_at"), F.col("o_orderdate").cast("timestamp").alias("last_seen_at"), (key % 13 != 0).alias("is_active"), F.when(key % 17 == 0, "0").alias("duplicate_of"),
    )


_SHOWN = "o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 > 1"


@_query(f"SELECT o_orderkey::VARCHAR AS hash, 'C' || o_custkey AS company FROM orders WHERE {_SHOWN} AND o_orderkey % 4 IN (1, 3) AND o_orderkey % 5 = 0 AND o_totalprice <= 300000 ORDER BY o_orderdate DESC, hash LIMIT 100")
def search_newest(spark, sf_dir):
    p = search.SearchParams(source="s1, s3", canton="be", salary_max=300_000, limit=100)
    return search.search(_order_postings(spark, sf_dir), p)[0].select("hash", "company")


@_query(f"SELECT o_orderkey::VARCHAR AS hash FROM orders WHERE {_SHOWN} AND o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 AND o_totalprice + 10000 >= 50000 ORDER BY o_orderdate, hash LIMIT 50 OFFSET 20")
def search_oldest(spark, sf_dir):
    p = search.SearchParams(language="en", is_remote=True, salary_min=50_000, sort="oldest", limit=50, offset=20)
    return search.search(_order_postings(spark, sf_dir), p)[0].select("hash")


@_query(f"SELECT count(*) AS total, count(*) > 40 AS has_more FROM orders WHERE {_SHOWN} AND o_orderkey % 7 <> 1 AND o_orderkey % 11 > 2 AND o_orderpriority = '1-URGENT'")
def search_total(spark, sf_dir):
    p = search.SearchParams(q="urgent", seniority="senior", contract_type="permanent", limit=30, offset=10)
    return search.search(_order_postings(spark, sf_dir), p)[1]


@_query("SELECT p_partkey FROM part WHERE NOT contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'cold')")
def blocked_titles(spark, sf_dir):
    return pipelines.blocked_titles(_read(spark, sf_dir, "part").withColumn("title", F.upper("p_name")), ["Ring", "cold"]).select("p_partkey")


@_query("SELECT p_partkey, p_size % 2 = 0 AND (contains(lower(p_name), 'ring') OR p_type = 'ECONOMY' OR contains(lower(p_type), 'cold')) AS marked FROM part")
def level_markers(spark, sf_dir):
    tags = F.when(F.col("p_type") == "ECONOMY", F.array("p_type"))
    marked = watchlist.has_marker(F.col("p_name"), tags, F.when(F.col("p_size") % 2 == 0, "H").otherwise("A"), ["RING", "economy"])
    return _read(spark, sf_dir, "part").select("p_partkey", marked.alias("marked"))


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'archived' WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'P' THEN 'drafted' ELSE s END AS state
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'detected' WHEN 'O' THEN 'reviewed' ELSE 'offer' END AS s FROM orders)
""")
def match_states(spark, sf_dir):
    key, o = F.col("o_orderkey"), F.col("o_orderstatus")
    state = F.when(o == "F", "detected").when(o == "O", "reviewed").otherwise("offer")
    wanted = F.when(key % 5 == 0, "archived").when(key % 3 == 0, "no such state")
    return _read(spark, sf_dir, "orders").select("o_orderkey", watchlist.advance(state, wanted, key % 2 == 0).alias("state"))


@_query("""
WITH n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT c_custkey AS id, c_custkey % 3 AS total, c_custkey % 4 <> 0 AND c_custkey % 9 <> 0 AS ran FROM customer)
SELECT id, total + CASE WHEN ran THEN coalesce(n, 0) ELSE 0 END AS total_matches, CASE WHEN ran THEN '2001-08-01 00:00' ELSE '2001-07-31 01:00' END AS last_run FROM s LEFT JOIN n USING (id)
""")
def search_bookkeeping(spark, sf_dir):
    key = F.col("c_custkey")
    s = _read(spark, sf_dir, "customer").select(key.alias("id"), (key % 3).alias("total_matches"), F.when(key % 4 == 0, "daily").otherwise("realtime").alias("notify_frequency"), _now("2001-07-31 01:00:00").alias("last_run_at"), (key % 9 != 0).alias("is_active"))
    found = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("search_id"))
    return watchlist.after_run(s, found, _now()).select("id", "total_matches", F.date_format("last_run_at", "yyyy-MM-dd HH:mm").alias("last_run"))


@_query("SELECT p_partkey, lower(p_name) AS pattern, true AS is_active, 'manual' AS source FROM part WHERE p_size % 5 <> 0")
def stored_filters(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "   ").otherwise(F.concat(F.lit(" "), F.upper("p_name"))).alias("pattern"))
    return watchlist.new_filter(rows)


@_query("SELECT o_orderkey AS hash, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 2 WHEN o_orderkey % 9 = 0 THEN 1 END::VARCHAR AS duplicate_of, o_orderkey % 4 <> 0 AND o_orderstatus <> 'F' AS is_active FROM orders")
def marked_duplicates(spark, sf_dir):
    key = F.col("o_orderkey")
    jobs = _read(spark, sf_dir, "orders").select(key.alias("hash"), F.when(key % 9 == 0, F.lit(1).cast("bigint")).alias("duplicate_of"), (F.col("o_orderstatus") != "F").alias("is_active"))
    found = jobs.where("hash % 4 = 0").select("hash", F.expr("hash div 2").alias("duplicate_of"))
    return dedup.mark_duplicates(jobs, found).withColumn("duplicate_of", F.col("duplicate_of").cast("string"))


@_query("""
WITH w AS (SELECT p_partkey, p_name, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 1) AS w FROM part WHERE p_size % 3 = 0),
g AS (SELECT DISTINCT p_partkey, p_name, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS pattern FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY p_partkey) AS n FROM g WHERE pattern IN (SELECT lower(p_name) FROM part WHERE p_size < 3) OR pattern IN ('ring', 'widget'))
SELECT pattern, string_agg(p_name, '|' ORDER BY n) AS samples FROM r WHERE n <= 5 GROUP BY pattern
""")
def pattern_samples(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    wanted = part.where("p_size < 3").select(F.lower("p_name").alias("pattern")).unionByName(spark.createDataFrame([("ring",), ("widget",)], "pattern string")).distinct()
    found = patterns.samples(part.withColumn("rejected", F.col("p_size") % 3 == 0), "p_name", "rejected", "p_partkey", wanted)
    return found.select("pattern", F.array_join("samples", "|").alias("samples"))


@_query(r"""
SELECT doc_id, nullif(left(text, 200), '') AS snippet, md5(replace(replace(replace(replace(replace(text || '<&>"''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS markup_md5,
  CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang ELSE '' END AS identity FROM documents
""")
def snippets_and_escapes(spark, sf_dir):
    third = F.col("doc_id") % 3
    identity = X.url_identity(F.when(third == 0, F.col("source")).otherwise(""), F.when(third == 1, F.col("lang")), F.lit(None).cast("string"), F.lit(""))
    markup = F.md5(X.escape_markup(F.concat("text", F.lit("<&>\"'"))))
    return _read(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"), markup.alias("markup_md5"), identity.alias("identity"))


@_query("""
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'ECONOMY|' || p_brand || '|x' ELSE p_type || '|' || p_brand || '|economy|x' END AS tags FROM part
""")
def merged_tags(spark, sf_dir):
    tags = X.merge_tags(F.array("p_type", F.lit(" "), F.concat(F.lit(" "), "p_brand")), F.array(F.lower("p_brand"), F.lit("economy"), F.lit("x")))
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(tags, "|").alias("tags"))


@_query("""
WITH d AS (SELECT CASE WHEN doc_id % 10 <> 0 THEN lang END AS lang FROM documents)
SELECT count(*) FILTER (WHERE lang IS NULL) + count(DISTINCT lang) AS n, count(DISTINCT lang) AS keys FROM d
""")
def repeats_dropped(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("lang"))
    return dedup.drop_repeats(d, "lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("keys"))


@_query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') AND contains(p_name, 'cold') THEN 'cold|ring' WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'cold') THEN 'cold' ELSE '' END AS terms, CASE WHEN p_type = 'ECONOMY' THEN 'EC' WHEN contains(p_type, 'STAND') THEN 'ST' END AS code FROM part")
def terms_and_regions(spark, sf_dir):
    terms = X.regex_terms(F.concat_ws(" ", "p_name", F.upper("p_name")), ["ring", "COLD"])
    code = X.region_code(F.concat(F.lit(" "), "p_type"), {"economy": "EC", "stand": "ST"})
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(terms, "|").alias("terms"), code.alias("code"))


@_query("""
SELECT 'parts' AS source, count(*) FILTER (WHERE p_size % 4 <> 0) AS good, count(*) FILTER (WHERE p_size % 4 = 0) AS bad FROM part
UNION ALL SELECT 'customers', count(*), 0 FROM customer
""")
def sources_united(spark, sf_dir):
    known = readers.Registry()
    row = lambda key, title: [F.col(key).cast("string").alias("hash"), F.col(title).alias("title"), F.lit("c").alias("company"), F.lit("u").alias("url")]
    known.add("parts", lambda s: _read(s, sf_dir, "part").select(*row("p_partkey", "p_name")[:3], F.when(F.col("p_size") % 4 == 0, " ").otherwise("u").alias("url")))
    known.add("customers", lambda s: _read(s, sf_dir, "customer").select(*row("c_custkey", "c_name"), F.col("c_acctbal").alias("extra")), needs=("key",))
    known.add("orders", lambda s: _read(s, sf_dir, "orders"), needs=("absent",))
    good, bad = known.load(spark, {"key": "k"})
    marked = good.select("source", F.lit(1).alias("g")).unionByName(bad.select("source", F.lit(0).alias("g")))
    return marked.groupBy("source").agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("bad"))


# --- injected models -----------------------------------------------------------


@_query("""
WITH d AS (SELECT doc_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS b FROM documents)
SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN 0.5 WHEN a > 0 THEN (a / sqrt(a * a + b * b))::FLOAT::DOUBLE ELSE a END, 6) AS first FROM d
""")
def pending_embedded(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").withColumn("embedding", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>")))
    out = models.embedded(d, F.col("text"), lambda texts: [[len(t), t.count("e")] for t in texts])
    return out.select("doc_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@_query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' WHEN length(trim(source || ' ' || left(text, 60 - doc_id % 30))) >= 50 AND doc_id % 10 >= 7 AND lang IN ('de', 'fr', 'en', 'it') THEN lang END AS language FROM documents
""")
def languages_detected(spark, sf_dir):
    key = F.col("doc_id")
    guess = F.struct(F.col("lang").alias("lang"), ((key % 10) / 10.0).alias("prob"))
    body = F.expr("substring(text, 1, CAST(60 - doc_id % 30 AS INT))")
    return _read(spark, sf_dir, "documents").select("doc_id", models.language(F.when(key % 5 == 0, "xx").otherwise(""), F.col("source"), body, guess).alias("language"))


@_query("SELECT doc_id, left(text, 800) AS description, array_to_string(list_slice(regexp_split_to_array(text, ' '), 1, 15), '|') AS tags FROM documents")
def rerank_candidates(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"), F.split("text", " ").alias("tags"))
    return models.candidates(d).withColumn("tags", F.array_join("tags", "|"))


_HEAD_SQL = """
WITH r AS (SELECT o_custkey % 40 AS user_id, o_orderkey, row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey % 40) AS total
  FROM orders WHERE o_custkey % 40 < 20 OR o_orderkey % 9 = 0 WINDOW w AS (PARTITION BY o_custkey % 40 ORDER BY o_totalprice DESC, o_orderkey)),
h AS (SELECT user_id, o_orderkey, (n - 1) // 10 AS batch, (n - 1) % 10 AS place FROM r WHERE total <= 150 OR n <= 50)
"""


def _head(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders").where("o_custkey % 40 < 20 OR o_orderkey % 9 = 0").withColumn("user_id", F.col("o_custkey") % 40)
    return models.rerank_head(o, "user_id", [F.desc("o_totalprice"), F.asc("o_orderkey")])


@_query(_HEAD_SQL + "SELECT user_id, o_orderkey, batch::INTEGER AS batch, place::INTEGER AS place FROM h")
def rerank_heads(spark, sf_dir):
    return _head(spark, sf_dir).select("user_id", "o_orderkey", "batch", "place")


@_query(_HEAD_SQL + "SELECT h.o_orderkey, n_name AS answer FROM h LEFT JOIN nation ON n_nationkey = user_id AND batch = n_regionkey AND place = n_nationkey % 10")
def answers_by_place(spark, sf_dir):
    answers = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("user_id"), F.col("n_regionkey").alias("batch"), (F.col("n_nationkey") % 10).alias("place"), F.col("n_name").alias("answer"))
    return models.by_place(_head(spark, sf_dir), answers, "user_id").select("o_orderkey", "answer")


@_query("""
WITH m AS (SELECT p_partkey, p_size / 53.0::DOUBLE AS e, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 100 > 0 THEN round((p_partkey % 100) / 100.0::DOUBLE, 4) END AS l FROM part)
SELECT p_partkey, CASE WHEN l IS NULL THEN 1 ELSE round_even(round_even((0.35::DOUBLE * e + 0.15::DOUBLE * 0.5 + 0.1::DOUBLE * 0.5 + 0.15::DOUBLE * 0.5 + 0.15::DOUBLE * l + 0.1::DOUBLE * 0.5) * 100, 1) * 1.1::DOUBLE, 2) END AS score_final,
  CASE WHEN l IS NULL THEN 'own' WHEN p_partkey % 2 = 0 THEN 'theirs' ELSE 'own' END AS matching, CASE WHEN l IS NULL THEN '' ELSE 'why' END AS explanation FROM m
""")
def results_applied(spark, sf_dir):
    part, key = _read(spark, sf_dir, "part"), F.col("p_partkey")
    half = {f"score_{k}": F.lit(0.5) for k in S.DEFAULT_WEIGHTS if k not in ("embedding", "llm")}
    m = part.select("p_partkey", (F.col("p_size") / 53.0).alias("score_embedding"), F.lit(0.0).alias("score_llm"), F.lit(1.0).alias("score_final"), F.lit("").alias("explanation"))
    m = m.withColumns(half | {"score_weights": F.lit(None).cast("map<string,double>"), "matching_skills": F.array(F.lit("own")), "missing_skills": F.array(F.lit("own"))})
    theirs = F.when(key % 2 == 0, F.array(F.lit("theirs"))).otherwise(F.array().cast("array<string>"))
    r = part.where("p_partkey % 3 = 0").select("p_partkey", (key % 100).alias("llm"), F.lit("why").alias("explanation"), theirs.alias("matching"), theirs.alias("missing"))
    return models.apply_results(m, r, ["p_partkey"], F.lit(1.1)).select("p_partkey", "score_final", F.col("matching_skills")[0].alias("matching"), "explanation")


@_query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE 1000 + p_size END::VARCHAR AS lo, CASE p_size % 5 WHEN 1 THEN 2000 + p_size WHEN 2 THEN 1000 + p_size END::VARCHAR AS hi,
  CASE p_size % 5 WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'EUR' END AS currency, CASE p_size % 5 WHEN 1 THEN 'yearly' WHEN 2 THEN 'hourly' WHEN 3 THEN 'monthly' END AS period FROM part
""")
def shown_pay(spark, sf_dir):
    n = F.col("p_size")
    text = (
        F.when(n % 5 == 0, "€ Not Disclosed").when(n % 5 == 1, F.format_string("€1,%03d.00 - €%d per annum", n, n + 2000))
        .when(n % 5 == 2, F.format_string("£1,%03d an hour", n)).when(n % 5 == 3, F.format_string("€%d - €00 a month", n + 1000)).otherwise("€0.00")
    )
    pay = E.parse_shown_pay(text)
    return _read(spark, sf_dir, "part").select("p_partkey", pay["lo"].cast("string").alias("lo"), pay["hi"].cast("string").alias("hi"), pay["currency"].alias("currency"), pay["period"].alias("period"))


@_query(f"""
SELECT user_id, count(*) AS n, string_agg('- ' || event_type || ' /e/' || event_id, chr(10) ORDER BY event_id) AS text FROM events WHERE ts >= TIMESTAMP '{EVENT_NOW}' - INTERVAL 24 HOUR GROUP BY user_id
""")
def daily_digest(spark, sf_dir):
    e = sinks.of_last_hours(_events(spark, sf_dir), "ts", _now(EVENT_NOW)).withColumn("url", F.concat(F.lit("/e/"), "event_id"))
    return sinks.digest(e, "user_id", "event_type", "url", ["event_id"]).select("user_id", "n", "text")


# --- extras over events, absent upstream -------------------------------------


@_query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    out = incremental.tumbling_counts(_events(spark, sf_dir), "ts", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@_query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s
""")
def session_counts(spark, sf_dir):
    out = incremental.session_counts(_events(spark, sf_dir), "ts", "user_id", "60 minutes")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


from . import stored_queries, user_queries  # noqa: E402, F401 - they register their queries
