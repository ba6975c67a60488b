"""Registered queries that keep state: cursors, snapshots, dumps, streams, pages."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..schema import POSTING
from ..sources import dumps, readers
from ..storage import Snapshots, shared_dir
from ..streaming import incremental
from . import pipelines
from .registry import events, moment, query, read


def _fresh(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# --- cursors and streams ----------------------------------------------------------


@query("""
WITH r AS (SELECT event_type AS source_key, 's' || user_id % 3 AS scope_key, ts::DATE AS day, count(*) FILTER (WHERE value > 75)::DOUBLE AS n, (count(*) // 3)::DOUBLE AS p FROM events GROUP BY ALL),
a AS (SELECT source_key, scope_key, list(n ORDER BY day) AS ns, list(p ORDER BY day) AS ps, max(day) FILTER (WHERE n > 0) AS hit FROM r GROUP BY ALL),
i AS (SELECT event_type AS source_key, 's' || user_id % 3 AS scope_key, event_id % 997 AS x, max(ts::DATE) AS day FROM events WHERE event_id % 997 > 0 GROUP BY ALL),
j AS (SELECT source_key, scope_key, x FROM i QUALIFY row_number() OVER (PARTITION BY source_key, scope_key ORDER BY day DESC, x) <= 300),
f AS (SELECT source_key, scope_key, count(*) AS n_recent, sum(x)::BIGINT AS sum_recent FROM j GROUP BY ALL)
SELECT source_key, scope_key, len(ns) AS runs, list_reduce([0::DOUBLE] || ns, lambda s, x: printf('%.2f', 0.7::DOUBLE * s + 0.3::DOUBLE * x)::DOUBLE) AS avg_new,
  list_reduce([0::DOUBLE] || ps, lambda s, x: printf('%.2f', 0.7::DOUBLE * s + 0.3::DOUBLE * x)::DOUBLE) AS avg_pages,
  (SELECT count(*) FROM r WHERE r.source_key = a.source_key AND r.scope_key = a.scope_key AND (hit IS NULL OR day > hit)) AS empty_runs, n_recent, sum_recent
FROM a JOIN f USING (source_key, scope_key)
""")
def cursor_state(spark, sf_dir):
    """Daily runs arrive in three parts of the time; each part is a run of the stream
    on the checkpoint of the one before, and the snapshots keep its cursors."""
    e = events(spark, sf_dir).withColumns({"day": F.to_date("ts"), "scope_key": F.concat(F.lit("s"), F.col("user_id") % 3), "x": F.nullif(F.col("event_id") % 997, F.lit(0))})
    seen = F.transform(F.array_sort(F.collect_set("x")), lambda x: x.cast("string"))
    runs = e.groupBy(F.col("event_type").alias("source_key"), "scope_key", F.col("day").cast("timestamp").alias("run_at")).agg(
        seen.alias("identities"), F.count_if(F.col("value") > 75).cast("int").alias("n_new"), F.expr("count(*) div 3").cast("int").alias("pages")
    )
    first, last = runs.agg(F.min("run_at"), F.max("run_at")).first()
    home = _fresh(spark, "cursor-runs")
    table = Snapshots(spark, f"{home}/cursors", incremental.CURSOR_OUT)
    part = F.least(F.floor((F.unix_timestamp("run_at") - F.unix_timestamp(F.lit(first))) * 3 / (F.unix_timestamp(F.lit(last)) - F.unix_timestamp(F.lit(first)) + 1)), F.lit(2))
    parts = runs.withColumn("_part", part)
    for k in range(3):
        parts.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{home}/runs")
        incremental.run_cursors(incremental.file_stream(spark, f"{home}/runs", runs.schema), table, f"{home}/checkpoint")
    total = F.aggregate("recent_identities", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return table.current().select(
        "source_key", "scope_key", F.col("runs").cast("long").alias("runs"), F.col("avg_new_jobs_per_run").alias("avg_new"), F.col("avg_pages_per_run").alias("avg_pages"),
        F.col("consecutive_empty_runs").cast("long").alias("empty_runs"), F.size("recent_identities").cast("long").alias("n_recent"), total.alias("sum_recent"),
    )


@query("""
SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY event_type
""")
def fresh_events(spark, sf_dir):
    """Every third event arrives again, an hour late, in the next file: within the
    watermark's delay each counts once."""
    home = _fresh(spark, "late-events")
    e = events(spark, sf_dir).select("event_id", "event_type", "ts")
    again = e.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.make_interval(hours=F.lit(1)))
    table = Snapshots(spark, f"{home}/table", e.schema)
    for part in (e.where("event_id % 2 = 0"), again, e.where("event_id % 2 = 1"), again):
        part.write.mode("append").parquet(f"{home}/in")
        fresh = incremental.fresh_only(incremental.file_stream(spark, f"{home}/in", e.schema), "event_id", "ts", "400 days")
        incremental.drain(fresh, table.each_batch("fresh", lambda old, new: old.unionByName(new)), f"{home}/checkpoint")
    return table.current().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


@query("""
SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE o_orderkey % 2 END::BIGINT AS seen FROM orders
""")
def snapshot_upserts(spark, sf_dir):
    """Three batches of postings, each delivered twice, merged into snapshots: the
    second delivery changes nothing, known rows keep their contents."""
    from ..operators.merge import upsert

    o = read(spark, sf_dir, "orders")
    table = Snapshots(spark, _fresh(spark, "snapshots"), "o_orderkey long, price double, last_seen_at long, is_active boolean")
    each = [o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), o.where("o_orderkey % 3 = 0")]
    for k, batch in enumerate(each):
        rows = batch.select("o_orderkey", (F.col("o_totalprice") + k).alias("price"), F.lit(k).cast("long").alias("last_seen_at"), F.lit(True).alias("is_active"))
        step = table.each_batch("orders", lambda old, new, k=k: upsert(old, new, "o_orderkey", F.lit(k).cast("long")))
        for _ in range(2):
            step(rows, k)
    return table.current().select("o_orderkey", "price", F.col("last_seen_at").alias("seen"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 40 AS r, lang, least(doc_id, 35) AS days FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 0),
k AS (SELECT r, arg_max(doc_id, (days, doc_id)) AS doc_id FROM d GROUP BY r),
j AS (SELECT d.* FROM d JOIN k USING (doc_id)),
u AS (SELECT n_nationkey AS user_id, n_nationkey % 40 AS r, CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'de' END AS speaks FROM nation),
s AS (SELECT user_id, doc_id, (0.35::DOUBLE * (u.r = j.r)::INTEGER + 0.15::DOUBLE * 0.5 + 0.1::DOUBLE * 0.5 + 0.15::DOUBLE * CASE WHEN days <= 1 THEN 1 WHEN days <= 7 THEN 0.8 WHEN days <= 14 THEN 0.5 WHEN days <= 30 THEN 0.3 ELSE 0.1 END::DOUBLE
  + 0.1::DOUBLE * CASE WHEN lang IS NULL THEN 0.5 WHEN lang = speaks THEN 1 ELSE 0.2 END::DOUBLE) * 100 AS score FROM u, j)
SELECT user_id::VARCHAR AS user_id, 'Job ' || doc_id AS title, round_even(score, 1) AS score_final FROM s WHERE round_even(score, 1) >= 35
""")
def chained_run(spark, sf_dir):
    """Two runs of the whole chain over one jobs table: the second brings the postings
    again with some more, copies by vector are marked, and profiles are matched. A
    posting is a second older than the one before, whatever the number of documents."""
    d, key = read(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("doc_id")
    raw = d.select(
        F.lit("board").alias("source"), F.concat(F.lit("Job "), key).alias("title"), F.lit("Acme").alias("company"), F.concat(F.lit("u"), key).alias("url"), F.left("text", F.lit(40)).alias("description"),
        F.array((key % 40).cast("string")).alias("tags"), F.col("lang").alias("language"), (moment() - F.make_interval(days=F.least(key, F.lit(35)).cast("int"), secs=key)).alias("first_seen_at"), key.alias("n"),
    )
    users = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("user_id"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (i == F.col("n_nationkey") % 40).cast("float")).alias("cv_embedding"),
        F.lit(None).cast("int").alias("salary_min"), F.lit(None).cast("int").alias("salary_max"), F.array().cast("array<string>").alias("locations"),
        F.array(F.when(F.col("n_nationkey") % 2 == 0, "English").otherwise("German")).alias("languages"), F.array().cast("array<string>").alias("skills"), F.lit(None).cast("map<string,double>").alias("score_weights"),
    )

    def model(texts: list[str]) -> np.ndarray:
        """Stands for a model: one direction for each last word, which is the tag."""
        return np.eye(40)[[int(t.rsplit(" ", 1)[1]) for t in texts]]

    table = Snapshots(spark, _fresh(spark, "jobs"), POSTING)
    for part in (raw.where("n % 2 = 0"), raw):
        matches, _ = pipelines.chained(part.where("n % 13 <> 0").drop("n"), table, users, moment(), model)
    return matches.select("user_id", "title", "score_final")


# --- dumps and pages --------------------------------------------------------------


@query("""
SELECT 'all' AS part, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IS NOT NULL GROUP BY lang
UNION ALL SELECT 'one', lang, 1, n_chars FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)
""")
def landed_dump(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "lang", "n_chars")
    path = _fresh(spark, "dump")
    both = d.withColumn("facet", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    dumps.land(both, path, "doc_id", "facet", 16)
    fields = "lang string, n_chars long"
    key = d.agg(F.max("doc_id").cast("string")).first()[0]
    everything = dumps.read_dump(spark, path, 16, fields).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    one = dumps.read_dump(spark, path, 16, fields, [key or ""])
    return everything.select(F.lit("all").alias("part"), "lang", "n", "chars").unionByName(one.select(F.lit("one").alias("part"), "lang", F.lit(1).cast("long").alias("n"), F.col("n_chars").alias("chars")))


@query(r"""
WITH m AS (SELECT page_id, regexp_extract_all(html, '(?:var t=|track\()("[^"]*"|\d+)', 1) AS found FROM pages)
SELECT page_id, unnest(range(len(found)))::INTEGER AS pos, unnest(found) AS literal FROM m
""")
def page_literals(spark, sf_dir):
    return readers.script_literals(read(spark, sf_dir, "pages"), r"var t=|track\(").select("page_id", "pos", "literal")


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS head, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Detail: ' || head ELSE title END AS title, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN NULL ELSE lang END AS lang, page_id % 3 = 0 AS detailed FROM p
""")
def page_details(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    cut = lambda pattern: F.regexp_extract("html", pattern, 1)
    stubs = p.select("page_id", "url", cut(r"<title>(.*?)</title>").alias("title"), cut(r'<html lang="([a-z]*)"').alias("lang"), F.lit(None).cast("string").alias("detailed"))
    fields = F.create_map(F.lit("title"), F.concat(F.lit("Detail: "), cut(r"<h1>(.*?)</h1>")), F.lit("detailed"), F.lit("yes"))
    more = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("lang"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    details = p.where("page_id % 3 = 0").select("page_id", F.map_concat(fields, more).alias("fields"))
    return readers.with_details(stubs, details, "page_id").select("page_id", "title", "lang", F.col("detailed").isNotNull().alias("detailed"))
