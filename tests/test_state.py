"""Filters of many users, vectors in cells, snapshots, answers, caches, dumps, late events."""

import json
import math
import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.functions import answers as A
from sievework.functions import enrich as E
from sievework.functions import text as X
from sievework.operators import ask_once, dedup, fulltext, models, patterns, user_filters, views, watchlist
from sievework.operators.merge import upsert
from sievework.plans import catalogue, stored_queries, user_queries
from sievework.sources import dumps, readers, sinks
from sievework.storage import Snapshots
from sievework.streaming import incremental

T0 = datetime(2024, 1, 1)


# --- filters of many users ---------------------------------------------------------


def hidden(job, filters):
    _, title, tags = job
    for kind, pattern in filters:
        if kind == "title_contains" and (title is None or pattern.lower() in title.lower()):
            return True
        if kind == "tag_contains" and tags is not None and pattern in tags:
            return True
    return False


@pytest.mark.parametrize("most", [100_000, 3])
def test_filters_of_users(spark, most):
    rnd = random.Random(3)
    words = ["Sales", "50% off", "a_b", "Écrit", "sale", "", "Koch", "x\\y", "ALES M", "ss"]
    jobs = [(i, rnd.choice([None, "", " ".join(rnd.choice(words) for _ in range(3))]), rnd.choice([None, [], ["a", "B"], ["b", None], ["a", "a"]])) for i in range(60)]
    filters = [(u, rnd.choice(["title_contains", "tag_contains"]), rnd.choice([*words, "a", "b", None]), rnd.random() < 0.8) for u in range(25) for _ in range(rnd.randint(0, 3))]
    pairs = [(u, j) for u in range(26) for j in range(0, 60, 2)]
    j = spark.createDataFrame(jobs, "hash int, title string, tags array<string>")
    f = spark.createDataFrame(filters, "user_id int, filter_type string, pattern string, is_active boolean")
    p = spark.createDataFrame(pairs, "user_id int, hash int")
    own = {u: [(k, x) for v, k, x, on in filters if v == u and on and x is not None] for u in range(26)}
    want = sorted((u, i) for u, i in pairs if not hidden(jobs[i], own[u]))
    assert sorted(map(tuple, user_filters.without_hidden(p, j, f, most=most).collect())) == want
    assert user_filters.without_hidden(p, j, f.limit(0), most=most).count() == len(pairs)
    assert user_filters.without_hidden(p, j.limit(0), f, most=most).count() == len(pairs)


def test_many_filters_without_nested_loops(spark):
    f = spark.range(100_000).select((F.col("id") % 900).alias("user_id"), F.lit("title_contains").alias("filter_type"), F.concat(F.lit("word "), "id").alias("pattern"), F.lit(True).alias("is_active"))
    jobs = spark.range(200).select(F.col("id").alias("hash"), F.concat(F.lit("a WORD "), F.col("id") * 7, F.lit(" z")).alias("title"), F.array(F.lit("t")).alias("tags"))
    pairs = spark.range(6000).select((F.col("id") % 200).alias("hash"), (F.floor(F.col("id") / 200) * 30).alias("user_id"))
    out, hits = user_filters.without_hidden(pairs, jobs, f), user_filters.hidden_pairs(jobs, f)
    for df in (hits, out):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = {tuple(r) for r in hits.collect()}
    want = {(int(t[:k]) % 900, i) for i in range(200) for t in [str(7 * i)] for k in range(1, len(t) + 1) if not (t[:k].startswith("0") and k > 1)}
    assert got == want
    assert out.count() == 6000 - sum(u % 30 == 0 for u, _ in got)


def most_rows(df):
    """The largest number of rows that any operator of df's plan makes."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
    return max(found)


@pytest.mark.parametrize("listed", [100, 0])
def test_rows_follow_candidates(spark, listed):
    """2,000 users filter a word that 2,000 titles have; each has two candidates."""
    f = spark.range(2000).select(F.col("id").alias("user_id"), F.lit("title_contains").alias("filter_type"), F.lit("word").alias("pattern"), F.lit(True).alias("is_active"))
    jobs = spark.range(2001).select(F.col("id").alias("hash"), F.when(F.col("id") < 2000, "a WORD").otherwise("other").alias("title"), F.array(F.lit("t")).alias("tags"))
    pairs = spark.range(4000).select((F.col("id") % 2000).alias("user_id"), F.when(F.col("id") < 2000, F.col("id")).otherwise(2000).alias("hash"))
    out = user_filters.without_hidden(pairs, jobs, f, listed=listed)
    assert sorted(map(tuple, out.collect())) == [(u, 2000) for u in range(2000)]
    assert most_rows(out) <= 12_000


@pytest.mark.parametrize("listed", [0, 3])
def test_users_with_many_filters(spark, listed):
    rnd = random.Random(7)
    jobs = [(i, rnd.choice([None, "", "ab", "Bc d"]), rnd.choice([None, [], ["a", None], ["b", "B"]])) for i in range(30)]
    filters = [(u, rnd.choice(["title_contains", "tag_contains"]), rnd.choice(["a", "B", "c d", "", "b", "zz"]), True) for u in range(12) for _ in range(rnd.randint(0, 4))]
    pairs = [(u, i, 7) for u in [*range(13), None] for i in [*range(0, 32, 3), None]] * 2
    j = spark.createDataFrame(jobs + [(3, "a", ["b"])], "hash int, title string, tags array<string>")
    f = spark.createDataFrame(filters, "user_id int, filter_type string, pattern string, is_active boolean")
    own = lambda u: [(k, x) for v, k, x, _ in filters if v == u]
    gone = lambda u, i: any(hidden(r, own(u)) for r in [*jobs, (3, "a", ["b"])] if r[0] == i)
    got = user_filters.without_hidden(spark.createDataFrame(pairs, "user_id int, hash int, n int"), j, f, listed=listed)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in pairs if not gone(*r[:2]))


def test_removed_filters(spark):
    f = spark.createDataFrame([(1, "u", True), (2, "u", True), (3, "v", False), (4, None, True)], "id int, user_id string, is_active boolean")
    r = spark.createDataFrame([(1, "u"), (1, "u"), (2, "v"), (3, "v"), (9, "u")], "id int, user_id string")
    assert {x["id"]: x["is_active"] for x in user_filters.removed_filters(f, r).collect()} == {1: False, 2: True, 3: False, 4: True}


# --- totals of saved searches ------------------------------------------------------


@pytest.mark.parametrize("spans", [1, 2, 64])
def test_totals_of_saved_searches(spark, spans):
    rnd = random.Random(5)
    pick = lambda *v: rnd.choice((None, *v))
    day = lambda k: None if k is None else T0 + timedelta(days=k)
    jobs = [(str(i), pick("a", "b"), pick("ZH", "BE"), pick("de", "en"), pick(True, False), day(pick(*range(6))), rnd.random() < 0.9, None) for i in range(200)]
    searches = []
    for i in range(70):
        asked = {"source": pick("a,b", "b", "a,a"), "canton": pick("zh", "be,ZH,zh"), "language": pick("de", ""), "remote_only": pick("1", "no")}
        searches.append((i, {k: v for k, v in asked.items() if v is not None}, day(pick(*range(7))), "daily", True))
    j = spark.createDataFrame(jobs, "hash string, source string, canton string, language string, remote boolean, last_seen_at timestamp, is_active boolean, duplicate_of string")
    s = spark.createDataFrame(searches, "id int, filters map<string,string>, last_run_at timestamp, notify_frequency string, is_active boolean")
    now = F.lit(T0 + timedelta(days=30))
    pairs = {}
    for r in watchlist.run_saved_searches(s, j, now).collect():
        pairs.setdefault(r.search_id, []).append(int(r.hash))
    want = {(k, len(v), min(v), max(v), sum(v)) for k, v in pairs.items()}
    found = watchlist.saved_search_totals(s, j, now, F.col("hash"), spans=spans)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 40
    assert watchlist.saved_search_totals(s, j.limit(0), now, F.col("hash")).count() == 0


@pytest.mark.parametrize("name", ["saved_search_run", "saved_search_notifications"])
def test_saved_searches_make_no_pairs(spark, tmp_path, name, monkeypatch):
    """900 customers and 2,000 documents meet in over 200,000 pairs."""
    spark.range(900).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), F.col("id") % 8).alias("source"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    made, stored = [], getattr(watchlist, "stored", None)
    monkeypatch.setattr(watchlist, "stored", lambda df, label: made.append(most_rows(df)) or stored(df, label), raising=False)
    out = getattr(user_queries, name)(spark, str(tmp_path))
    assert max([most_rows(out), *made]) < 20_000 and out.count() > 300


# --- vectors in cells --------------------------------------------------------------


def brute_copies(rows, threshold):
    unit = [np.asarray(v, float) / (np.linalg.norm(v) or 1) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][2], rows[k][0]))
    out = {}
    for at, k in enumerate(order):
        first = next((j for j in order[:at] if unit[k] @ unit[j] > threshold), None)
        if first is not None:
            out[rows[k][0]] = rows[first][0]
    return out


@pytest.mark.parametrize("threshold", [0.97, 0.7, 0.1, -0.2])
def test_copies_in_cells(spark, threshold):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 5))
    v = [c + rng.normal(scale=0.2, size=5) for c in centres for _ in range(25)]
    v += [v[3]] * 6 + [2 * v[3]] + [np.zeros(5)] * 3 + [v[100]] * 2
    rows = [(i, [float(y) for y in np.float32(x)], int(rng.integers(0, 40))) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (9999, None, 0)], "id long, v array<float>, age int")
    want = brute_copies(rows, threshold)
    for size in (16, 1000):
        assert {r[0]: r[1] for r in dedup.semantic_duplicates(df, threshold, "id", "v", "age", size).collect()} == want
    assert dedup.semantic_duplicates(df.limit(0), threshold, "id", "v", "age").count() == 0


def test_rows_sent_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    v = np.concatenate([centres[rng.integers(0, 60, 3000)] + rng.normal(scale=0.05, size=(3000, 16)), centres[:1] + rng.normal(scale=0.01, size=(1500, 16))]).astype(np.float32)
    n, block = len(v), 64
    base = spark.createDataFrame([(i, float(rng.integers(0, 10**6)), [float(y) for y in x]) for i, x in enumerate(v)], "i long, o double, v array<float>").cache()
    at_once, sent = dedup.semantic_cells(base, 0.95, block)
    rows = sent.count()
    assert at_once.count() > 1500  # the large family ends at its oldest member
    assert rows < 0.15 * n * n / block, rows
    largest = sent.groupBy("cell", "sub", "slice").count().agg(F.max("count")).first()[0]
    assert largest < 4 * block
    base.unpersist()


def test_rows_sent_without_clusters(spark):
    """Where old rows are near to most, as random vectors are at 0.4, few rows are sent."""
    n, rng = 20_000, np.random.default_rng(6)
    v = rng.normal(size=(n, 64)).astype(np.float32)
    rows = pa.table({"i": pa.array(range(n), pa.int64()), "v": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float32()))})
    df = spark.createDataFrame(rows)
    _, sent = dedup.semantic_cells(df.withColumn("o", F.col("i").cast("double")), 0.4)
    assert sent.count() < 2 * n
    u = v.astype(float) / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for lo in range(0, n, 1000):
        hit = np.tril(u[lo : lo + 1000] @ u.T > 0.4, lo - 1)
        want |= {lo + k: int(hit[k].argmax()) for k in np.flatnonzero(hit.any(axis=1))}
    assert {r[0]: r[1] for r in dedup.semantic_duplicates(df, 0.4, "i", "v", "i").collect()} == want


def test_blocks_of_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_VALUES", 40)
    rng = np.random.default_rng(9)
    rows = [(i, [float(y) for y in np.float32(rng.normal(size=5))], int(rng.integers(0, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<float>, age int")
    assert {r[0]: r[1] for r in dedup.semantic_duplicates(df, 0.6, "id", "v", "age").collect()} == brute_copies(rows, 0.6)


# --- snapshots and streams ---------------------------------------------------------


def test_snapshots(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "k int, last_seen_at int, is_active boolean")
    assert table.current().count() == 0 and not table.done("s", 0)
    rows = lambda *ks: spark.createDataFrame([(k, 1, True) for k in ks], table.schema)
    step = table.each_batch("s", lambda old, new: upsert(old, new, "k", F.lit(2)))
    step(rows(1, 2), 0)
    step(rows(1, 2), 0)
    step(rows(2, 3), 1)
    assert sorted(map(tuple, table.current().collect())) == [(1, 1, True), (2, 2, True), (3, 1, True)]
    assert table.commits().count() == 2
    # A crash between data and commit leaves data that nobody reads; the batch comes again.
    rows(9).write.parquet(str(tmp_path / "t" / "data" / "orphan"))
    broken = table.each_batch("s", lambda old, new: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken(rows(7), 2)
    assert table.current().count() == 3
    step(rows(7), 2)
    assert table.current().count() == 4 and table.done("s", 2) and not table.done("other", 2)


def test_stream_repeats_a_batch_after_a_crash(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "k long, n long")
    spark.range(10).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")).coalesce(1).write.parquet(str(tmp_path / "in"))
    merge = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    once = table.each_batch("sums", merge)

    def dies_after_commit(df, batch):
        once(df, batch)
        raise RuntimeError("lost after the commit")

    stream = lambda: incremental.file_stream(spark, str(tmp_path / "in"), table.schema)
    with pytest.raises(Exception, match="lost after the commit"):
        incremental.drain(stream(), dies_after_commit, str(tmp_path / "c"))
    incremental.drain(stream(), once, str(tmp_path / "c"))
    assert table.current().agg(F.sum("n")).first()[0] == 10 and table.commits().count() == 1


def test_late_and_repeated_events(spark, tmp_path):
    schema = "id string, ts timestamp"
    parts = [
        [("a", T0), ("b", T0 + timedelta(hours=30)), ("a", T0 + timedelta(hours=1))],
        [("b", T0 + timedelta(hours=31)), ("c", T0 + timedelta(hours=7)), ("old", T0 - timedelta(days=9))],
        [("c", T0 + timedelta(hours=8)), ("d", T0 + timedelta(days=9))],
        [("d", T0 + timedelta(days=9)), ("a", T0 + timedelta(days=9))],
    ]
    kept = []
    for rows in parts:  # each drain is a restart on the checkpoint of the one before
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        fresh = incremental.fresh_only(incremental.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "id", "ts", "1 day")
        incremental.drain(fresh, lambda df, _: kept.append(sorted(r["id"] for r in df.collect())), str(tmp_path / "c"))
    found = [x for batch in kept for x in batch]
    # Rows later than the watermark are gone; an identity comes back once its time is over.
    assert found.count("b") == found.count("c") == found.count("d") == 1 and found.count("a") == 2 and "old" not in found


def test_watermark_reset(spark):
    df = spark.createDataFrame([(T0 - timedelta(days=d),) for d in range(1, 12)], "ts timestamp")
    now = "2024-01-01 00:00:00"
    for bad in (None, "", "no time"):
        assert incremental.since(df, "ts", bad, now)[0].count() == 6
    assert incremental.since(df, "ts", "2023-12-30 00:00:00", now)[0].count() == 1


# --- answers of language models ----------------------------------------------------


def test_ranked_answers(spark):
    good = [{"index": 1, "score": 140, "matching_skills": ["a"], "missing_skills": None, "reason": "r"}, {"score": -3}, {}]
    raws = [
        ("plain", json.dumps(good)), ("fence", "```json\n" + json.dumps(good) + "\n```  "), ("open", " ```\n" + json.dumps(good[:1])), ("cut", json.dumps(good)[:-4]),
        ("object", '{"index": 1}'), ("number", "[1]"), ("text", '[{"score": "80"}]'), ("null", None), ("empty", ""), ("none", "[]"), ("fence only", "```"), ("float", '[{"index": 0, "score": 55.5}]'),
    ]
    df = spark.createDataFrame([(k, r, 2) for k, r in raws], "k string, raw string, n int")
    got = {}
    for r in A.ranked_answers(df, "raw", "n", ["k"]).collect():
        got.setdefault(r["k"], []).append((r["index"], r["score"], r["matching_skills"], r["missing_skills"], r["reason"], r["fallback"]))
    whole = [(0, 0.0, [], [], "", False), (0, 0.0, [], [], "", False), (1, 100.0, ["a"], [], "r", False)]
    assert sorted(got["plain"]) == whole == sorted(got["fence"]) and got["open"] == whole[2:] and got["float"] == [(0, 55.5, [], [], "", False)]
    for k in ("cut", "object", "number", "text", "null", "empty", "fence only"):
        assert sorted(got[k]) == [(0, 0.0, [], [], "", True), (1, 0.0, [], [], "", True)], k
    assert "none" not in got


def test_answer_maps(spark):
    cases = [
        ('Sure: {"0": "A", "1": " b\\"c "} done', {"0": "A", "1": ' b"c '}), ('{"0": "A\\u00e9", "1": "B", "2": "cu', {"0": "Aé", "1": "B"}), ('```json\n{"0": 5}\n```', {"0": "5"}),
        ("nothing", None), (None, None), ('{"0": "x", "0": "y", "1": ', {"0": "y"}), ('{"0": "bad \\q", ', {"0": "bad \\q"}), ("", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", A.answer_map(F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    rows = spark.createDataFrame([("k", '{"0": " A ", "2": " "}', ["a", "b", "c"])], "k string, raw string, asked array<string>")
    assert [(r["asked"], r["answer"]) for r in A.answers_by_number(rows, "raw", "asked", ["k"]).orderBy("place").collect()] == [("a", "A"), ("b", None), ("c", None)]


def test_asked_once(spark):
    asked, again = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    sizes = spark.sparkContext.accumulator(0)

    def first(texts):
        asked.add(len(texts))
        sizes.add(1 if len(texts) > 5 else 0)
        if "down" in texts:
            raise ConnectionError
        return [None if t.startswith("odd") else t.upper() for t in texts]

    def second(texts):
        return [f"second {t}" for t in texts][:-1]  # answers short

    def retry(texts):
        again.add(len(texts))
        return [" " if t == "odd one" else f"again {t}" for t in texts]

    questions = ["hot"] * 500 + [f"q{i}" for i in range(30)] + ["odd one", "odd two", "down", "kept", "expired", None, ""]
    requests = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "id int, q string")
    cache = spark.createDataFrame([("kept", "K", T0 + timedelta(1)), ("expired", "E", T0 - timedelta(1)), ("other", "O", T0 + timedelta(2))], "q string, answer string, expires_at timestamp")
    cache = cache.select(F.md5("q").alias("key"), "answer", "expires_at")
    out, after = ask_once.ask_once(requests, "q", cache, F.lit(T0), 3600, [first, second], [retry], batch=5, lanes=2)
    got = {r["q"]: (r["answer"], r["answered_by"]) for r in out.collect()}
    distinct = {q for q in questions if q} - {"kept"}
    assert asked.value == len(distinct) and sizes.value == 0
    assert out.count() == len(questions) and got["kept"] == ("K", "cache") and got[None] == got[""] == (None, "none")
    assert got["odd one"] == (None, "none") and got["odd two"][0] in ("again odd two", "second odd two")
    assert all(got[q][1] in ("first", "retry") for q in distinct - {"odd one"}) or got["odd one"][1] == "first"
    assert got["hot"][0] in ("HOT", "second hot", "again hot")
    kept = {r["answer"] for r in after.collect()}
    assert {"K", "O"} <= kept and "E" not in kept
    before = asked.value
    again_out, _ = ask_once.ask_once(requests, "q", after, F.lit(T0), 3600, [first, second], [retry], batch=5, lanes=2)
    assert again_out.where("answered_by = 'cache'").count() >= 530 and asked.value - before <= 1


def test_rejoined(spark):
    rows = [("u", i, float(100 - i)) for i in range(6)] + [("v", 9, 1.0)]
    m = spark.createDataFrame(rows, "user_id string, job int, score_final double")
    head = spark.createDataFrame([("u", 0, 97.0), ("u", 1, 10.0)], m.schema)
    got = models.rejoined(m, head, "user_id", ["user_id", "job"], [F.desc("score_final"), F.asc("job")])
    # Of equal scores, the one that was first before: 0 before 3.
    assert [r["job"] for r in got.where("user_id = 'u'").orderBy("rank").collect()] == [2, 0, 3, 4, 5, 1] and got.count() == 7


def test_suggestions_of_both_types(spark):
    rows = [("u", "Sales Manager", ["B2B", "b2b ", f"t{i}"], True) for i in range(4)] + [("u", "Cook", ["food"], False), ("v", "Sales", ["B2B"], True)] + [("u", "Sales", ["B2B"], False)]
    df = spark.createDataFrame(rows, "g string, title string, tags array<string>, r boolean")
    got = [(r["g"], r["type"], r["pattern"], r["rejected"], r["total"]) for r in patterns.suggestions(df, "title", "tags", "r", ["g"]).orderBy("rank").collect()]
    assert got == [
        ("u", "title_pattern", "manager", 4, 4), ("u", "title_pattern", "sales manager", 4, 4), ("u", "title_pattern", "sales", 4, 5), ("u", "tag_category", "b2b", 4, 5),
    ]


# --- dumps and pages ---------------------------------------------------------------


def test_dumps(spark, tmp_path):
    rows = [(f"k{i}", f, i) for i in range(450) for f in (("a", "b") if i % 2 else ("a",))]
    path = str(tmp_path / "dump")
    dumps.land(spark.createDataFrame(rows, "id string, facet string, n long"), path, "id", "facet", 8, 20)
    (tmp_path / "dump" / "bucket=3" / "bad.txt").write_text('not json\n{"hits": {"hits": []}}\n{"hits": 5}\n{"hits": {"hits": [{"_id": " "}, {"_source": {"n": 1}}]}}\n')
    everything = dumps.read_dump(spark, path, 8, "n long")
    assert sorted((r["_id"], r["n"]) for r in everything.collect()) == sorted((f"k{i}", i) for i in range(450))
    for keys in (["k7"], ["k7", "k8", "none"], ["none"]):
        one = dumps.read_dump(spark, path, 8, "n long", keys)
        assert sorted(r["n"] for r in one.collect()) == [i for i in (7, 8) if f"k{i}" in keys]
    reader = dumps._DumpReader(path, 8)
    assert len(reader.partitions()) > 8
    assert list(reader.pushFilters([dumps.EqualTo(("_id",), "k7"), dumps.EqualTo(("n",), 3)])) == [dumps.EqualTo(("n",), 3)]
    assert {p.path.split("bucket=")[1][0] for p in reader.partitions()} == {str(dumps.bucket_of("k7", 8))}


def test_script_literals(spark):
    html = '<script>a = {bad}; window.S = {"items": [{"id": 1, "t": "}"}]}; var t="x</p>"; window.S = 7; b = [1, 2</script>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    got = [(r["page_id"], r["pos"], r["literal"]) for r in readers.script_literals(pages, r"window\.S\s*=|var t=|[ab] =").orderBy("pos").collect()]
    assert got == [(1, 0, '{"items": [{"id": 1, "t": "}"}]}'), (1, 1, '"x</p>"'), (1, 2, "7")]
    assert list(readers.literals("x = " + "[" * 100_000, "x =")) == []


def test_details(spark):
    stubs = spark.createDataFrame([("u1", "T1", 5), ("u2", "T2", 6), (None, "T3", 7)], "url string, title string, pay int")
    details = spark.createDataFrame([("u1", {"title": "Better", "pay": None}), ("u1", {"title": "Fewer"}), ("u9", {"title": "x"})], "url string, fields map<string,string>")
    got = sorted(map(tuple, readers.with_details(stubs, details, "url").collect()), key=lambda r: r[1])
    assert got == [("u1", "Better", None), ("u2", "T2", 6), (None, "T3", 7)] or sorted(got, key=str) == sorted([("u1", "Better", None), ("u2", "T2", 6), (None, "T3", 7)], key=str)


# --- stored full-text index --------------------------------------------------------


def test_text_index(spark, tmp_path):
    rnd = random.Random(5)
    words = ["the", "The", "of", "Écrit", "x1", "rare", "a_b", "der", "koch"]
    weights = [30, 5, 9, 4, 3, 1, 2, 6, 4]
    texts = {i: rnd.choice([None, "", ", ".join(rnd.choices(words, weights, k=rnd.randint(1, 60)))]) if i % 9 == 0 else " ".join(rnd.choices(words, weights, k=rnd.randint(1, 60))) for i in range(300)}
    index = fulltext.TextIndex(spark, str(tmp_path / "ix"))
    assert index.containing("the").count() == 0 and index.ranked("the", 3).count() == 0
    frame = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], "id long, t string")
    index.add(frame(range(200)), "id", "t")
    for i in range(150, 180):
        texts[i] = "koch koch rare"
    index.add(frame(range(150, 300)), "id", "t")  # 150 to 199 come again, some changed

    def counts(t, query):
        own = [w.lower() for w in (t or "").replace(",", " ").split()]
        return [own.count(w) for w in query], len(own)

    for query in ("the", "The OF", "rare koch", "écrit", "x1 the der", "absent the", "koch absent"):
        asked = query.lower().split()
        want = sorted((i, sum(n)) for i, t in texts.items() for n, _ in [counts(t, asked)] if all(n))
        assert sorted(map(tuple, index.containing(query).collect())) == want
        ranks = [(round(sum(n) / (1 + math.log(size + 1)), 6), i) for i, t in texts.items() for n, size in [counts(t, asked)] if sum(n)]
        for k in (1, 7, 40, 1000):
            first = sorted(ranks, key=lambda x: (-x[0], x[1]))[:k]
            got = [(r["rank"], r["id"]) for r in index.ranked(query, k).orderBy(F.desc("rank"), "id").collect()]
            assert [i for _, i in got] == [i for _, i in first] and all(abs(a[0] - b[0]) < 2e-6 for a, b in zip(got, first)), (query, k)
    assert index.containing(" ,").count() == 300
    plan = index.containing("the")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    assert fulltext.level_of(1.0) == 0 and fulltext.level_of(0.9) == 0 and fulltext.level_of(0.0) > 1000


def test_index_is_found_again(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string").write.parquet(str(tmp_path / "t"))
    docs = lambda: spark.read.parquet(str(tmp_path / "t"))
    first = fulltext.index_of(spark, str(tmp_path / "home"), docs(), "id", "t")
    assert fulltext.index_of(spark, str(tmp_path / "home"), docs(), "id", "t").path == first.path and len(first.generations()) == 1
    spark.createDataFrame([(3, "b")], "id long, t string").write.mode("append").parquet(str(tmp_path / "t"))
    again = fulltext.index_of(spark, str(tmp_path / "home"), docs(), "id", "t")
    assert again.path != first.path and again.containing("b").count() == 2 and first.containing("b").count() == 1


# --- calendars, mails, letters -----------------------------------------------------


def test_calendars_mails_and_letters(spark):
    m = spark.createDataFrame([("h1", T0, "School; A", "Cook", None), ("h2", T0, "B", "Chef", "/u")], "hash string, made timestamp, place string, title string, url string")
    events = sinks.application_events(m, "hash", "made", "place", "title", "url", "Apply", "Follow up", "Any answer?")
    assert events.count() == 4
    files = {r["hash"]: r["value"] for r in sinks.calendar_files(events, "hash", F.lit(T0), "-//x//", "own").collect()}
    lines = files["h1"].split("\r\n")
    assert lines[:2] == ["BEGIN:VCALENDAR", "VERSION:2.0"] and lines[-2:] == ["END:VCALENDAR", ""] and lines.count("BEGIN:VEVENT") == 2
    assert lines.index("UID:apply-h1@own") < lines.index("UID:followup-h1@own") and "SUMMARY:Apply — School\\; A" in lines and "URL:" in lines
    assert "DTSTART:20240103T000000Z" in lines and "DTEND:20240103T003000Z" in lines and "DTSTART:20240115T000000Z" in lines
    jobs = spark.createDataFrame([("u", 1, "A & B", None, "", "Bern", "/1"), ("u", 2, None, "Co", "ZH", "x", None), ("v", 3, "C", "", None, None, "/3")], "user string, n int, title string, company string, canton string, location string, url string")
    mails = {r["user"]: r for r in sinks.alert_mails(jobs, "user", "New:", "one", "{n} of them", ["n"]).collect()}
    assert mails["u"]["subject"] == "2 of them" and mails["v"]["subject"] == "one"
    assert mails["u"]["text"] == "New:\n\n- A & B · — · Bern\n  /1\n-  · Co · ZH\n  "
    assert mails["v"]["html"] == '<p>New:</p><ul><li><strong>C</strong> — — (—)<br><a href="/3">/3</a></li></ul>' and "A &amp; B" in mails["u"]["html"]
    letter = jobs.select(X.filled("To {place}: {title} {{x}", {"place": F.col("location"), "title": F.col("title"), "x": F.lit("{n}")}).alias("t"))
    assert sorted(r["t"] for r in letter.collect())[0] == "To : C {{n}"
    with pytest.raises(ValueError, match="absent"):
        X.filled("{absent}", {})


def test_category_bypass(spark):
    df = spark.createDataFrame([("H", "listed_a", True), ("H", "listed_a", False), ("H", None, True), (None, "listed_a", None), ("A", "x", True)], "c string, s string, on boolean")
    assert [r[0] for r in df.select(E.category_times(F.col("c"), F.col("s"), F.col("on"), "listed_")).collect()] == [1.0, 0.15, 0.15, 0.55, 1.0]


def test_source_query_spans_title_and_description(spark):
    df = spark.createDataFrame([(1, "Head", "cook"), (2, "x", "head cook"), (3, "head", None), (4, None, "Head Cook now")], "i int, t string, d string")
    assert sorted(r["i"] for r in views.query_matches(df, "HEAD COOK", ["t", "d"]).collect()) == [1, 2, 4]


def test_chained_run_beyond_a_day_of_seconds(spark, sf_dir, tmp_path):
    """Documents numbered past 86,400: the oldest of a tag is still the last one."""
    ids = spark.range(86_330, 86_480).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    ids.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t in ("documents", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(catalogue.SQL["chained_run"]).fetchall()
    assert sorted(map(tuple, stored_queries.chained_run(spark, str(tmp_path)).collect())) == sorted(want) and want
