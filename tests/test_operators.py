"""Duplicates, merges, sources, sinks and streams on small frames."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from sievework.operators import dedup, lifecycle, matching, merge, models, patterns, search, watchlist
from sievework.operators.dedup import stored_duplicates
from sievework.plans.pipelines import ingest
from sievework.schema import POSTING
from sievework.sources import readers, sinks
from sievework.storage import Snapshots
from sievework.streaming import incremental

T0 = datetime(2024, 1, 1)


def test_fuzzy_equals_sequential(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("abcdef"), rnd.choice("xyz")) for i in range(300)]
    first, want = {}, {}
    for i, k, s in rows:
        c = first.setdefault(k, (s, i))
        want[i] = c[1] if c[0] != s else None
    df = spark.createDataFrame(rows, "id long, key string, source string")
    got = dedup.fuzzy_duplicates(df, "key", "source", [F.col("id")], "id").collect()
    assert {r["id"]: r["duplicate_of"] for r in got} == want


def test_semantic_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 6)).astype(np.float32)
    v[40:50] = v[:10] + 0.01
    df = spark.createDataFrame([(i, [float(y) for y in x], 60 - i) for i, x in enumerate(v)], "id long, v array<float>, age int")
    u = v.astype(float) / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i in range(60):
        older = [j for j in range(59, i, -1) if u[i] @ u[j] > 0.9]
        if older:
            want[i] = older[0]
    for size in (7, 1000):
        got = dedup.semantic_duplicates(df, 0.9, "id", "v", "age", size).collect()
        assert {r[0]: r[1] for r in got} == want


def test_drop_repeats(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string")
    assert dedup.drop_repeats(df, "k").count() == 3


def test_merge_results(spark):
    s = "user_id string, job_hash string, score_final double, feedback string, application_status string, draft_letter string"
    old = spark.createDataFrame([("u", "aaa", 50.0, "up", "detected", None), ("u", "bbb", 10.0, None, "applied", None), ("u", "ccc", 5.0, None, "detected", None)], s)
    new = spark.createDataFrame([("u", "aaa", 77.0, None, None, None), ("u", "ddd", 60.0, None, None, None)], s)
    got = {r["job_hash"]: (r["score_final"], r["feedback"]) for r in merge.merge_results(old, new, ["user_id", "job_hash"], ["score_final"]).collect()}
    assert got == {"aaa": (77.0, "up"), "bbb": (10.0, None), "ddd": (60.0, None)}
    got = merge.merge_results(old, new.limit(0), ["user_id", "job_hash"], ["score_final"])
    assert {r["job_hash"] for r in got.collect()} == {"aaa", "bbb"}


def test_review(spark):
    s = spark.createDataFrame([(1, "u", "tag_category", " Sales", "pending"), (2, "u", "title_pattern", "koch", "approved")], "id int, user_id string, suggestion_type string, pattern string, status string")
    out, filters = merge.review(s, spark.createDataFrame([(1, "approved"), (2, "rejected")], "id int, decision string"))
    assert {r["id"]: r["status"] for r in out.collect()} == {1: "approved", 2: "approved"}
    assert [(r["filter_type"], r["pattern"]) for r in filters.collect()] == [("tag_contains", "sales")]


def test_cursor_window_and_streak(spark):
    df = spark.createDataFrame([("s", x, i) for i, x in enumerate(["a", "b", "b", "c", "d"])], "k string, i string, p int")
    assert lifecycle.recent_identities(df, ["k"], "i", "p", 3).first()["recent"] == ["a", "b", "c"]
    runs = spark.createDataFrame([("s", i, n) for i, n in enumerate([3, 0, 0])], "k string, r int, n int")
    assert lifecycle.empty_streak(runs, ["k"], ["r"], "n").first()["streak"] == 2
    # 0.9, 0.63, 0.44: averages start at 0.
    assert lifecycle.ema(runs, ["k"], ["r"], "n").first()["ema"] == 0.44
    assert lifecycle.ema(spark.createDataFrame([("s", 1, 100)], "k string, r int, n int"), ["k"], ["r"], "n").first()["ema"] == 30.0


def test_suggestions(spark):
    rows = [("u", "Sales Manager", True)] * 3 + [("u", "Cook", False), ("u", "Cook", True)]
    counts = patterns.ngram_counts(spark.createDataFrame(rows, "g string, t string, r boolean"), "t", "r", ["g"])
    got = [r["pattern"] for r in patterns.title_suggestions(counts, ["g"]).collect()]
    assert sorted(got) == ["manager", "sales", "sales manager"]
    some = patterns.samples(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "i int, t string, r boolean"), "t", "r", "i", counts.where("pattern = 'sales'"), 2)
    assert some.first()["samples"] == ["Sales Manager"] * 2


def test_search(spark):
    rows = [dict(hash=str(i), source="a", title=f"Cook {i}", company="c", url="u", is_active=i != 3, salary_max_chf=i or None, seniority="intern" if i == 4 else None, last_seen_at=T0 + timedelta(i)) for i in range(6)]
    jobs = spark.createDataFrame([tuple(r.get(n) for n in POSTING.names) for r in rows], POSTING)
    page, total = search.search(jobs, search.SearchParams(q="cook", sort="salary", limit=2))
    assert [r["hash"] for r in page.collect()] == ["5", "2"] and tuple(total.first()) == (4, True)
    page, _ = search.search(jobs, search.SearchParams(q="cook 1", sort="relevance"))
    assert [r["hash"] for r in page.collect()] == ["1"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"title": "T", "org": {"name": "C"}, "link": "u"}, {"title": None}]}))
    got = readers.read_json(spark, str(tmp_path / "a.json"), "data array<struct<title:string,org:struct<name:string>,link:string>>", {"title": F.col("title"), "company": F.col("org.name"), "url": F.col("link")}, "data")
    assert [(r["title"], r["company"]) for r in got.collect()] == [("T", "C"), (None, None)]
    (tmp_path / "d.json").write_text(json.dumps({"hits": {"hits": [{"_id": "1", "_source": {"t": "x"}}, {"_id": "1", "_source": {"t": "x"}}]}}))
    assert readers.read_search_dump(spark, str(tmp_path / "d.json"), "struct<t:string>", {"title": F.col("t")}).count() == 1
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>l</link></item><item><title>B</title><link>m</link></item></channel></rss>")
    assert {r["title"] for r in readers.read_feed(spark, str(tmp_path / "f.xml"), {"title": F.col("title"), "url": F.col("link")}).collect()} == {"A", "B"}
    html = '<div class="card"><a href="/1">One <b>job</b></a><span class="place">Bern</span></div><div class="card"><a href="/2">Two</a></div><script>x = {bad}; window.STATE = {"items": [{"id": 1}]};</script>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    cards = readers.html_cards(pages, "card").orderBy("pos").collect()
    assert [(r["url"], r["title"], r["fields"].get("place")) for r in cards] == [("/1", "One job", "Bern"), ("/2", "Two", None)]
    states = readers.html_state(pages, r"STATE\s*=", "items array<struct<id:int>>").orderBy("page_id").collect()
    assert states[0]["state"]["items"][0]["id"] == 1 and states[1]["state"] is None
    reg = readers.Registry()
    reg.add("x", lambda s: got.drop("source"))
    reg.add("y", lambda s: got, needs=("key",))
    assert reg.active({}) == ["x"] and reg.load(spark, {})[0].count() == 0


def test_sinks(spark):
    ev = spark.createDataFrame([("u", i, T0 + timedelta(minutes=i)) for i in range(11)], "user string, id int, ts timestamp")
    assert {r["id"] for r in sinks.bounded_queue(ev, "user", "ts", "id", 10).collect()} == set(range(1, 11))
    assert "SUMMARY:a\\,b" in sinks.calendar(spark.createDataFrame([("1", T0, "a,b")], "i string, d timestamp, s string"), "i", "d", "s").first()[0]
    ask = spark.createDataFrame([("a",), ("b",)], "q string")
    cache = spark.createDataFrame([("a", T0)], "q string, stored_at timestamp").select(F.md5("q").alias("key"), F.lit("v").alias("value"), "stored_at")
    hit, miss = sinks.cached(ask, cache, F.col("q"), F.lit(T0 + timedelta(hours=1)), 7200)
    assert [r["q"] for r in hit.collect()] == ["a"] and [r["q"] for r in miss.collect()] == ["b"]


def test_ingest(spark):
    def job(**k):
        return tuple({"company": "Acme", "url": k["title"] + k["source"], **k}.get(n) for n in POSTING.names)

    raw = spark.createDataFrame([job(source="a", title="Senior Cook"), job(source="b", title="Cook"), job(source="a", title="Sales blocked"), job(source="a", title="")], POSTING)
    jobs, bad = ingest(raw, spark.createDataFrame([], POSTING), F.lit(T0), ["blocked"])
    got = jobs.collect()
    assert len(got) == 2 and sum(r["duplicate_of"] is not None for r in got) == 1 and bad.count() == 1


def test_streams(spark, tmp_path):
    schema = incremental.RUN
    runs = [[("s", "x", T0, ["b", "a", ""], 10, 2), ("t", "x", T0, None, 0, 1)], [("s", "x", T0 + timedelta(2), ["d", "b"], 0, 1), ("s", "x", T0 + timedelta(1), ["c", "c"], 0, None)], [("s", "y", T0, ["q"], 1, 1)]]
    table = Snapshots(spark, str(tmp_path / "cursors"), incremental.CURSOR_OUT)
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.run_cursors(incremental.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), table, str(tmp_path / "c1"), 3)
    last = {(r["source_key"], r["scope_key"]): r for r in table.current().collect()}
    s = last["s", "x"]
    assert s["recent_identities"] == ["d", "b", "c"] and (s["runs"], s["consecutive_empty_runs"]) == (3, 2)
    assert (s["avg_new_jobs_per_run"], s["avg_pages_per_run"]) == (1.47, 0.59) and s["last_empty_at"] == T0 + timedelta(2)
    assert last["t", "x"]["consecutive_empty_runs"] == 1 and last["t", "x"]["recent_identities"] == [] and last["s", "y"]["avg_new_jobs_per_run"] == 0.3
    assert table.commits().count() == 3
    total = []
    for _ in range(2):  # the second run finds nothing new
        incremental.drain(incremental.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), lambda df, _: total.append(df.count()), str(tmp_path / "c2"))
    assert sum(total) == 5
    calls = spark.createDataFrame([("k", T0 + timedelta(seconds=i), True) for i in range(5)] + [("k", T0 + timedelta(seconds=90), False)], "k string, t timestamp, bad boolean")
    assert incremental.breaker(calls, "k", "t", "bad").first()["state"] == "closed"
    assert incremental.breaker(calls.where("bad"), "k", "t", "bad").first()["state"] == "open"


def test_watchlist(spark):
    df = spark.createDataFrame([("Primary Teacher", ["x"], "H"), ("Teacher", None, "H"), ("Primary", [], "A")], "t string, g array<string>, c string")
    assert [r[0] for r in df.select(watchlist.has_marker(F.col("t"), F.col("g"), F.col("c"), ["primary"])).collect()] == [True, False, False]
    rows = [("detected", None, True), ("applied", None, True), ("reviewed", "offer", False), ("detected", "odd", False)]
    df = spark.createDataFrame(rows, "s string, w string, d boolean")
    assert [r[0] for r in df.select(watchlist.advance(F.col("s"), F.col("w"), F.col("d"))).collect()] == ["drafted", "applied", "offer", "detected"]
    s = spark.createDataFrame([(1, {}, None, "daily", 2, True)], "id int, filters map<string,string>, last_run_at timestamp, notify_frequency string, total_matches int, is_active boolean")
    done = watchlist.after_run(s, spark.createDataFrame([(1, "a"), (1, "b")], "search_id int, hash string"), F.lit(T0)).first()
    assert done["total_matches"] == 4 and done["last_run_at"] == T0
    f = spark.createDataFrame([(" Sales ",), (" ",)], "pattern string")
    assert [r["pattern"] for r in watchlist.new_filter(f).collect()] == ["sales"]
    users = {"a": spark.createDataFrame([("u", 1), ("v", 2), (None, 3)], "user_id string, x int")}
    assert merge.erase_user(users, "u")["a"].count() == 2 and merge.export_user(users, "u")["a"].count() == 1


def test_user_filters_alike_at_every_size(spark):
    rows = [(1, "Ring Bearer", ["a"]), (2, "plain", ["b", "c"]), (3, "plain", None), (4, None, ["a"]), (5, "50% off", ["c"]), (6, "plain", []), (7, "plain", ["a", None]), (8, "red", ["B"])]
    jobs = spark.createDataFrame(rows, "id int, title string, tags array<string>")
    both = [("title_contains", "RING", True), ("title_contains", "0%", True), ("tag_contains", "b", True), ("title_contains", "plain", False), ("tag_contains", None, True)]
    for active, want in ((both, [3, 6, 8]), (both[2:], [1, 3, 4, 5, 6, 8]), (both[:2], [2, 3, 6, 7, 8]), (both[3:], [1, 2, 3, 4, 5, 6, 7, 8])):
        filters = spark.createDataFrame(active, "filter_type string, pattern string, is_active boolean")
        for limit in (10_000, 0):
            assert sorted(r["id"] for r in matching.without_user_filters(jobs, filters, limit=limit).collect()) == want, limit
        assert [r["id"] for r in matching.without_user_filters(jobs, filters, tags=None, limit=0).orderBy("id").collect()] == [
            r["id"] for r in matching.without_user_filters(jobs, filters, tags=None).orderBy("id").collect()
        ]


def test_stored_duplicates(spark):
    schema = "hash string, source string, fuzzy_hash string, first_seen_at int, is_active boolean"
    old = spark.createDataFrame([("a", "s1", "f", 1, True), ("b", "s1", "g", 1, False), ("c", "s1", "h", 5, True)], schema)
    new = spark.createDataFrame([("n1", "s2", "f", 0, True), ("n2", "s1", "f", 9, True), ("n3", "s2", "g", 9, True), ("n4", "s3", "g", 10, True), ("c", "s1", "h", 7, True), ("n5", "s9", None, 1, True)], schema)
    got = {r["hash"]: r["duplicate_of"] for r in stored_duplicates(new, old).collect()}
    assert got == {"n1": "a", "n2": None, "n3": None, "n4": "n3", "c": None, "n5": None}
    # Two sources are stored: a row of the older one is a copy of the other's.
    both = spark.createDataFrame([("A1", "a", "f", 1, True), ("B1", "b", "f", 2, True)], schema)
    new = spark.createDataFrame([("A2", "a", "f", 3, True), ("B2", "b", "f", 4, True), ("C2", "c", "f", 5, True)], schema)
    assert {r["hash"]: r["duplicate_of"] for r in stored_duplicates(new, both).collect()} == {"A2": "B1", "B2": "A1", "C2": "A1"}


def test_stored_duplicates_equal_sequential(spark):
    rnd = random.Random(11)
    old = [(f"o{i}", rnd.choice("abc"), rnd.choice("klmnop"), i, rnd.random() < 0.7) for i in range(25)]
    new = [(f"n{i}", rnd.choice("abcd"), rnd.choice("klmnopqr"), 100 + i, True) for i in range(80)]
    alive, want = [r for r in old if r[4]], {}
    for r in new:
        stored = [x for x in alive if x[2] == r[2]]
        first = next((x for x in stored if x[1] != r[1]), None)
        want[r[0]] = first[0] if first else None
        if first is None:
            alive.append(r)
    schema = "hash string, source string, fuzzy_hash string, first_seen_at int, is_active boolean"
    got = stored_duplicates(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema))
    assert {r["hash"]: r["duplicate_of"] for r in got.collect()} == want


def test_every_pair_alike_in_blocks(spark):
    jobs = spark.range(50).select(F.col("id").cast("string").alias("hash"))
    users = spark.range(23).select(F.col("id").cast("string").alias("user_id"))
    small, blocks = matching.every_pair(jobs, users), matching.every_pair(jobs, users, 4)
    assert "BroadcastNestedLoopJoin" not in blocks._jdf.queryExecution().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, blocks.collect())) and small.count() == 1150
    assert matching.every_pair(jobs, users.limit(0)).count() == 0


def test_saved_searches_equal_brute_force(spark):
    rnd = random.Random(4)
    now = datetime(2024, 1, 31)
    pick = lambda *v: rnd.choice((None, *v))
    jobs = [(str(i), pick("a", "b", "c"), pick("ZH", "BE"), pick("de", "en"), pick(True, False), now - timedelta(days=rnd.randint(0, 9)), rnd.random() < 0.8, pick("x") if rnd.random() < 0.2 else None) for i in range(300)]
    searches = []
    for i in range(80):
        asked = {"source": pick("a", "b, c", " ,a", " , "), "canton": pick("zh", "be,zh"), "language": pick("de", "fr", ""), "remote_only": pick("true", "false", "")}
        searches.append((i, {k: v for k, v in asked.items() if v is not None} if i % 9 else None, None if i % 4 == 0 else now - timedelta(days=rnd.randint(0, 8)), rnd.choice(["realtime", "daily", "weekly", "instant"]), i % 7 != 0))
    j = spark.createDataFrame(jobs, "hash string, source string, canton string, language string, remote boolean, last_seen_at timestamp, is_active boolean, duplicate_of string")
    s = spark.createDataFrame(searches, "id int, filters map<string,string>, last_run_at timestamp, notify_frequency string, is_active boolean")
    found = [tuple(r) for r in watchlist.run_saved_searches(s, j, F.lit(now)).collect()]
    want = set()
    wait = {"realtime": 300, "daily": 86_400, "weekly": 604_800}
    for i, f, ran, kind, active in searches:
        f = f or {}
        if not active or (ran is not None and (kind not in wait or (now - ran).total_seconds() < wait[kind])):
            continue
        listed = lambda k: [x.strip() for x in f.get(k, "").split(",") if x.strip()]  # noqa: E731, B023
        for h, source, canton, language, remote, seen, shown, copy in jobs:
            ok = shown and copy is None and (ran is None or seen >= ran)
            ok = ok and (not listed("source") or source in listed("source")) and (not listed("canton") or canton in [x.upper() for x in listed("canton")])
            if ok and (not f.get("language") or language == f["language"]) and (f.get("remote_only") != "true" or remote is True):
                want.add((i, h))
    assert set(found) == want and len(found) == len(want) and want
    assert watchlist.run_saved_searches(s.limit(0), j, F.lit(now)).count() == 0 and watchlist.run_saved_searches(s, j.limit(0), F.lit(now)).count() == 0


def test_embedded_awkward(spark):
    asked = []
    rows = [(1, None, None), (2, "ab", None), (3, "kept", [1.0, 0.0]), (4, "", None), (5, "ab", None)]
    df = spark.createDataFrame(rows, "id int, text string, embedding array<float>").coalesce(1)

    def model(texts):
        return [[len(t), len(t)] for t in texts]

    found = {r.id: r.embedding for r in models.embedded(df, F.col("text"), model, batch=2).collect()}
    assert found[1] is None and found[3] == [1.0, 0.0] and found[4] == [0.0, 0.0]
    assert found[2] == found[5] and abs(found[2][0] ** 2 + found[2][1] ** 2 - 1) < 1e-6
    assert models.embedded(df.limit(0), F.col("text"), model).count() == 0


def test_rerank_head_sizes(spark):
    rows = [("few", i) for i in range(150)] + [("many", i) for i in range(151)]
    head = models.rerank_head(spark.createDataFrame(rows, "user_id string, n int"), "user_id", [F.asc("n")])
    found = {}
    for r in head.collect():
        found.setdefault(r.user_id, []).append((r.n, r.batch, r.place))
    assert len(found["few"]) == 150
    assert sorted(found["many"]) == [(i, i // 10, i % 10) for i in range(50)]
