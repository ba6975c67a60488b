"""Exact, line, substring and near-duplicate removal against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from helpers import corpus, frame, lower
from pyspark.sql import functions as F

from sievework.llm import suffix_dedup as module
from sievework.llm.components import components
from sievework.llm.exact_dedup import exact_dedup
from sievework.llm.grouping_sa import common_prefixes, suffix_array
from sievework.llm.line_dedup import LineRuns, line_dedup, line_keys
from sievework.llm.ngram_join import jaccard_components
from sievework.llm.suffix_dedup import suffix_dedup


def test_exact(spark):
    rows = corpus()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    got = exact_dedup(frame(spark), heavy_parts=8, tracked=64).collect()
    assert len(got) == len(rows)
    kept = Counter()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    assert exact_dedup(frame(spark, [])).count() == 0


def brute_lines(rows, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: (lambda k: k if len(k) >= min_chars else None)(lower(x.strip(strip)))
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if key(x) and i is not None:
                held[key(x)].add(i)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and key(x) and len(held[key(x)]) >= min_docs and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_lines(spark, batches, fanout):
    rows = corpus()
    done = line_dedup(frame(spark), batches=batches, fanout=fanout)
    assert done.columns == [*frame(spark).columns, "line_result"]
    got = done.collect()
    want = brute_lines(rows)
    assert len(got) == len(rows) and sum(v[1] for v in want.values()) > 10
    for r in got:
        assert tuple(r["line_result"]) == want[r["doc_id"]]
    assert line_dedup(frame(spark, [])).count() == 0


def test_suffix_array():
    rnd = random.Random(2)
    for _ in range(3000):
        t = [rnd.randint(1, rnd.choice([1, 2, 4, 30])) for _ in range(rnd.randint(0, 30))] + [0]
        order = suffix_array(t)
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = common_prefixes(t, order)
        for r in range(1, len(t)):
            a, b = t[order[r - 1] :], t[order[r] :]
            assert lcp[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute_spans(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, kept))
    return out


@pytest.mark.parametrize("length", [64, 400])
def test_substrings(spark, length):
    rows = corpus()
    want = Counter((r[0], *w) for r, w in zip(rows, brute_spans([r[1] for r in rows], length)))
    done = suffix_dedup(frame(spark), length=length)
    got = Counter((r["doc_id"], r["suffix_result"]["n_bytes"], r["suffix_result"]["n_removed"], len(r["suffix_result"]["spans"]), bytes(r["suffix_result"]["kept"])) for r in done.collect())
    assert got == want and sum(w[2] > 0 and len(w[4]) > 0 for w in want) > 5
    assert suffix_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup(frame(spark), length=5)


def brute_components(rows, words, percent):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            n = len(sets[a] & sets[b])
            if None not in (i, j) and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((r[0], len(s), find(r[0]) if r[0] is not None else None) for r, s in zip(rows, sets))


@pytest.mark.parametrize("words,percent,block", [(3, 90, 512), (3, 90, 7), (5, 80, 512)])
def test_jaccard(spark, words, percent, block):
    rows = corpus()
    got = Counter(tuple(r) for r in jaccard_components(frame(spark), words, percent, block_rows=block).collect())
    want = brute_components(rows, words, percent)
    assert got == want and any(r[0] != r[2] for r in want)


def test_jaccard_empty(spark):
    assert jaccard_components(frame(spark, []), 3, 90).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["id"]: r["component"] for r in got} == {x: find(x) for x in linked}


def test_line_runs_hold_each_key_once(spark):
    rows = corpus()
    keys = line_keys(frame(spark), "text", "doc_id", 40).distinct().cache()
    runs, held = LineRuns(spark, fanout=2, buckets=3), set()
    for b in range(9):
        own = keys.where(F.col("_id") % 9 == b)
        runs.add(own)
        held |= {bytes(r["_key"]) for r in own.collect()}
        found = [bytes(r["_key"]) for run in runs.runs() for r in run.select("_key").collect()]
        assert len(found) == len(held) and set(found) == held
    assert [len(x) for x in runs.levels] == [1, 0, 0, 1]
    want = {bytes(r["_key"]): r["m"] for r in keys.groupBy("_key").agg(F.count("*").alias("n"), F.max("_id").alias("m")).where("n >= 5").collect()}
    assert {bytes(r["_key"]): r["keep_id"] for r in runs.frequent(5).collect()} == want != {}
    assert spark.catalog.listTables() == [] or not any(t.name.startswith("line_run") for t in spark.catalog.listTables())
    clash = frame(spark).withColumn("line_result", F.lit("old")).withColumn("_ld_drop", F.col("score"))
    got = line_dedup(clash, batches=2).collect()
    assert sorted(str(r["_ld_drop"]) for r in got) == sorted(str(r[9]) for r in rows) and all(r["line_result"] != "old" for r in got)


def test_colliding_hashes_remove_nothing_else(spark, monkeypatch):
    rows = corpus()
    right = {(r["doc_id"], r["text"]): r["suffix_result"] for r in suffix_dedup(frame(spark)).collect()}
    monkeypatch.setattr(module, "_same", lambda text: (F.lit(7).cast("long"), F.xxhash64(F.lit(1), text), F.octet_length(text)))
    clash = frame(spark).withColumn("suffix_result", F.lit("old")).withColumn("spans", F.col("score"))
    got = suffix_dedup(clash).collect()
    assert len(got) == len(rows) and sorted(str(r["spans"]) for r in got) == sorted(str(r[9]) for r in rows)
    whole = 0
    for r in got:
        want, have = right[r["doc_id"], r["text"]], r["suffix_result"]
        assert all(any(a["lo"] <= x["lo"] and x["hi"] <= a["hi"] for a in want["spans"]) for x in have["spans"])
        whole += have["n_removed"] == have["n_bytes"] > 0
    assert whole >= 3
