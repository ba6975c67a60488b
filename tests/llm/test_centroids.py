"""Centroid clustering against Python integers."""

import math
import random
from fractions import Fraction
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from sievework.llm.centroids import inertias, integers, limbs, lloyd, nearest
from sievework.llm.registry import QUERIES


def brute(rows, k, rounds, components, scale=64):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centroids)]
    return sorted((str(i), n, d if d < 2**63 else None) for i, v in kept for d, n in [near(v)]), [tuple(c) for c in centroids]


def result(spark, rows, kind="float", **args):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string, distance string").repartition(3)
    assigned, centroids = lloyd(df, **args)
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in assigned.collect()), centroids


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(i % 5, 1) for _ in range(8)]) for i in range(400)]
    rows += [(i, [0.25] * 8) for i in range(400, 460)] + [rows[3], rows[3], (None, [1.0] * 8), (901, None), (902, []), (903, [1.0] * 7), (904, [None] + [1.0] * 7)]
    rows += [(905, [math.nan] * 8), (906, [math.inf] + [0.0] * 7), (907, [-0.001] * 8)]
    rows = as_float(rows)
    got = result(spark, [(*r, "c", "d") for r in rows], k=6, rounds=3, components=8)
    assert got == brute(rows, 6, 3, 8)
    few = rows[:3]
    assert result(spark, [(*r, "c", "d") for r in few], k=6, rounds=2, components=8) == brute(few, 6, 2, 8)
    assert result(spark, [], k=6, components=8) == ([], [])
    assert result(spark, [(1, None, "c", "d")], k=6, components=8) == ([], [])


def test_large_components_stay_exact(spark):
    rows = as_float([(i, [(-1) ** i * 3e38, 1e20 + i, float(i)]) for i in range(20)] + [(i, [1.0, 2.0, i / 7]) for i in range(20, 40)])
    got = result(spark, [(*r, "c", "d") for r in rows], k=3, rounds=3, components=3)
    assert got == brute(rows, 3, 3, 3)
    doubles = [(i, [1.7e308, -1.5 * i]) for i in range(6)]
    assert result(spark, [(*r, "c", "d") for r in doubles], "double", k=2, rounds=1, components=2) == brute(doubles, 2, 1, 2)


def test_parts():
    for total in (0, 1, -1, 2**40, -(2**200) + 5, 10**30):
        assert sum(v << 40 * n for n, v in limbs(total)) == total
    rows = integers([[0.5, -0.01]], 64, 2)
    assert rows.tolist() == [[32, -1]] and [x.tolist() for x in nearest(rows, np.array([[30, -1], [34, -1]]))] == [[0], [4]]


def test_inertias(spark):
    df = spark.createDataFrame([(0, 5), (0, 7), (1, 2**62), (1, 2**62), (2, None), (2, 1)], "cluster int, distance long")
    assert {r["cluster"]: r["_inertia"] for r in inertias(df).collect()} == {0: 12, 1: 2**63, 2: None}


def test_query(spark, sf_dir):
    got = QUERIES["op13_centroid_clustering"](spark, sf_dir).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, centroids = brute(rows, 16, 3, 64)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == want
    for r in got:
        assert r["centroid_sha256"] == sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
        assert r["inertia"] == sum(w[2] for w in want) and r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
    assert QUERIES["op13_centroid_clustering"](spark, sf_dir).where(F.col("distance") < 0).count() == 0
