"""Merkle manifest against trees built level by level."""

import random
import zlib
from hashlib import sha256

import pytest
from helpers import corpus, frame
from pyspark.sql import functions as F

from sievework.llm import merkle
from sievework.llm.merkle import Forest, fold, merkle_manifest, row_digest, with_folded_root

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    """Root, and the siblings of every node, level by level."""
    paths, at = [""] * len(nodes), list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for k, place in enumerate(at):
            run = runs[place // arity]
            paths[k] += "".join(run[: place % arity] + run[place % arity + 1 :])
        at = [p // arity for p in at]
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows, arity=2):
    """{(id, leaf): (subroot, root, proof)}"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf_of((r[0], r[3], r[2], r[4], r[1]))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    parts = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        parts.append(tree([x[1] for x in groups[g]], arity))
    root, tops = tree([p[0] for p in parts], arity)
    return sorted((str(x[0]), x[1], sub, root, path + top) for g, (sub, paths), top in zip(order, parts, tops) for x, path in zip(groups[g], paths))


def manifest(df, arity=2):
    return merkle_manifest(df, row_digest([F.col(c) for c in FIELDS]), arity=arity, carried={"n": F.col("n_chars")})


def found(df):
    return sorted((str(r["doc_id"]), bytes(r["leaf"]).hex(), r["subroot"], r["root"], r["proof"]) for r in df.collect())


@pytest.fixture(scope="module")
def many():
    rnd = random.Random(5)
    langs = ["en"] * 12 + [None, "", "de", "ß", "zh", "z\U0001f600"]
    rows = [(rnd.choice([i, i, i, i // 2]), f"text {i} é" * rnd.randint(0, 3), rnd.choice(langs), rnd.choice(["a", None]), rnd.choice([i, None]), *[None] * 5) for i in range(1200)]
    return rows + [(77, "same", "en", "s", 1, *[None] * 5)] * 300 + [(None, None, "lone", None, None, *[None] * 5), (None, "x", None, None, 3, *[None] * 5)]


@pytest.mark.parametrize("arity", [2, 3, 7])
def test_equals_brute_force(spark, many, arity, monkeypatch):
    monkeypatch.setattr(merkle, "PIECE_BITS", 4)
    monkeypatch.setattr(merkle, "FAN_BITS", 1)
    assert found(manifest(frame(spark, many), arity)) == brute(many, arity)


def test_awkward(spark):
    rows = corpus()
    assert found(manifest(frame(spark))) == brute(rows)
    one = rows[10:11]
    got = manifest(frame(spark, one)).first()
    assert got["subroot"] == got["root"] == bytes(got["leaf"]).hex() and got["proof"] == "" and got["carried"]["n"] == one[0][4]
    assert manifest(frame(spark, [])).count() == 0


def test_folded_root(spark, many):
    done = with_folded_root(with_folded_root(manifest(frame(spark, many)), F.col("leaf")), F.expr("unhex(sha2('other', 256))"), "forged").collect()
    assert len(done) == len(many)
    assert all(r["folded_root"] == r["root"] != r["forged"] for r in done)
    assert with_folded_root(manifest(frame(spark, many[:9])), F.lit(None).cast("binary")).where("folded_root IS NOT NULL").count() == 0


def test_sums_in_any_order():
    """The sum of fragments is the same in any order and any bracketing."""
    rnd = random.Random(1)
    for arity in (2, 3, 5):
        sizes = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 9))]
        nodes = [(t, 0, i, n, sha256(f"{t} {i}".encode()).digest()) for t, n in enumerate(sizes) for i in range(n)]
        parts = [[tree([x[4].hex() for x in nodes if x[0] == t], arity)[0]] for t in range(len(sizes))]
        want = tree([p[0] for p in parts], arity)[0]
        rnd.shuffle(nodes)
        forests = []
        for at in range(0, len(nodes), 7):
            forests.append(Forest(len(sizes), arity))
            for t, lvl, i, n, d in nodes[at : at + 7]:
                forests[-1].add((t, lvl, i), d, n)
        while len(forests) > 1:
            a, b = forests.pop(rnd.randrange(len(forests))), forests.pop(rnd.randrange(len(forests)))
            for (t, lvl, i), d in b.open.items():
                a.add((t, lvl, i), d, b.counts[t][0])
            forests.append(a)
        assert [d.hex() for d in forests[0].open.values()] == [want]
    assert fold(b"x" * 32, "", 0, 1, 0, 1) == b"x" * 32


def test_query(spark, sf_dir):
    from sievework.llm.registry import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op11_merkle_manifest"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    want = {x[0]: x for x in brute([tuple(r) for r in rows])}
    assert len(got) == len(rows)
    for r in rows:
        g, w = got[r["doc_id"]], want[str(r["doc_id"])]
        assert (g["leaf"], g["subroot"], g["root"], g["proof_sha256"]) == (w[1], w[2], w[3], h(w[4]))
        assert g["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0 or r["n_chars"] is None) == (g["folded_root"] == g["root"])
