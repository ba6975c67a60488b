"""Toxicity by a chain of linear classifiers over word-stem features.

The labels hold one mark, toxic. The chain splits it in categories by how much of
a labelled text is toxic vocabulary: `dense` (at or above the median share of the
toxic rows), `sparse` (below it), then `toxic` itself. Each category has a linear
model over the presence of words and word beginnings; the models of later
categories also see the probabilities of the earlier ones. In training those are
out-of-fold predictions, so a later model learns from inputs as good as it will
meet: the model of a fold sees no label of that fold, neither in its weights nor in
its choice of features nor in its split of the categories. Features are picked by
their information about the label, counted in Spark over the sampled labelled rows;
scoring reads every document and its whole text.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored, table

#: Labelled rows that a fit takes at most, and features that a model has at most.
MAX_ROWS = 12_000
MAX_FEATURES = 2048
FOLDS = 5
#: Natural logarithm that is added to that of the number of features tried, for the
#: evidence a feature needs. Held out, sf0.1: recall 0.86 at 0, 0.88 at -6, 3 of 870 clean texts flagged at both.
EVIDENCE = -4.0
#: Times the base rate's odds of being toxic that a feature's own odds must exceed.
MIN_LIFT = 2.0
STEMS = (4, 5, 6)
CATEGORIES = ("dense", "sparse", "toxic")
MEMO_WORDS = 200_000
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """64-bit keys of the word and of its beginnings."""
    keys = [xxhash.xxh3_64_intdigest(b"w" + word.encode())]
    keys += [xxhash.xxh3_64_intdigest(b"%d" % k + word[:k].encode()) for k in STEMS if len(word) > k]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _train(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, width: int, steps: int = 150, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on sparse presence rows and dense extra columns, by
    full-batch gradient with momentum-scaled steps (Adam). Weights: features,
    extra columns, intercept."""
    n, k = len(y), extra.shape[1]
    w = np.zeros(width + k + 1)
    if n == 0 or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)) if n else -np.log(9)
        return w
    flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[-1] + extra @ w[width : width + k] + np.bincount(owner, w[flat], n)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate([np.bincount(flat, d[owner], width), extra.T @ d, [d.sum()]])
        g[:-1] += ridge * w[:-1] / np.sqrt(n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _apply(w: np.ndarray, rows: list[np.ndarray], extra: np.ndarray, width: int) -> np.ndarray:
    k = extra.shape[1]
    z = w[-1] + extra @ w[width : width + k]
    if rows:
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate(rows).astype(np.int64)
        z = z + np.bincount(owner, w[flat], len(rows))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(views: list[tuple[list[np.ndarray], np.ndarray]], fold: np.ndarray, width: int) -> list[np.ndarray]:
    """One weight vector for each category, in order. A view is (feature rows, marks
    by category) of all rows; view f is as seen without fold f, the last without
    none. The inputs that a model gets from those before it are out-of-fold."""
    rows, marks = views[-1]
    seen, chain = np.zeros((len(rows), 0)), []
    for c in range(marks.shape[1]):
        ahead = np.zeros(len(rows))
        for f, (own, own_marks) in enumerate(views[:-1]):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = _train([own[i] for i in inside], seen[inside], own_marks[inside, c].astype(float), width)
            ahead[outside] = _apply(part, [own[i] for i in outside], seen[outside], width)
        chain.append(_train(rows, seen, marks[:, c].astype(float), width))
        seen = np.column_stack([seen, ahead])
    return chain


def apply_chain(chain: list[np.ndarray], rows: list[np.ndarray], width: int) -> np.ndarray:
    seen = np.zeros((len(rows), 0))
    for w in chain:
        seen = np.column_stack([seen, _apply(w, rows, seen, width)])
    return seen


class ToxicModel:
    """Feature keys, the chain over them, and a bounded memo of words."""

    def __init__(self, keys: list[int], chain: list[np.ndarray]):
        self.index, self.chain, self.memo = {k: i for i, k in enumerate(keys)}, chain, {}

    def row(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        memo = self.memo
        for w in set(_WORD.findall((text or "").lower())):
            hit = memo.get(w)
            if hit is None:
                hit = tuple(self.index[k] for k in word_features(w) if k in self.index)
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                memo[w] = hit
            if hit:
                found.update(hit)
        return np.array(sorted(found), np.int64)

    def scores(self, texts) -> np.ndarray:
        return apply_chain(self.chain, [self.row(t) for t in texts], len(self.index))


def _chosen(counts: DataFrame, totals: dict[int, tuple[int, int]], without: int | None, most: int) -> list[int]:
    """Features that speak for toxic, best first, counted without one fold. Their
    evidence is how unlikely a word's share of toxic rows is by chance: n times the
    divergence from the base rate; it must outweigh the number of words looked at.
    The lift is one in odds, which has no ceiling: a lift in shares cannot be met
    from a base rate of a half on."""
    own = counts.select("_key", *[((F.col(f"all.{c}") - F.col("folds")[without][c]) if without is not None else F.col(f"all.{c}")).alias(f"_{c}") for c in "an"]).where("_n >= 3")
    rows, ones = (sum(v[i] for f, v in totals.items() if f != without) for i in (0, 1))
    rate = min(max(ones / max(rows, 1), 1e-6), 1 - 1e-6)
    share = F.col("_a") / F.col("_n")
    gain = F.col("_a") * F.log(share / rate) + F.when(share < 1, (F.col("_n") - F.col("_a")) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    least = math.log(max(own.count(), 1)) + EVIDENCE
    lifted = F.col("_a") * (1 - rate) > MIN_LIFT * (F.col("_n") - F.col("_a")) * rate
    top = own.where(lifted).select("_key", gain.alias("_g")).where(F.col("_g") >= least).orderBy(F.desc("_g"), "_key").limit(most)
    return [r[0] for r in top.collect()]


def fit_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> ToxicModel:
    """Fit on at most max_rows labelled documents, drawn by a hash of the id. The
    drawn ids are broadcast (max_rows at most), so no text is shuffled. Rows without
    an id or a label are left out; without any rows left all scores are alike."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_mark"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(max_rows)

    @F.arrow_udf("struct<n:int,keys:array<bigint>>")
    def keys_of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            words = _WORD.findall((t.as_py() or "").lower())
            out.append({"n": len(words), "keys": list({k for w in set(words) for k in word_features(w)})})
        return pa.array(out, pa.struct([("n", pa.int32()), ("keys", pa.list_(pa.int64()))]))

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("_fold")
    rows = stored(
        docs.select("doc_id", F.col(text_col).alias("_text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "_mark", fold, keys_of("_text").alias("f")).select("doc_id", "_mark", "_fold", "f.n", "f.keys"),
        "toxic-rows",
    )
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy("_fold").agg(F.count(F.lit(1)), F.sum("_mark")).collect()}
    folds = [F.struct(F.sum(F.when(F.col("_fold") == f, F.col("_mark")).otherwise(0)).alias("a"), F.count_if(F.col("_fold") == f).alias("n")) for f in range(FOLDS)]
    every = F.struct(F.sum("_mark").alias("a"), F.count(F.lit(1)).alias("n"))
    counts = rows.select("_mark", "_fold", F.explode("keys").alias("_key")).groupBy("_key").agg(every.alias("all"), F.array(*folds).alias("folds")).where("all.n >= 3")
    counts = stored(counts, "toxic-counts")
    chosen = [_chosen(counts, totals, f, max_features) for f in (*range(FOLDS), None)]
    keys = list(dict.fromkeys(k for own in reversed(chosen) for k in own))  # those of all rows come first
    index = {k: i for i, k in enumerate(keys)}

    @F.arrow_udf("array<int>")
    def columns_of(found: pa.Array) -> pa.Array:
        return pa.array([sorted(index[k] for k in own if k in index) for own in found.to_pylist()], pa.list_(pa.int32()))

    picked = rows.select("doc_id", "_mark", "_fold", "n", columns_of("keys").alias("columns"))
    sample = picked.orderBy("doc_id", F.xxhash64("columns")).limit(max_rows).toArrow().to_pylist()
    sparse = [np.array(r["columns"], np.int64) for r in sample]
    toxic, folds = (np.array([r[c] for r in sample], int) for c in ("_mark", "_fold"))
    views = []
    for f, own in enumerate(chosen):
        use = np.zeros(len(keys), bool)
        use[[index[k] for k in own]] = True
        kept = [r[use[r]] for r in sparse]
        share = np.array([len(x) / max(1, r["n"]) for x, r in zip(kept, sample)])
        seen = (toxic == 1) & (folds != f)
        middle = float(np.median(share[seen])) if seen.any() else 0.0
        views.append((kept, np.column_stack([(toxic == 1) & (share >= middle), (toxic == 1) & (share < middle), toxic == 1])))
    model = ToxicModel(chosen[-1], [np.delete(w, np.s_[len(chosen[-1]) : len(keys)]) for w in fit_chain(views, folds, len(keys))])
    forget(rows)
    forget(counts)
    return model


def toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input's columns plus score (of toxic), toxic, p_dense and p_sparse.

    One row for each row, repeated ones too; null and empty texts have no features
    and get the chain's base rates. toxic is true where score >= threshold. Columns
    of the input that have one of the four names are replaced; an empty table gives
    an empty result. Nothing is shuffled.
    """
    packed = pickle.dumps((list(model.index), model.chain))
    held: list[ToxicModel] = []

    @F.arrow_udf("struct<dense:double,sparse:double,toxic:double>")
    def scored(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(ToxicModel(*pickle.loads(packed)))
        p = held[0].scores(t.as_py() for t in texts)
        return pa.StructArray.from_arrays([pa.array(p[:, i], pa.float64()) for i in range(3)], list(CATEGORIES))

    chain = f"_{uuid.uuid4().hex}"  # no name of the input's
    out = docs.withColumn(chain, scored(F.col(text_col)))
    p = F.col(chain)
    new = {"score": p["toxic"], "toxic": p["toxic"] >= threshold, "p_dense": p["dense"], "p_sparse": p["sparse"]}
    return out.select(*[F.col(c) for c in docs.columns if c not in new], *[x.alias(c) for c, x in new.items()])


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).drop("text")
