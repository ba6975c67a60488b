"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a short vector of shape features (lengths, character classes,
repetition). The model is a sum of look-up tables, one for each feature and one
for each chosen pair of features. Tables are learnt by cyclic boosting: feature by
feature, round by round, a tree of at most `leaves` leaves over the feature's bins
is fitted to the gradient of the logistic loss and added with a small step; then
the pairs whose residual surface gains most are boosted in the same way. Scoring
adds one table entry for each feature and pair, vectorised over a batch.

The fit takes a sample of labelled rows (`max_rows`, the only bound), whose ids are
broadcast to find their texts; scoring covers every document and its whole text
where it lies, so no text is ever shuffled.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Labelled rows that a fit takes at most.
MAX_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_next", "upper", "symbols", "exclaims", "bars", "digits", "stops",
    "log_lines", "repeated_lines", "top_word", "high_bytes", "spaces", "symbol_words",
)

_CLASS = np.zeros(256, np.int64)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 2
_CLASS[[ord(c) for c in "0123456789"]] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[ord("!")] = 6
_CLASS[[ord(c) for c in "|/\\"]] = 7
_CLASS[128:] = 8


def features(text: str | None) -> np.ndarray:
    """The feature vector of a whole text; null and empty texts give zeros."""
    out = np.zeros(len(FEATURES), np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9)
    n = len(raw)
    words = raw.split()
    m = len(words)
    lines = raw.split(b"\n")
    if m:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        out[0] = np.log1p(m)
        out[1] = sum(map(len, words)) / m
        out[2] = len(counts) / m
        out[3] = sum(map(bytes.__eq__, words, words[1:])) / m
        out[12] = max(counts.values()) / m
        out[15] = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?") / m
    out[4] = kinds[1] / max(1.0, kinds[1] + kinds[2])
    out[5] = kinds[0] / n
    out[6] = kinds[6] / n
    out[7] = kinds[7] / n
    out[8] = kinds[3] / n
    out[9] = kinds[5] / n
    out[10] = np.log1p(len(lines))
    out[11] = 1 - len(set(lines)) / len(lines)
    out[13] = kinds[8] / n
    out[14] = kinds[4] / n
    return out


@dataclass
class Additive:
    """cuts[f]: upper edges of the bins; tables[f]; pairs[(f, g)]: a table over coarse bins."""

    base: float = 0.0
    cuts: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cut, t) in enumerate(zip(self.cuts, self.tables)):
            total += t[np.searchsorted(cut, x[:, f])]
        at = {f: np.searchsorted(self.coarse[f], x[:, f]) for pair in self.pairs for f in pair}
        for (f, g), t in self.pairs.items():
            total += t[at[f], at[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges half-way between neighbouring quantiles of the values seen."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
    return ((values[1:] + values[:-1]) / 2).astype(np.float32)


def _leaf(g: float, h: float, ridge: float) -> float:
    return -g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values of a best-first tree over ordered bins."""
    spans, out = [(0, len(g))], np.zeros(len(g))
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(lo, hi):
        if hi - lo < 2:
            return 0.0, lo
        k = np.arange(lo + 1, hi)
        gl, hl, gt, ht = gs[k] - gs[lo], hs[k] - hs[lo], gs[hi] - gs[lo], hs[hi] - hs[lo]
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        i = int(np.argmax(gain))
        return float(gain[i]), int(k[i])

    while len(spans) < leaves:
        found = [(*best(*s), s) for s in spans]
        gain, cut, span = max(found, key=lambda x: x[0])
        if gain <= 1e-9:
            break
        spans.remove(span)
        spans += [(span[0], cut), (cut, span[1])]
    for lo, hi in spans:
        out[lo:hi] = _leaf(gs[hi] - gs[lo], hs[hi] - hs[lo], ridge)
    return out


def _grid(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A depth-two tree over a pair's grid: the first axis is cut once, each side
    once along the second axis; also with the axes exchanged. Gain and values."""
    best, values = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        whole = a.sum() ** 2 / (b.sum() + ridge)
        for cut in range(1, a.shape[0]):
            gain, out = -whole, np.zeros_like(a)
            for part in (slice(0, cut), slice(cut, None)):
                tree = _tree(a[part].sum(0), b[part].sum(0), 2, ridge)
                out[part] = tree
                gain += float(-(tree * a[part].sum(0)).sum())
            if gain > best:
                best, values = gain, (out.T if flip else out)
    return best, values


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, grid: int = 8, rounds: int = 150, pair_rounds: int = 30, pairs: int = 6, leaves: int = 3, rate: float = 0.15, ridge: float = 2.0) -> Additive:
    """Learn the tables. Without rows the score is 0.5 everywhere; with one class
    it leans to that class."""
    model = Additive()
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    n, ones = len(y), float(np.sum(y))
    model.base = float(np.log((ones + 1) / (n - ones + 1)))
    if n == 0 or ones in (0, n):
        model.cuts = model.coarse = [np.zeros(0, np.float32)] * width
        model.tables = [np.zeros(1)] * width
        return model
    model.cuts = [_edges(x[:, f], bins) for f in range(width)]
    model.coarse = [_edges(x[:, f], grid) for f in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(model.cuts[f], x[:, f]) for f in range(width)]
    logit = np.full(n, model.base)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            if not len(model.cuts[f]):
                continue
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), leaves, ridge)
            model.tables[f] += step
            logit += step[at[f]]
    low = [np.searchsorted(model.coarse[f], x[:, f]) for f in range(width)]
    shape = [len(c) + 1 for c in model.coarse]

    def surface(f, k):
        g, h = slopes()
        cell, size = low[f] * shape[k] + low[k], shape[f] * shape[k]
        return np.bincount(cell, g, size).reshape(shape[f], shape[k]), np.bincount(cell, h, size).reshape(shape[f], shape[k])

    gains = sorted(((_grid(*surface(f, k), ridge)[0], f, k) for f in range(width) for k in range(f + 1, width)), reverse=True)
    chosen = [(f, k) for gain, f, k in gains[:pairs] if gain > 0]
    model.pairs = {pair: np.zeros((shape[pair[0]], shape[pair[1]])) for pair in chosen}
    for _ in range(pair_rounds):
        for f, k in chosen:
            _, values = _grid(*surface(f, k), ridge)
            model.pairs[f, k] += rate * values
            logit += rate * values[low[f], low[k]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, text_col: str, label_col: str, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most max_rows labelled rows, drawn by a hash of
    the id; rows without a label or an id are left out. The drawn ids are
    broadcast (max_rows at most), so no text is shuffled."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_label"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(max_rows)

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        rows = [features(t.as_py()) for t in texts]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), pa.array(flat, pa.float32()))

    rows = docs.select("doc_id", F.col(text_col).alias("_text")).join(F.broadcast(drawn), "doc_id").select("doc_id", vectors("_text").alias("x"), "_label")
    rows = rows.orderBy("doc_id", F.xxhash64("x")).limit(max_rows).select("x", "_label").toArrow()
    if not rows.num_rows:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0)
    x = np.asarray(rows.column(0).combine_chunks().flatten(), np.float32).reshape(-1, len(FEATURES))
    return x, np.asarray(rows.column(1), np.float64)


def held_out(id_col):
    """Rows whose labels a fit must not see: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The input's columns plus held_out, score, predicted.

    One row for each document. score is the model's probability that the label is
    1; predicted is 1 where score >= threshold. Null and empty texts share one
    score. Rows that repeat an id are scored one by one; a null id is never held
    out and never trained on. Columns of the input that have one of the three names
    are replaced. Empty documents give an empty result, empty labels
    a score of 0.5 everywhere.
    """
    model = pickle.dumps(fit(*training_rows(docs, labels.where(~held_out("doc_id")), text_col, label_col, max_rows)))
    held: list[Additive] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(pickle.loads(model))
        if not len(texts):
            return pa.array([], pa.float64())
        return pa.array(held[0].score(np.stack([features(t.as_py()) for t in texts])), pa.float64())

    new = {"held_out": held_out("doc_id"), "score": score(F.col(text_col))}
    scored = docs.withColumns(new)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
