"""Benchmark decontamination with a BM25 index and block-max WAND.

The test items are the index, the training passages are the queries. A passage is
two strides of the longest item, so every run of an item's length lies in one. An
item leaks if at least `overlap` of its five-word shingles are in one passage, or as
much of its question and of its answer (its last sentence): of the one with the
higher score in one passage, of the other anywhere in the same document.

Fewer than five words are no evidence, since any text may hold them. So an item of
fewer words leaks only into a text of just these words, and question and answer count
apart from each other only if the one that retrieves has five words or more.

The retrieval threshold is no constant: an overlap leaves only so many shingles
uncovered, a word that is missing leaves all over its places uncovered, and so the
BM25 score of an item that leaks can be bounded from below (see _least_share). Impacts are
divided by that bound, which makes 1 the threshold of all items and loses no leak.

Items are kept in blocks with the largest impact of every term in each block. Terms
are taken from the most frequent on into a set that cannot reach the threshold by
itself. The lists of the other, essential terms are walked with WAND: cursors in
order of their items, the pivot where the terms' maxima and the rest can reach the
threshold, a leap over blocks whose maxima cannot, then the item's exact score, then
the words themselves.

Documents are scored where they lie: nothing is shuffled. A benchmark of more than
`part_bytes` of text is searched in parts, one pass over the stored documents for
each, so that a worker holds the index of one part at a time. The figures that
scores and passages rest on (number of items, document frequencies, mean and
greatest length) are taken over all items, so the number of parts changes no result.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import uuid
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored, table

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
#: The most that an item's non-essential terms reach together, where its threshold is 1.
REST = 0.9
PART_BYTES = 8 << 20
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CLEAN = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
#: Punctuation and spaces of Unicode's basic plane beyond ASCII: curly quotes, dashes,
#: guillemets. With those of other planes (ancient scripts) the class would be a list
#: that is searched for every character.
_BEYOND = re.compile("[" + "".join(chr(c) for c in range(128, 0x10000) if unicodedata.category(chr(c))[0] in "PZ") + "]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
LEAK = "array<struct<item_id:bigint,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; punctuation and spaces of Unicode, and the symbols of ASCII,
    separate."""
    low = (text or "").lower()
    if not low.isascii():
        low = _BEYOND.sub(" ", low)
    return low.encode().translate(_CLEAN).split()


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; an item of one sentence is a question only."""
    parts = [p for p in _SENTENCE.split(text) if p and p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _item_order(item: tuple[int | None, str]):
    return item[0] is not None, item[0] or 0, item[1]


def _least_share(words: list[bytes], impacts: dict[bytes, float], overlap: float) -> float:
    """The least impact that a text gathers which holds `overlap` of the words'
    distinct shingles.

    At most u shingles are missing, and a word that the text lacks takes with it all
    shingles over its places. The greatest impact that can be lost is found place by
    place: lost[g][k] is the most that missing words can hold whose shingles are k in
    number, with the last of them g places back (or SHINGLE and more). A word's impact
    is dealt evenly to its places, and shingles that repeat add to u, both of which
    can only raise the loss. One whole shingle is there in any case."""
    own, n = shingles(words), len(words)
    least = sum(impacts[t] for t in set(words))
    last = max(0, n - SHINGLE)  # where the last shingle begins
    missing = int((1 - overlap) * len(own) + 1e-9)
    if not missing:
        return least
    missing += last + 1 - len(own)
    often = Counter(words)
    lost = np.full((SHINGLE + 1, missing + 1), -np.inf)
    lost[SHINGLE, 0] = 0.0
    for i, t in enumerate(words):
        here = np.full(missing + 1, -np.inf)
        for g in range(1, SHINGLE + 1):
            # Shingles over this place begin at i - SHINGLE + 1 to i; those up to i - g are missing already.
            new = min(i, last) - max(i - g + 1, i - SHINGLE + 1, 0) + 1
            new = max(0, new)
            if new <= missing:
                here[new:] = np.maximum(here[new:], lost[g, : missing + 1 - new])
        lost[SHINGLE] = np.maximum(lost[SHINGLE], lost[SHINGLE - 1])
        lost[2:SHINGLE] = lost[1 : SHINGLE - 1]
        lost[1] = here + impacts[t] / often[t]
    whole = min(sum(impacts[t] for t in set(g.split())) for g in own)
    return max(least - float(lost.max()), whole)


class ItemIndex:
    """Inverted index of items with scaled BM25 impacts and block maxima."""

    def __init__(self, items: list[tuple[int | None, str]], overlap: float = OVERLAP, block_items: int = BLOCK_ITEMS, figures: tuple[int, int, int, dict[bytes, int]] | None = None):
        """figures: number, summed and greatest length, and document frequencies of
        all items, where these are only a part of them."""
        items = [(i, t) for i, t in sorted(items, key=_item_order) if words_of(t)]
        self.overlap = overlap
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        if figures is None:
            figures = len(words), sum(map(len, words)), max(map(len, words), default=0), Counter(t for w in words for t in set(w))
        count, length, self.window, freq = figures
        #: Items of fewer words than a shingle, by their words.
        self.tiny: dict[tuple[bytes, ...], list[int | None]] = {}
        for i, w in zip(self.ids, words):
            if len(w) < SHINGLE:
                self.tiny.setdefault(tuple(w), []).append(i)
        large = [k for k, w in enumerate(words) if len(w) >= SHINGLE]
        items, words, self.ids = [items[k] for k in large], [words[k] for k in large], [self.ids[k] for k in large]
        self.size = block_items
        mean = length / max(1, count)
        impacts: list[dict[bytes, float]] = []
        self.grams, self.need = [], []
        for (_, text), w in zip(items, words):
            own = {
                t: math.log(1 + (count - freq[t] + 0.5) / (freq[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean))
                for t, c in Counter(w).items()
            }
            total = sum(own.values())
            own = {t: v / total for t, v in own.items()}
            question, answer = (words_of(x) for x in question_and_answer(text))
            need = _least_share(w, own, overlap)
            parts = [(_least_share(x, own, overlap), x) for x in (question, answer) if x]
            parts.sort(key=lambda x: -x[0])  # the part with the larger score retrieves
            apart = len(parts[0][1]) >= SHINGLE
            if apart:
                need = min(need, parts[0][0])
            self.need.append(need)
            self.grams.append((shingles(w), shingles(question), shingles(answer), parts[0][1] is answer, apart))
            impacts.append({t: v / need * (1 + 1e-9) for t, v in own.items()})
        rest = [0.0] * len(words)
        holders: dict[bytes, list[int]] = {}
        for k, own in enumerate(impacts):
            for t in own:
                holders.setdefault(t, []).append(k)
        #: Of an item: its non-essential terms.
        self.common: list[dict[bytes, float]] = [{} for _ in words]
        #: Of an essential term: its largest impact, items, impacts, blocks, and maxima of the blocks.
        self.essential: dict[bytes, tuple[float, list[int], list[float], list[int], list[float]]] = {}
        for t in sorted(holders, key=lambda t: (-len(holders[t]), t)):
            if all(rest[k] + impacts[k][t] < REST for k in holders[t]):
                for k in holders[t]:
                    rest[k] += impacts[k][t]
                    self.common[k][t] = impacts[k][t]
                continue
            own = [impacts[k][t] for k in holders[t]]
            top: dict[int, float] = {}
            for k, v in zip(holders[t], own):
                top[k // block_items] = max(top.get(k // block_items, 0.0), v)
            self.essential[t] = (max(own), holders[t], own, list(top), list(top.values()))
        self.rest = [max(rest[b : b + block_items]) for b in range(0, len(words), block_items)]
        self.most = max(rest, default=0.0)

    def retrieved(self, passage: set[bytes], essential: set[bytes]) -> list[tuple[int, float]]:
        """(item, scaled score) of all items whose scaled score is at least 1."""
        found: list[tuple[int, float]] = []
        lists = [self.essential[t] for t in essential]
        maxima: dict[int, float] = {}
        for _, _, _, blocks, tops in lists:
            for b, v in zip(blocks, tops):
                maxima[b] = maxima.get(b, 0.0) + v
        near = sorted(b for b, v in maxima.items() if v + self.rest[b] >= 1)
        if not near:
            return found
        cursors, last = [], (near[-1] + 1) * self.size
        for x in lists:
            at = bisect_left(x[1], near[0] * self.size)
            if at < len(x[1]) and x[1][at] < last:
                cursors.append([x[1][at], at, x])  # item, place, list
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = self.most, -1
            for c in cursors:
                bound += c[2][0]
                if bound >= 1:
                    pivot = c[0]
                    break
            if pivot < 0:
                break
            block, behind = pivot // self.size, [c for c in cursors if c[0] <= pivot]
            at = bisect_left(near, block)
            if at == len(near):
                break
            if near[at] != block:  # the block's maxima cannot reach 1
                target = near[at] * self.size
                behind = [c for c in cursors if c[0] < target]
            elif cursors[0][0] == pivot:
                score = sum(c[2][2][c[1]] for c in behind) + sum(v for t, v in self.common[pivot].items() if t in passage)
                if score >= 1:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target, behind = pivot, [c for c in behind if c[0] < pivot]
            for c in behind:
                c[1] = bisect_left(c[2][1], target, c[1])
                c[0] = c[2][1][c[1]] if c[1] < len(c[2][1]) and c[2][1][c[1]] < last else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def leaks(self, text: str | None) -> list[dict]:
        """The items that a text leaks, each with its best passage's figures."""
        words = words_of(text)
        if len(words) < SHINGLE:
            same = self.tiny.get(tuple(words), ())
            return [{"item_id": i, "score": 1.0, "overlap": 1.0, "question_overlap": 1.0, "answer_overlap": 1.0} for i in same]
        if not self.ids:
            return []
        essential, step = self.essential, self.window
        buckets: dict[int, set[bytes]] = {}
        for i, w in enumerate(words):
            if w in essential:
                buckets.setdefault(i // step, set()).add(w)
        found: dict[int, dict] = {}
        whole: dict[int, set[bytes]] = {}  # of the document: shingles by their length
        for p in sorted({k for b in buckets for k in (b - 1, b) if k >= 0}):
            passage = words[p * step : (p + 2) * step]
            pools: dict[int, set[bytes]] = {}
            for k, score in self.retrieved(set(passage), buckets.get(p, set()) | buckets.get(p + 1, set())):
                item, question, answer, by_answer, apart = self.grams[k]
                parts = [self._overlap(item, passage, pools), self._overlap(answer if by_answer else question, passage, pools)]
                if max(parts[: 1 + apart]) < self.overlap:
                    continue
                parts.append(self._overlap(question if by_answer else answer, words, whole))
                if parts[0] < self.overlap and parts[2] < self.overlap and answer:
                    continue
                hit = {"item_id": self.ids[k], "score": round(score * self.need[k], 6), "overlap": parts[0], "question_overlap": parts[1 + by_answer], "answer_overlap": parts[2 - by_answer]}
                if k not in found or (hit["overlap"], hit["question_overlap"]) > (found[k]["overlap"], found[k]["question_overlap"]):
                    found[k] = hit
        return [found[k] for k in sorted(found)]

    @staticmethod
    def _overlap(own: set[bytes], words: list[bytes], pools: dict[int, set[bytes]]) -> float:
        """Share of own that is among the shingles of words, kept in pools by length."""
        if not own:
            return 0.0
        size = len(next(iter(own)).split())
        if size not in pools:
            pools[size] = shingles(words, size)
        return len(own & pools[size]) / len(own)


def add_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", out_col: str = "leaks", overlap: float = OVERLAP, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add the array of items that each whole text leaks (out_col).

    Null and empty texts, and items without words, leak nothing. Items of fewer than
    five words leak only into texts of just these words. Every distinct text
    of an item_id, null ids included, is an item of its own, reported under that
    item_id. Rows are independent and stay, repeated ones too; other columns stay,
    but one already named out_col is replaced. An empty benchmark gives empty
    arrays, an empty docs an empty result.
    """
    items = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    if parts == 1:
        rows = [(r[0], r[1]) for r in items.collect()]  # part_bytes at most
        return docs.withColumn(out_col, _leak_column(docs, ItemIndex(rows, overlap))(F.col(text_col)))
    split = items.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))).withColumn("_words", _item_words()(F.col("text")))
    count, length, longest = split.where("_words.n > 0").agg(F.count(F.lit(1)), F.sum("_words.n"), F.max("_words.n")).first()
    terms = split.select("_part", F.explode("_words.terms").alias("_term"))
    freq = stored(terms.groupBy("_term").agg(F.count(F.lit(1)).alias("_n"), F.collect_set("_part").alias("_parts")), "item-terms")
    row, own, result = (f"_{uuid.uuid4().hex}" for _ in range(3))  # no name of the input's
    numbered = stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(own), docs[text_col].alias("_text"), F.monotonically_increasing_id().alias(row)), "leak-rows")
    hits = None
    for part in range(parts):
        rows = [(r[0], r[1]) for r in split.where(F.col("_part") == part).select("item_id", "text").collect()]  # about part_bytes
        known = {bytes(r[0]): r[1] for r in freq.where(F.array_contains("_parts", F.lit(part).cast("bigint"))).select("_term", "_n").collect()}
        index = ItemIndex(rows, overlap, figures=(count, length or 0, longest or 0, known))
        found = numbered.select(row, _leak_column(docs, index)(F.col("_text")).alias("_found")).where(F.size("_found") > 0)
        found = stored(found, "leak-hits")
        hits = found if hits is None else hits.unionByName(found)
    forget(freq)
    grouped = hits.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("_found"))).alias(result))
    done = F.coalesce(result, F.array().cast(LEAK)).alias(out_col)
    kept = [done if c == out_col else F.col(own)[c].alias(c) for c in docs.columns]
    return numbered.join(grouped, row, "left").select(*kept, *[done][: out_col not in docs.columns])


def _item_words():
    @F.arrow_udf("struct<n:int,terms:array<binary>>")
    def measured(texts: pa.Array) -> pa.Array:
        words = [words_of(t.as_py()) for t in texts]
        return pa.array([{"n": len(w), "terms": list(set(w))} for w in words], pa.struct([("n", pa.int32()), ("terms", pa.list_(pa.binary()))]))

    return measured


#: The index that a worker holds, by the key of its search.
_HELD: dict[str, ItemIndex] = {}


def held_index(key: str, packed) -> ItemIndex:
    """The broadcast index, unpacked once for a worker, which goes from task to task."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = pickle.loads(packed.value)
    return _HELD[key]


def _leak_column(docs: DataFrame, index: ItemIndex):
    packed, key = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index)), uuid.uuid4().hex

    @F.arrow_udf(LEAK)
    def leaks(texts: pa.Array) -> pa.Array:
        held = held_index(key, packed)
        return pa.array((held.leaks(t.as_py()) for t in texts), _LEAK)

    return leaks


def op10_decontamination(spark, sf_dir):
    """One row for each document and item that it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = add_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
