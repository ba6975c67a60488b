"""Removal of long repeated substrings with suffix arrays by linear grouping.

Every string of `length` bytes has an anchor: the leftmost of its `GRAM`-byte grams
with the least hash. Equal strings have equal anchors at equal offsets, so strings
meet if they are dealt by the bytes around the anchor that all strings of the
offset's range hold (a core of about two thirds of the length). Runs of strings
with one anchor travel as one row, equal runs of a text as one; a first pass over
(core hash, text) rows drops all runs whose core is found once, so only few bytes
are sent on.

Runs that share a core are aligned at the anchor. The places where any two of them
part, found between neighbours in sorted order, cut the aligned runs in columns,
and each run becomes a short string of symbols (column, content). Over the strings
of many cores together a suffix array is built by linear grouping; neighbours that
share symbols worth at least `length` bytes repeat each other there. Because all
maximal common ranges begin and end at such cuts, this is exact to the byte.

Texts that repeat as a whole are taken once; a copy's bytes are all repeated. Texts
are told apart by two independent 64-bit hashes and their length. Only the search
for cores with more than one text goes by the first hash alone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored, table
from .grouping_sa import common_prefixes, suffix_array

LENGTH = 400
#: Starts handled at a time, and symbols of one suffix array.
CHUNK = 1 << 18
BATCH_SYMBOLS = 40_000
_PLACE = np.uint64((1 << 20) - 1)

_rng = np.random.Generator(np.random.PCG64(20_240_229))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima of blocks from both sides."""
    n = len(h) - w + 1
    pad = -len(h) % w
    blocks = np.concatenate([h, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


class Anchors:
    """Runs of strings by anchor for one length."""

    def __init__(self, length: int):
        self.length = length
        self.gram = max(1, length * 8 // 25)
        self.width = length - self.gram + 1  # grams of a string; offsets are below this
        self.half = self.width // 2
        self.pow, self.inv = _powers(_BASE, CHUNK + length + 1), _powers(_INVERSE, CHUNK + length + 1)

    def runs(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(core hashes, places) of a text; a place packs the anchor's position
        with the least and the largest offset of the run's strings."""
        keys, places = [], []
        data = np.frombuffer(raw, np.uint8)
        for at in range(0, len(raw) - self.length + 1, CHUNK):
            part = data[at : at + CHUNK + self.length - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[part] * self.pow[: len(part)], out=sums[1:])
            n = len(part) - self.gram + 1
            h = _mixed((sums[self.gram :] - sums[:n]) * self.inv[:n])
            low = _window_minima((h & ~_PLACE) | np.arange(n, dtype=np.uint64), self.width)
            p = (low & _PLACE).astype(np.int64)
            cut = np.flatnonzero(np.diff(p)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]) - 1
            p = p[first]
            far, near = p - first, p - last
            for level in (0, 1):
                lo = np.maximum(near, self.half) if level else near
                hi = far if level else np.minimum(far, self.half - 1)
                ok = lo <= hi
                a = p[ok] - (self.half if level else 0)
                b = p[ok] + (self.length - self.width + 1 if level else self.length - self.half + 1)
                key = _mixed((sums[b] - sums[a]) * self.inv[a] + np.uint64(level))
                keys.append(key)
                places.append(((p[ok] + at) << 20) | (lo[ok] << 10) | hi[ok])
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(keys).view(np.int64), np.concatenate(places)


def _shared_ahead(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Aligner:
    """Collects aligned groups of runs as symbol strings and finds, by suffix
    arrays over many groups, the byte ranges that are repeated."""

    def __init__(self, length: int):
        self.length = length
        self.clear()

    def clear(self):
        self.text: list[int] = []
        self.owner: list[tuple[int, list[int], int] | None] = []  # of a symbol: row, its cuts, column
        self.rows: list[list] = []  # of a row: the (id, anchor) pairs that have it
        self.symbols = 2  # 0 ends the text, 1 parts rows

    def add(self, group: dict[tuple[int, bytes], list]) -> None:
        """One core's runs: (bytes before the anchor, bytes) -> places. A run found
        once more is given twice, which is as good as all its copies."""
        if len(group) == 1 and sum(map(len, group.values())) < 2:
            return
        runs = list(group.items())
        ahead = sorted(runs, key=lambda x: x[0][1][x[0][0] :])
        back = sorted(runs, key=lambda x: x[0][1][: x[0][0]][::-1])
        cuts = {x for (d, seg), _ in runs for x in (-d, len(seg) - d)}
        for (x, _), (y, _) in zip(ahead, ahead[1:]):
            cuts.add(_shared_ahead(x[1][x[0] :], y[1][y[0] :]))
        for (x, _), (y, _) in zip(back, back[1:]):
            cuts.add(-_shared_ahead(x[1][: x[0]][::-1], y[1][: y[0]][::-1]))
        cuts.add(0)
        ordered = sorted(cuts)
        codes: dict[tuple[int, bytes], int] = {}
        for (d, seg), places in runs:
            for copy in range(min(2, len(places))):
                row = len(self.rows)
                self.rows.append(places if copy == 0 else [])
                own = [c for c in ordered if -d <= c <= len(seg) - d]
                for k in range(len(own) - 1):
                    piece = (own[k], seg[own[k] + d : own[k + 1] + d])
                    code = codes.get(piece)
                    if code is None:
                        code = codes[piece] = self.symbols
                        self.symbols += 1
                    self.text.append(code)
                    self.owner.append((row, own, k))
                self.text.append(1)
                self.owner.append(None)

    def ranges(self) -> list[tuple[int, int, int]]:
        """(id, start, end) of all repeated ranges collected so far."""
        text = [*self.text, 0]
        order = suffix_array(text)
        shared = common_prefixes(text, order)
        shared.append(0)
        out = []
        reach: dict[int, list[tuple[int, int]]] = {}
        for r in range(1, len(order)):
            at = order[r]
            if at >= len(self.owner) or self.owner[at] is None:
                continue
            row, own, k = self.owner[at]
            if not self.rows[row]:
                continue
            top = min(max(shared[r], shared[r + 1]), len(own) - 1 - k)
            if top and own[k + top] - own[k] >= self.length:
                reach.setdefault(row, []).append((own[k], own[k + top]))
        for row, spans in reach.items():
            for lo, hi in merged(spans):
                out.extend((i, p + lo, p + hi) for i, p in self.rows[row])
        self.clear()
        return out


def merged(spans) -> list[tuple[int, int]]:
    """Sorted maximal ranges; ranges that touch become one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


#: What two rows with one text agree in.
_SAME = ["_id", "_id2", "_n"]


def _same(text):
    return F.xxhash64(text), F.xxhash64(F.lit(1), text), F.octet_length(text)


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(_doc, _id, _id2, _n, spans array<struct<lo, hi>>) of the rows with repeated
    bytes: id, the text's two hashes and length, and the ranges.

    See suffix_dedup for what counts as repeated.
    """
    if not 50 <= length <= 1000:
        raise ValueError("length must be between 50 and 1000")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_doc"), text.alias("_text"), *[x.alias(c) for c, x in zip(_SAME, _same(text))])
    small = base.where(F.col("_n") >= length).drop("_text")
    texts = stored(small.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("_copies"), F.min("_doc").alias("_first")), "suffix-texts")

    def anchored(batches):
        """Each core of a text once, and whether the text has it more than once."""
        cut = Anchors(length)
        for batch in batches:
            ids, keys, many = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                k, times = np.unique(cut.runs(t.as_py().encode())[0], return_counts=True)
                ids.append(np.full(len(k), i, np.int64))
                keys.append(k)
                many.append(times > 1)
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (keys, ids, many)], ["_key", "_id", "_many"])

    def met(batches):
        """Of rows sorted by key, those whose key another text has, or their own
        once more. One row is held over, so a key of any number of rows needs no
        memory."""
        last = None  # key, id, whether it is met already
        for batch in batches:
            key, ids, many = (np.asarray(c) for c in batch.columns)
            if last is not None:
                key, ids, many = (np.concatenate([[x], y]) for x, y in zip(last, (key, ids, many)))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids, hit = key[new], ids[new], many[new].astype(bool)
            same = key[1:] == key[:-1]
            hit[1:] |= same
            hit[:-1] |= same
            last = (key[-1], ids[-1], bool(hit[-1]))
            at = np.flatnonzero(hit[:-1])
            yield pa.record_batch([pa.array(key[at]), pa.array(ids[at])], ["_key", "_id"])
        if last is not None and last[2]:
            yield pa.record_batch([pa.array([int(x)], pa.int64()) for x in last[:2]], ["_key", "_id"])

    runs = base.where(F.col("_n") >= length).select("_id", "_text").mapInArrow(anchored, "_key long, _id long, _many boolean")
    candidates = runs.repartition("_key").sortWithinPartitions("_key", "_id").mapInArrow(met, "_key long, _id long")
    wanted = candidates.groupBy("_id").agg(F.collect_list("_key").alias("_keys")).join(texts.select(*_SAME, "_first"), "_id")

    def cut_out(batches):
        """The runs of the wanted cores; equal runs of a text go as one row."""
        cut = Anchors(length)
        for batch in batches:
            keys, ids, more, far, segs, places = [], [], [], [], [], []
            for i, i2, t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = t.as_py().encode()
                found, at = cut.runs(raw)
                ok = np.isin(found, np.asarray(own.values))
                runs: dict[tuple[int, int, bytes], list[int]] = {}
                for key, place in zip(found[ok].tolist(), at[ok].tolist()):
                    p, lo, hi = place >> 20, (place >> 10) & 1023, place & 1023
                    runs.setdefault((key, hi, raw[p - hi : p - lo + length]), []).append(p)
                for (key, hi, seg), p in runs.items():
                    keys.append(key)
                    ids.append(i)
                    more.append(i2)
                    far.append(hi)
                    segs.append(seg)
                    places.append(p)
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(more, pa.int64()), pa.array(far, pa.int32()), pa.array(segs, pa.binary()), pa.array(places, pa.list_(pa.int64()))],
                ["_key", "_id", "_id2", "_far", "_seg", "_places"],
            )

    chosen = base.alias("b").join(wanted.withColumnRenamed("_first", "_doc").alias("w"), [F.col(f"b.{c}") == F.col(f"w.{c}") for c in _SAME] + [F.col("b._doc").eqNullSafe(F.col("w._doc"))])
    segments = chosen.select("b._id", "b._id2", "_text", "_keys").mapInArrow(cut_out, "_key long, _id long, _id2 long, _far int, _seg binary, _places array<long>")

    def compared(batches):
        align = Aligner(length)
        group: dict = {}
        seen: set = set()
        at = None

        def out():
            found = align.ranges()
            columns = zip(*((*i, lo, hi) for i, lo, hi in found)) if found else [[]] * 4
            return pa.record_batch([pa.array(x, pa.int64()) for x in columns], ["_id", "_id2", "lo", "hi"])

        for batch in batches:
            for key, i, i2, far, seg, places in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    align.add(group)
                    if len(align.text) >= BATCH_SYMBOLS:
                        yield out()
                    group, seen, at = {}, set(), key
                if (i, i2, far, places[0]) in seen:
                    continue  # the same text, met twice
                seen.add((i, i2, far, places[0]))
                group.setdefault((far, seg), []).extend(((i, i2), p) for p in places)
        align.add(group)
        yield out()

    ranges = segments.repartition("_key").sortWithinPartitions("_key").mapInArrow(compared, "_id long, _id2 long, lo long, hi long")
    own = ranges.groupBy("_id", "_id2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("_n").cast("long").alias("hi")))
    judged = stored(
        texts.join(own, ["_id", "_id2"], "left")
        .select(*_SAME, "_first", "_copies", F.when(F.col("_copies") > 1, whole).otherwise(F.col("spans")).alias("spans"))
        .where("spans IS NOT NULL"),
        "suffix-spans",
    )
    single = judged.where("_copies = 1").select(F.col("_first").alias("_doc"), *_SAME, "spans")
    copies = small.join(judged.where("_copies > 1").select(*_SAME, "spans"), _SAME).select("_doc", *_SAME, "spans")
    forget(texts)
    return single.unionByName(copies.dropDuplicates(["_doc", *_SAME]))


def suffix_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """The input's columns plus suffix_result: struct(n_bytes, n_removed, spans, kept).

    Texts are UTF-8 bytes; null counts as empty. A byte is removed if some string
    of `length` bytes that covers it starts anywhere else too, in another text or
    in the same one, overlaps included; strings never reach across texts and are
    judged on the input. spans are the maximal removed ranges, kept the remaining
    bytes (which may cut a character). Shorter texts keep everything. Rows that
    repeat id and text are copies of each other. Other columns stay, but one already
    named suffix_result is replaced. Empty tables give empty results.
    """
    own = {c: f"_{uuid.uuid4().hex}" for c in ("_doc", *_SAME, "spans")}  # no name of the input's
    spans = repeated_spans(docs, text_col, id_col, length)
    spans = spans.select(*[spans[c].alias(x) for c, x in own.items()])

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,spans:array<struct<lo:long,hi:long>>,kept:binary>")
    def applied(texts: pa.Array, found: pa.Array) -> pa.Array:
        n, gone, cut, kept = [], [], [], []
        for t, own in zip(texts, found):
            raw = (t.as_py() or "").encode()
            at, parts, spans = 0, [], merged((x["lo"], x["hi"]) for x in own.as_py() or [])
            for lo, hi in spans:
                parts.append(raw[at:lo])
                at = hi
            parts.append(raw[at:])
            n.append(len(raw))
            kept.append(b"".join(parts))
            gone.append(len(raw) - len(kept[-1]))
            cut.append([{"lo": a, "hi": b} for a, b in spans])
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(cut, kind), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "spans", "kept"])

    same = docs[id_col].eqNullSafe(spans[own["_doc"]])
    for c, x in zip(_SAME, _same(F.coalesce(docs[text_col], F.lit("")))):
        same &= x == spans[own[c]]
    both = docs.join(spans, same, "left")
    return both.withColumn("suffix_result", applied(docs[text_col], spans[own["spans"]])).drop(*own.values())


def op8_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = "suffix_result"
    return suffix_dedup(docs).select(
        "doc_id",
        F.col(f"{r}.n_bytes").alias("n_bytes"),
        F.col(f"{r}.n_removed").alias("n_removed"),
        F.size(f"{r}.spans").cast("long").alias("n_spans"),
        F.sha2(f"{r}.kept", 256).alias("kept_sha256"),
    )
