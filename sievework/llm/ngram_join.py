"""N-gram Jaccard self-join as a blocked sparse product.

Documents are rows and word n-grams are columns of a 0/1 matrix; a link needs a
large entry of the matrix times its transpose. Equal rows are first collapsed to
one. By the size bounds, linked rows share one of the first
n - ceil(t n) + 1 columns of each, in any fixed order of the columns; the order
puts columns that a sample of documents shows to be frequent last (this changes
the cost, never the result). Rows that meet in such a column get the column's
least row as block key, so the many columns that near copies share give one block.
A block first compares column counts by cell (about eight columns each), whose
distance bounds the overlap from above. Rows that may still be partners form
families (components of these possibilities, over all blocks), which are the
blocks from there on, so that every row sends its whole set once. There the product is formed for slices of columns at a time, overlap counts
are accumulated, and a spanning forest of the links that pass is all a block
returns. Blocks over `block_rows` rows are cut in parts. A part forms its own
product and also meets the block's lead row; pairs of parts then need no sets, only
the rows' differences from the lead, which are short for near copies and give the
same overlaps. (Rows far from the lead cannot link with rows near it, as Jaccard
distance is a metric; they go by themselves.) Components come from alternating
stars over the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored, table
from .components import components

BLOCK_ROWS = 1024
SLICE_COLUMNS = 2048
#: Cells of a row's column counts: a power of two of about n / 8, in these bounds.
LEAST_CELLS, MOST_CELLS = 64, 4096
#: One in SAMPLE documents is counted to order the columns; columns that at least
#: SEEN of those hold count as frequent; MOST of them at most are told apart.
SAMPLE, SEEN, MOST = 16, 4, 1_000_000
MEMO_WORDS = 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct word n-grams of a text as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def _hash(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        self.memo[word] = h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        get, made = self.memo.get, self._hash
        h = np.array([get(w) or made(w) for w in words], np.uint64)
        k = min(self.words, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * _MULTIPLIER + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(32)
        if k < self.words:
            out ^= np.uint64(k)
        return np.unique(out)


def _prefix(tokens: np.ndarray, heavy: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 tokens, frequent ones last."""
    n = len(tokens)
    size = n - -(-percent * n // 100) + 1
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        common = heavy[at] == tokens
        if common.any():
            rare = tokens[~common]
            if len(rare) >= size:
                return rare[:size]
            rest = tokens[common][np.argsort(rank[at[common]], kind="stable")]
            return np.concatenate([rare, rest])[:size]
    return tokens[:size]


def _least_overlap(a, b, percent: int):
    """Least shared tokens of linked sets of a and b tokens."""
    return -(-percent * (a + b) // (100 + percent))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            out.extend((at, int(x)) for x in new)
            todo.extend(new.tolist())
    return out


def _cells(tokens: np.ndarray) -> bytes:
    """Counts of the tokens by their low bits, saturated (which only lowers distances)."""
    size = min(MOST_CELLS, max(LEAST_CELLS, 1 << (len(tokens) // 8).bit_length()))
    counts = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _possible(n: np.ndarray, cells: list[bytes], percent: int) -> np.ndarray:
    """Components of rows that sizes and cell counts leave as possible partners,
    as the number of each component's first row; -1 for rows without a partner.
    Rows are compared at the smaller cell number; larger ones are folded to it."""
    sizes = np.array([len(c) for c in cells])
    label, hit = np.arange(len(n)), np.zeros(len(n), bool)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes >= size)
        at = at[np.argsort(n[at], kind="stable")]
        m = n[at]
        folded = np.stack([np.frombuffer(cells[k], np.uint8).reshape(-1, size).sum(0, dtype=np.int32) for k in at])
        for k in np.flatnonzero(sizes[at] == size):
            # Partners whose size the bound permits: a contiguous range in order of size.
            lo = np.searchsorted(m, -(-percent * m[k] // 100))
            hi = np.searchsorted(m, 100 * m[k] // percent, side="right")
            total = m[lo:hi] + m[k]
            ok = np.abs(folded[lo:hi] - folded[k]).sum(1) <= total - 2 * _least_overlap(total, 0, percent)
            ok[k - lo] = False
            if ok.any():
                mine = at[lo:hi][ok]
                hit[at[k]] = True
                hit[mine] = True
                found = np.unique(np.append(label[mine], label[at[k]]))
                if len(found) > 1:
                    label[np.isin(label, found)] = found[0]
    return np.where(hit, label, -1)


def _overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Shared tokens of all rows: the product of the incidence matrix and its
    transpose, accumulated over slices of the columns that two rows hold."""
    n = len(rows)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times >= 2
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), np.float32)
    total = int(shared.sum())
    for lo in range(0, total, SLICE_COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + SLICE_COLUMNS])
        part = np.zeros((n, min(SLICE_COLUMNS, total - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def _linked(n: np.ndarray, d: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """Which rows link, from their set sizes n, the sizes d of what they are given
    by (the sets, or differences from one set) and what they have in common there."""
    shared = np.rint((n - d)[:, None] / 2 + (n - d)[None, :] / 2 + common).astype(np.int64)
    return (100 * shared >= percent * (n[:, None] + n[None, :] - shared)) & (n[:, None] > 0)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _groups(batches, keys: int):
    """Runs of rows with equal first `keys` columns, across batches of sorted rows."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(c[lo] for c in cols)
            if key != held_key:
                if held:
                    yield held_key, pa.Table.from_batches(held)
                held, held_key = [], key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held_key, pa.Table.from_batches(held)


def _sets(column) -> list[np.ndarray]:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = np.asarray(flat.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(flat.value_lengths()))])
    return [values[a:b] for a, b in zip(at, at[1:])]


def jaccard_components(docs: DataFrame, words: int, percent: int, text_col: str = "text", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A
    document's set is its distinct n-grams of `words` words, or its whole word
    sequence if it is shorter. Rows link when 100 * shared >= percent * united.
    component_id is the least id reachable by links, itself included. Null, empty
    and blank texts have an empty set and link with nothing; neither do rows with
    a null id, whose component_id is null. Rows that repeat an id are one document
    with the links of each. All links are found: nothing is sampled or capped.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def tokens_of(batches):
        cut = Shingler(words)
        for batch in batches:
            rows = [cut(t.as_py()) for t in batch.column(0)]
            yield pa.record_batch([pa.array((np.concatenate(rows) if rows else np.zeros(0, np.uint64)).view(np.int64))], ["t"])

    drawn = base.where(F.pmod(F.xxhash64("_id"), F.lit(SAMPLE)) == 0).select("_text")
    common = drawn.mapInArrow(tokens_of, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= SEEN)
    top = common.orderBy(F.desc("c"), "t").limit(MOST).toArrow()
    heavy, seen = np.asarray(top.column(0)).view(np.uint64), np.asarray(top.column(1)).astype(np.int64)
    by = np.argsort(heavy)
    shipped = docs.sparkSession.sparkContext.broadcast((heavy[by], seen[by]))

    def shingled(batches):
        cut, (heavy, rank) = Shingler(words), shipped.value
        for batch in batches:
            n, keys, cells, prefixes = [], [], [], []
            for t in batch.column(1):
                s = cut(t.as_py())
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                cells.append(_cells(s))
                prefixes.append(_prefix(s, heavy, rank, percent).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(cells, pa.binary()), _lists(prefixes)], ["_id", "n", "key", "cells", "prefix"])

    rows = stored(base.mapInArrow(shingled, "_id long, n long, key binary, cells binary, prefix array<long>"), "jaccard-rows")
    nodes = stored(rows.where("n > 0 AND _id IS NOT NULL").groupBy("key").agg(F.min("_id").alias("node")), "jaccard-nodes")
    reps = rows.alias("r").join(nodes.alias("k"), (F.col("r._id") == F.col("k.node")) & (F.col("r.key") == F.col("k.key"))).select("node", "n", "cells", "prefix")
    reps = stored(reps, "jaccard-reps")

    def meet(batches):
        """Rows sorted by (token, node): everyone who meets someone gets the
        token's least node. One row is held over from batch to batch."""
        token = first = None
        for batch in batches:
            t, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            carried = t[0] == token
            if carried:
                new[0] = False
            starts = np.flatnonzero(new)
            lead = np.full(len(t), first if carried else 0, np.int64)
            if len(starts):
                lead[starts[0] :] = np.repeat(node[starts], np.diff(np.append(starts, len(t))))
            follow = ~new
            pairs = [np.column_stack([lead[follow], node[follow]]), np.column_stack([lead[follow], lead[follow]])]
            token, first = t[-1], lead[-1]
            both = np.concatenate(pairs)
            both = np.unique(both, axis=0) if len(both) else both
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["block", "node"])

    prefix = reps.select(F.explode("prefix").alias("t"), "node")
    met = prefix.repartition("t").sortWithinPartitions("t", "node").mapInArrow(meet, "block long, node long").distinct()
    met = stored(met, "jaccard-met")

    def cut_blocks(members: DataFrame) -> DataFrame:
        """Add the keys (block, i, j) of every pair of parts a row belongs to."""
        sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        parts = F.ceil(F.col("m") / F.lit(block_rows)).cast("int")
        own = F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")
        placed = members.join(sizes, "block").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        return placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("m", "own", "other")

    def near(batches):
        """Stars over the possible partners of a block, by their cell counts."""
        for _, rows in _groups(batches, 3):
            label, node = _possible(np.asarray(rows.column("n")), rows.column("cells").to_pylist(), percent), np.asarray(rows.column("node"))
            at = np.flatnonzero(label >= 0)
            yield pa.record_batch([pa.array(node[label[at]]), pa.array(node[at])], ["a", "b"])

    blocks = cut_blocks(met).join(reps.select("node", "n", "cells"), "node").select("block", "i", "j", "node", "n", "cells")
    keys = ["block", "i", "j"]
    stars = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(near, "a long, b long")
    # A row that may have partners lies in one family, and so travels once.
    family = components(stars)
    close = stored(family.select(F.col("component").alias("block"), F.col("id").alias("node")), "jaccard-close")
    forget(met)

    # Blocks of more than block_rows rows are cut in parts; the block's least row,
    # its lead, goes to every part, all others to one.
    sizes = close.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lead")).where("m > 1")
    parts = F.ceil(F.col("m") / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("k")).cast("int")
    members = close.join(sizes, "block").withColumn("k", parts).withColumn("leads", F.col("node") == F.col("lead"))
    members = members.withColumn("part", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(own))))
    needed = members.groupBy("node").agg(F.collect_list(F.struct("block", "part", "k", "leads")).alias("at"))
    fields = {"block": pa.int64(), "part": pa.int32(), "k": pa.int32(), "leads": pa.bool_()}

    def with_sets(batches):
        cut = Shingler(words)
        for batch in batches:
            out = {f: [] for f in fields}
            nodes, rows = [], []
            for node, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                s = cut(text.as_py()).view(np.int64)
                for place in at:
                    for f in fields:
                        out[f].append(place[f])
                    nodes.append(node)
                    rows.append(s)
            yield pa.record_batch([*[pa.array(out[f], t) for f, t in fields.items()], pa.array(nodes, pa.int64()), _lists(rows)], [*fields, "node", "tokens"])

    def within(batches):
        """Links of a part; for blocks of several parts also every row's difference
        from the lead (far = 0), or its set if it is far from the lead (far = 1)."""
        floor = 0.5 - (100 - percent) / 100
        for (block, part), rows in _groups(batches, 2):
            sets, node = _sets(rows.column("tokens")), np.asarray(rows.column("node"))
            n = np.array([len(s) for s in sets])
            shared = _overlaps(sets)
            edges = _forest(_linked(n, n, shared, percent))
            a, b, far, deltas, size, who = [node[x] for x, _ in edges], [node[y] for _, y in edges], [], [], [], []
            k, leads = rows.column("k")[0].as_py(), np.asarray(rows.column("leads"))
            if k > 1:
                lead = int(np.flatnonzero(leads)[0])
                for x in range(len(sets)):
                    if leads[x] and part:
                        continue
                    near = shared[x, lead] / max(1, n[x] + n[lead] - shared[x, lead])
                    for kind, ok in ((0, near >= floor - 1e-9), (1, near < 0.5)):
                        if ok:
                            far.append(kind)
                            size.append(n[x])
                            who.append(node[x])
                            deltas.append((sets[x] if kind else np.setxor1d(sets[x], sets[lead], assume_unique=True)).view(np.int64))
            e, d = len(a), len(who)
            yield pa.record_batch(
                [
                    pa.array([*a, *[None] * d], pa.int64()), pa.array([*b, *[None] * d], pa.int64()), pa.array(np.full(e + d, block), pa.int64()), pa.array([*[None] * e, *far], pa.int32()),
                    pa.array(np.full(e + d, k), pa.int32()), pa.array([*[None] * e, *who], pa.int64()), pa.array([*[None] * e, *size], pa.int64()), _lists([*[np.zeros(0, np.int64)] * e, *deltas]),
                ],
                ["a", "b", "block", "far", "k", "node", "n", "delta"],
            )

    def across(batches):
        """Links between two parts. For rows given as differences from one lead,
        shared = (n + n' - d - d') / 2 + common differences, exactly."""
        for _, rows in _groups(batches, 4):
            sets, node, n = _sets(rows.column("delta")), np.asarray(rows.column("node")), np.asarray(rows.column("n"))
            d = np.array([len(s) for s in sets])
            edges = _forest(_linked(n, d, _overlaps(sets), percent))
            yield pa.record_batch([pa.array([node[x] for x, _ in edges], pa.int64()), pa.array([node[y] for _, y in edges], pa.int64())], ["a", "b"])

    # The same plan at every size: the rows to send on are never broadcast.
    texts = base.join(needed.hint("merge"), base["_id"] == needed["node"]).select("node", "_text", "at")
    sets = texts.mapInArrow(with_sets, "block long, part int, k int, leads boolean, node long, tokens array<long>")
    first = sets.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(
        within, "a long, b long, block long, far int, k int, node long, n long, delta array<long>"
    )
    first = stored(first, "jaccard-first")
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("k")).cast("int")
    wide = first.where("node IS NOT NULL").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("own <> other")
    wide = wide.select("block", "far", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "delta")
    pair = ["block", "far", "i", "j"]
    second = wide.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(across, "a long, b long")
    links = first.where("a IS NOT NULL").select("a", "b").unionByName(second)
    # Rows that repeat an id with other words are one document: tie their nodes.
    same = rows.where("n > 0 AND _id IS NOT NULL").select("_id", "key").join(nodes, "key").where("_id <> node").select(F.col("_id").alias("a"), F.col("node").alias("b"))
    found = stored(components(links.unionByName(same)), "jaccard-components")
    for old in (reps, close, first):
        forget(old)
    sized = stored(rows.select("_id", "n"), "jaccard-sizes")
    forget(rows)
    forget(nodes)
    return sized.join(found, sized["_id"] == found["id"], "left").select(
        sized["_id"].alias(id_col), sized["n"].alias("n_shingles"), F.coalesce(found["component"], sized["_id"]).alias("component_id")
    )


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)
