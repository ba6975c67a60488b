"""Exact, fuzzy and semantic deduplication of postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Rows and components of a block of vectors, pivots at most, and what rounding may
#: shift a bound by. Within a task, vectors are compared in steps of STEP rows.
BLOCK_ROWS, BLOCK_VALUES = 16_384, 1 << 20
MOST_PIVOTS = 4096
SLACK = 1e-6
STEP = 1024


def drop_repeats(df: DataFrame, key: str) -> DataFrame:
    """One row for each key; rows without a key all stay."""
    return df.where(F.col(key).isNull()).unionByName(df.where(F.col(key).isNotNull()).dropDuplicates([key]))


def fuzzy_duplicates(df: DataFrame, key: str, source: str, order: list[Column], id_col: str) -> DataFrame:
    """Add duplicate_of: within a key, in order of arrival, the first row's source
    is canonical; rows of other sources point to that row, its own source's rows stay."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct(F.col(source).alias("s"), F.col(id_col).alias("i"))).over(w)
    return df.withColumn("_f", first).withColumn("duplicate_of", F.when(F.col("_f.s") != F.col(source), F.col("_f.i"))).drop("_f")


def stored_duplicates(rows: DataFrame, stored: DataFrame, key: str = "fuzzy_hash", source: str = "source", id_col: str = "hash", order_col: str = "first_seen_at") -> DataFrame:
    """New rows with duplicate_of: the oldest active stored row of their key from
    another source. Where a key has no active stored row, the oldest new row is the
    canonical one for new rows of other sources. A row that is stored and active is
    seen again and duplicates nothing.

    Of a key, the two oldest rows of different sources decide for every source, and
    these come from one aggregation by key and source; a hot key is a hot value of an
    equality join with one row on the other side."""
    active = stored.where("is_active")
    fresh = rows.join(active.select(F.col(id_col).alias("_known")), rows[id_col] == F.col("_known"), "left_anti")
    side = lambda df, new: df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(new).alias("_new"), F.col(order_col).alias("_o"), F.col(id_col).alias("_i"), F.col(source).alias("_s"))
    first = side(active, 0).unionByName(side(fresh, 1)).groupBy("_k", "_new", "_s").agg(F.min(F.struct("_o", "_i")).alias("_f"))
    oldest = F.slice(F.sort_array(F.collect_list(F.when(F.col("_new") == 0, F.struct("_f", "_s")))), 1, 2)
    leads = first.groupBy("_k").agg(oldest.alias("_old"), F.min(F.when(F.col("_new") == 1, F.struct("_f", "_s"))).alias("_lead"))
    other = F.get(F.filter("_old", lambda x: x["_s"] != F.col(source)), F.lit(0))["_f"]["_i"]
    among_new = F.when((F.size("_old") == 0) & (F.col("_lead._s") != F.col(source)), F.col("_lead._f._i"))
    marked = fresh.join(leads, fresh[key] == F.col("_k")).select(F.col(id_col).alias("_id"), F.coalesce(other, among_new).alias("duplicate_of"))
    marked = marked.where("duplicate_of IS NOT NULL").dropDuplicates(["_id"])
    return rows.join(marked, rows[id_col] == marked["_id"], "left").drop("_id")


def _unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length one; zero vectors stay zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    v = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def open_cells(unit: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each vector, cells that may hold a vector of a cosine over threshold).

    A vector's cell is its nearest pivot's. The border between the cells of p and q is
    the great circle at right angles to p - q. On the unit sphere a vector x on p's side
    lies at the angle asin(x(p - q) / |p - q|) from it, and by the triangle inequality
    nothing beyond it is nearer to x than that. Where this angle is over acos(threshold),
    q's cell stays closed."""
    near = unit @ pivots.T
    cell = near.argmax(axis=1)
    if threshold <= 0:
        return cell, np.ones(near.shape, bool)
    lead = near[np.arange(len(unit)), cell]
    gap = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[cell]
    reach = np.sqrt(1 - min(threshold, 1.0) ** 2) + SLACK
    return cell, lead[:, None] - near <= reach * gap + SLACK


def first_near(asked: np.ndarray, order: tuple[np.ndarray, np.ndarray], held: np.ndarray, held_order: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """For each asked vector the place of the first held one, in the order of
    held_order, that comes before it and has a cosine over threshold; -1 without one.
    held must be sorted by held_order. Who has found one asks no further step."""
    out, n = np.full(len(asked), -1), len(asked)
    if not n or not len(held):
        return out
    kind = np.repeat([0, 1], [n, len(held)])  # at a tie, which is the vector itself, the asked one is first
    by = np.lexsort((kind, np.concatenate([order[1], held_order[1]]), np.concatenate([order[0], held_order[0]])))
    before = np.empty(len(by), np.int64)
    before[by] = np.cumsum(kind[by])
    for lo in range(0, n, STEP):
        left = np.arange(lo, min(lo + STEP, n))
        for at in range(0, len(held), STEP):
            left = left[before[left] > at]
            if not len(left):
                break
            hit = asked[left] @ held[at : at + STEP].T > threshold
            first = hit.argmax(axis=1)
            has = hit[np.arange(len(left)), first]
            good = has & (at + first < before[left])
            out[left[good]] = at + first[good]
            left = left[~has]
    return out


def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o, i, v = np.asarray(t["o"].combine_chunks()), np.asarray(t["i"].combine_chunks()), _unit(t["v"])
    by = np.lexsort((i, o))
    return o[by], i[by], v[by]


def semantic_cells(base: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(answers found at once, rows sent) for distinct vectors (i, o, v).

    The oldest `block_rows` rows (fewer, if these had over BLOCK_VALUES components), the
    leads, go to all tasks: whoever is near a lead has its answer, since no other row is
    older; a large family of near copies ends here. The others ask the cells that stay
    open to them. Rows sent: (cell, sub, slice, asks, i, o, v); a cell's holders are
    dealt into subs and its askers into slices of about `block_rows` rows, so that no
    group has more than a block of each.
    """
    spark = base.sparkSession
    n, wide = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block_rows = max(min(block_rows, BLOCK_VALUES // max(wide, 1)), 1)
    last = base.select(F.struct("o", "i").alias("k")).orderBy("k").limit(block_rows).agg(F.max("k").alias("k")).select("k.*").first()
    newer = (F.col("o") > F.lit(last.o)) | ((F.col("o") == F.lit(last.o)) & (F.col("i") > F.lit(last.i)))
    lead_o, lead_i, leads = _sorted(base.where(~newer).toArrow())  # a bounded number of rows
    m = int(min(max(n // block_rows, 1), MOST_PIVOTS))
    sample = base.orderBy(F.xxhash64("i"), "i").limit(m).select("v").toArrow()
    shared = spark.sparkContext.broadcast((leads, lead_o, lead_i, _unit(sample["v"])))

    @F.arrow_udf("struct<lead:long,lead_o:double,cell:int,asks:array<int>>")
    def placed(i: pa.Array, o: pa.Array, v: pa.Array) -> pa.Array:
        leads, lead_o, lead_i, pivots = shared.value
        unit = _unit(v)
        first = first_near(unit, (np.asarray(o), np.asarray(i)), leads, (lead_o, lead_i), threshold)
        cells, asks = [], []
        for lo in range(0, len(unit), STEP):
            cell, wide = open_cells(unit[lo : lo + STEP], pivots, threshold)
            cells.append(cell)
            asks += [np.flatnonzero(w).astype(np.int32) if f < 0 else [] for w, f in zip(wide, first[lo : lo + STEP])]
        known = first >= 0
        cell = np.concatenate(cells) if cells else np.empty(0)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.where(known, lead_i[first], 0), pa.int64(), mask=~known), pa.array(np.where(known, lead_o[first], 0), pa.float64(), mask=~known),
                pa.array(cell.astype(np.int32)), pa.array(asks, pa.list_(pa.int32())),
            ],
            ["lead", "lead_o", "cell", "asks"],
        )

    rows = stored(base.withColumn("p", placed("i", "o", "v")).select("i", "o", "v", "p.*"), "semantic-cells")
    at_once = rows.where("lead IS NOT NULL").select("i", F.col("lead").alias("c"), F.col("lead_o").alias("o"))
    # The leads are older than all others, and were asked by all above.
    rows = rows.where(newer)
    open_rows = rows.where("lead IS NULL").select("i", "o", "v", F.explode("asks").alias("cell"))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / block_rows), F.lit(1)).cast("int")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("h"), F.min("o").alias("since"))
    asked = open_rows.groupBy("cell").agg(F.count(F.lit(1)).alias("a"))
    # One row for each pivot, of which there are MOST_PIVOTS at most.
    cells = F.broadcast(sizes.join(asked, "cell").select("cell", "since", parts("h").alias("subs"), parts("a").alias("slices")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("i"), F.col(n)).cast("int")
    holders = rows.select("i", "o", "v", "cell").join(cells, "cell").select("cell", deal("subs").alias("sub"), spread("slices").alias("slice"), F.lit(False).alias("asks"), "i", "o", "v")
    askers = open_rows.join(cells, "cell").where(F.col("o") >= F.col("since")).select("cell", spread("subs").alias("sub"), deal("slices").alias("slice"), F.lit(True).alias("asks"), "i", "o", "v")
    return at_once, holders.unionByName(askers)


def semantic_duplicates(df: DataFrame, threshold: float, id_col: str, vector: str, order_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, duplicate_of): rows with an older row of cosine over the threshold, and
    the oldest such row. Order ties go by id. Rows without a vector have no copies;
    zero vectors have a cosine of 0 with all others.

    Exact. Rows of one vector, known by 128 bits of hashes, are one row first, so that
    copies cost nothing; the others are compared in cells (see semantic_cells), where a
    vector meets only cells that the triangle inequality leaves open. A task returns one
    row at most for each row that asks in it. Vectors are shuffled to find the first of
    their copies, and as rows sent; where few vectors have no near lead, the latter are
    little more than the vectors once.
    """
    named = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(order_col).cast("double").alias("o"), F.col(vector).cast("array<float>").alias("v"))
    if threshold > 0:
        named = named.where(F.exists("v", lambda x: x != 0))
    named = named.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    firsts = stored(named.groupBy("h", "g").agg(F.min(F.struct("o", "i", "v")).alias("f")).select("f.*", "h", "g"), "semantic-vectors")
    if firsts.isEmpty():
        return named.select(F.col("i").alias(id_col), F.col("i").alias("duplicate_of")).limit(0)
    at_once, sent = semantic_cells(firsts.select("i", "o", "v"), threshold, block_rows)

    def compare(t: pa.Table) -> pa.Table:
        o, i, v = _sorted(t.filter(t["asks"]))
        held_o, held_i, held = _sorted(t.filter(pc.invert(t["asks"])))
        if not len(i) or not len(held_i):
            return pa.table({"i": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "o": pa.array([], pa.float64())})
        found = first_near(v, (o, i), held, (held_o, held_i), threshold)
        has = found >= 0
        return pa.table({"i": i[has], "c": held_i[found[has]], "o": held_o[found[has]]})

    found = sent.groupBy("cell", "sub", "slice").applyInArrow(compare, "i long, c long, o double").unionByName(at_once)
    found = found.groupBy("i").agg(F.min(F.struct("o", "c")).alias("best"))
    # Back to all rows of a vector: copies have what the first of them has, or it.
    firsts = firsts.join(found, "i", "left").select(F.col("h").alias("_h"), F.col("g").alias("_g"), F.col("i").alias("_first"), F.col("best.c").alias("_c"))
    both = named.select("i", "h", "g").join(firsts, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")))
    copy = F.when(F.col("i") != F.col("_first"), F.col("_first")) if threshold < 1 else F.lit(None).cast("long")
    return both.select(F.col("i").alias(id_col), F.coalesce("_c", copy).alias("duplicate_of")).where("duplicate_of IS NOT NULL")


def mark_duplicates(jobs: DataFrame, found: DataFrame, key: str = "hash") -> DataFrame:
    """Set duplicate_of and deactivate the rows named in found(key, duplicate_of)."""
    f = found.select(F.col(key).alias("_k"), F.col("duplicate_of").alias("_d"))
    joined = jobs.join(f, jobs[key] == f["_k"], "left")
    return joined.withColumns(
        {"duplicate_of": F.coalesce("_d", "duplicate_of"), "is_active": F.when(F.col("_d").isNotNull(), False).otherwise(F.col("is_active"))}
    ).drop("_k", "_d")
