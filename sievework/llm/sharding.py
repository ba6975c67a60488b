"""Sharding by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked. Linked documents start in shards drawn by
hash; in each round every cluster of linked documents asks for the shard that
holds most of its bytes, and the moves from shard to shard are granted in part,
by quotas that keep every shard at its capacity. The quotas come from a table of
at most shards x shards sums. Links are stars around the text's digest, so a
group costs as many rows as it has documents.

Groups over a 64th of a shard, in bytes or rows (2 x 64 x shards at most), would be
too coarse for quotas. They get their shards one by one, the largest first to the
lowest shard, and their rows start there; a group is cut only by what its shard has
no room for, and never meets in one task. Documents without links then fill each
shard to the same level, which cuts no link: the few that are larger than a 64th of
a shard (64 x shards at most) go one by one to the lowest shard, the others are laid
along one running sum.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored, table

SHARDS = 40
ROUNDS = 4
#: Groups of the running sums; each bounds one task's share of the rows.
FILL_BUCKETS = 4096
SLOT_BUCKETS = 64
#: A document or group of more than 1/LARGE of a shard is placed by itself.
LARGE = 64


def _quotas(wanted: dict, loads: dict, capacity: float, shards: int, passes: int = 60) -> dict:
    """Shares of the wanted bytes (source, target) that may move, such that no
    shard ends above max(capacity, its load)."""
    grant = {k: 1.0 for k in wanted}
    for _ in range(passes):
        calm = True
        for t in range(shards):
            inflow = sum(b * grant[k] for k, b in wanted.items() if k[1] == t)
            outflow = sum(b * grant[k] for k, b in wanted.items() if k[0] == t)
            over = loads.get(t, 0) + inflow - outflow - max(capacity, loads.get(t, 0))
            if inflow > 0 and over > 1e-6 * capacity:
                calm = False
                for k in wanted:
                    if k[1] == t:
                        grant[k] *= max(0.0, 1 - over / inflow)
        if calm:
            break
    return grant


def _level(loads: list[float], free: float) -> list[float]:
    """How much of `free` each shard takes so that the lowest loads rise to one level."""
    order = sorted(range(len(loads)), key=lambda s: loads[s])
    rest, height = free, loads[order[0]]
    for i, s in enumerate(order):
        step = ((loads[order[i + 1]] - height) if i + 1 < len(order) else float("inf")) * (i + 1)
        if step >= rest:
            height += rest / (i + 1)
            break
        rest -= step
        height = loads[order[i + 1]]
    return [max(0.0, height - x) for x in loads]


def _bounds(loads: list[float], free: float) -> list[float]:
    """Ends of the stretches that the shards take of `free` (see _level)."""
    return list(accumulate(_level(loads, free)))


def _shard_of(place, bounds: list[float]):
    """The shard in whose stretch a place lies."""
    ends = F.array(*[F.lit(x) for x in bounds[:-1]]) if len(bounds) > 1 else F.array().cast("array<double>")
    return F.size(F.filter(ends, lambda x: x <= place))


def _seats(groups: list[tuple[bytes, int]], shards: int, capacity: float) -> dict[bytes, list[tuple[float, int]]]:
    """Of each group: (upper end of its share of the rows, shard), the largest group
    first, each in the lowest shard. What a shard has no room for goes on to the next."""
    heap = [(0.0, s) for s in range(shards)]
    out: dict[bytes, list[tuple[float, int]]] = {}
    for digest, size in sorted(groups, key=lambda x: (-x[1], x[0])):
        left, own = float(size), []
        while True:
            load, s = heap[0]
            part = min(left, max(capacity - load, capacity / LARGE))
            if left - part < capacity / LARGE / 4:
                part = left
            heapq.heapreplace(heap, (load + part, s))
            left -= part
            own.append((1.0 if left <= 0 else 1 - left / size, s))
            if left <= 0:
                break
        out[bytes(digest)] = own
    return out


def balanced_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    text_col: str = "text",
    id_col: str = "doc_id",
    rounds: int = ROUNDS,
    fill_buckets: int = FILL_BUCKETS,
    slot_buckets: int = SLOT_BUCKETS,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16; null counts as the empty text, and
    null and empty texts are one group. The law is `bytes`: shard sizes are as
    near equal as whole documents allow. Repeated rows are placed one by one,
    null ids like any other value; other columns are not read. An empty table gives
    an empty result. slot runs from 0 without gaps within a shard.
    grown_shard is always null: another shard count would move other rows too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stored(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(16)).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.unhex(F.sha2(text, 256)).alias("_digest"),
            F.monotonically_increasing_id().alias("_row"),
        ).withColumn("_hash", F.xxhash64("_id", "_row", "_digest")),
        "shard-base",
    )
    total, count = (x or 0 for x in base.agg(F.sum("_size"), F.count(F.lit(1))).first())
    capacity = max(1.0, total / shards)

    groups = stored(base.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_bytes")).where("_n > 1"), "shard-groups")
    big = (F.col("_bytes") > capacity / LARGE) | (F.col("_n") > count / shards / LARGE)
    seats = _seats([(r[0], r[1]) for r in groups.where(big).select("_digest", "_bytes").collect()], shards, capacity)  # 2 x LARGE x shards at most
    seated = docs.sparkSession.createDataFrame([(d, [x[0] for x in own], [x[1] for x in own]) for d, own in seats.items()], "_digest binary, _ends array<double>, _seats array<int>")
    columns = ["_id", "_size", "_crc", "_row", "_hash"]
    known = base.join(F.broadcast(seated), "_digest", "left")
    # Rows of a group that is cut are numbered through: counts of its buckets, then places within a bucket.
    cut = known.where(F.size("_ends") > 1).withColumn("_bucket", F.pmod("_hash", F.lit(fill_buckets)))
    counts = cut.groupBy("_digest", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_digest = Window.partitionBy("_digest")
    counts = counts.select("_digest", "_bucket", (F.sum("_n").over(by_digest.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(by_digest).alias("_all"))
    place = (F.col("_before") + F.row_number().over(Window.partitionBy("_digest", "_bucket").orderBy("_hash", "_row")) - 0.5) / F.col("_all")
    cut = cut.join(F.broadcast(counts), ["_digest", "_bucket"]).withColumn("_place", place)  # fill_buckets x (shards + cuts) rows
    cut = cut.withColumn("_label", F.col("_seats")[F.size(F.filter("_ends", lambda x: x <= F.col("_place")))])
    known = known.where(F.coalesce(F.size("_ends"), F.lit(0)) <= 1).withColumn("_label", F.col("_seats")[0])
    small = known.where("_label IS NULL").join(groups.where(~big).select("_digest", F.lit(True).alias("_linked")), "_digest", "left")
    state = stored(
        known.where("_label IS NOT NULL").unionByName(cut.select(*known.columns)).select(*columns, F.lit(None).cast("long").alias("_cluster"), "_label").unionByName(
            small.select(*columns, F.when(F.col("_linked"), F.xxhash64("_digest")).alias("_cluster"), F.lit(None).cast("int").alias("_label"))
        ),
        "shard-state",
    )
    forget(groups)
    forget(base)
    fixed = state.where("_label IS NOT NULL")
    fixed_loads = {r[0]: r[1] for r in fixed.groupBy("_label").agg(F.sum("_size")).collect()}
    linked = state.where(F.col("_cluster").isNotNull())
    room = _bounds([float(fixed_loads.get(s, 0)) for s in range(shards)], float(linked.agg(F.sum("_size")).first()[0] or 0))
    draw = F.pmod(F.xxhash64("_hash", F.lit(1)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.lit(room[-1])
    linked = linked.withColumn("_label", _shard_of(draw, room))
    scratch = []
    for turn in range(rounds):
        held = stored(linked.groupBy("_cluster", "_label").agg(F.sum("_size").alias("_b")), "shard-held")
        wish = held.groupBy("_cluster").agg(F.max_by("_label", F.struct("_b", F.xxhash64("_cluster", "_label"))).alias("_want"))
        moves = stored(held.join(wish, "_cluster").where("_label <> _want"), "shard-moves")
        loads = Counter(fixed_loads) + Counter({r[0]: r[1] for r in held.groupBy("_label").agg(F.sum("_b")).collect()})
        wanted = {(r[0], r[1]): r[2] for r in moves.groupBy("_label", "_want").agg(F.sum("_b")).collect()}
        grant = _quotas(wanted, loads, capacity, shards)
        if not any(x > 1e-6 for x in grant.values()):
            forget(held)
            forget(moves)
            break
        table_of = F.create_map(*[F.lit(x) for (a, b), g in grant.items() for x in (a * shards + b, float(g))])
        draw = F.pmod(F.xxhash64("_cluster", F.lit(turn)), F.lit(1_000_003)) / F.lit(1_000_003.0)
        granted = moves.where(draw < table_of[F.col("_label") * shards + F.col("_want")]).select("_cluster", "_label", "_want")
        linked = stored(
            linked.join(granted, ["_cluster", "_label"], "left").withColumn("_label", F.coalesce("_want", "_label")).drop("_want"),
            "shard-labels",
        )
        forget(held)
        forget(moves)
        for done in scratch:
            forget(done)
        scratch = [linked]

    loads = Counter(fixed_loads) + Counter({r[0]: r[1] for r in linked.groupBy("_label").agg(F.sum("_size")).collect()})
    free = state.where("_cluster IS NULL AND _label IS NULL").drop("_label")
    large = F.col("_size") > capacity / LARGE
    heap = [(float(loads.get(s, 0)), s) for s in range(shards)]
    heapq.heapify(heap)
    alone = {}
    for row, size in free.where(large).select("_row", "_size").orderBy(F.desc("_size"), "_row").collect():  # LARGE x shards at most
        load, s = heap[0]
        alone[row] = s
        heapq.heapreplace(heap, (load + size, s))
    placed_alone = free.where(F.lit(False)).withColumn("_label", F.lit(0))
    if alone:
        seats = docs.sparkSession.createDataFrame(list(alone.items()), "_row long, _label int")
        placed_alone = free.where(large).join(F.broadcast(seats), "_row")
    free = free.where(~large)
    free_bytes = free.agg(F.sum("_size")).first()[0] or 0
    bounds = _bounds([x for x, _ in sorted(heap, key=lambda x: x[1])], float(free_bytes))
    free = free.withColumn("_bucket", F.pmod("_hash", F.lit(fill_buckets)))
    sums = free.groupBy("_bucket").agg(F.sum("_size").alias("_b"))
    before = sums.select("_bucket", (F.sum("_b").over(Window.orderBy("_bucket")) - F.col("_b")).alias("_before"))
    within = Window.partitionBy("_bucket").orderBy("_hash", "_row").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_before") + F.sum("_size").over(within) - F.col("_size") / 2
    filled = free.join(F.broadcast(before), "_bucket").withColumn("_middle", middle).withColumn("_label", _shard_of(F.col("_middle"), bounds))
    columns.append("_label")
    placed = fixed.select(*columns)
    for part in (linked, placed_alone, filled):
        placed = placed.unionByName(part.select(*columns))
    placed = stored(placed.withColumn("_bucket", F.pmod("_hash", F.lit(slot_buckets))), "shard-placed")
    for done in [state, *scratch]:
        forget(done)
    counts = placed.groupBy("_label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_label", "_bucket", (F.sum("_n").over(Window.partitionBy("_label").orderBy("_bucket")) - F.col("_n")).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_hash", "_row")) - 1
    return placed.join(F.broadcast(first), ["_label", "_bucket"]).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_label").cast("int").alias("shard"),
        (F.col("_first") + number).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark, sf_dir):
    return balanced_shards(table(spark, sf_dir, "documents"))
