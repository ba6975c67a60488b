"""Centroid clustering by plain Lloyd rounds in exact integers.

Vectors become integers, floor(scale * x). A round broadcasts the centroids
(k x components numbers, which the parameters bound); each task computes the squared
differences to every centroid in NumPy, takes the least and adds its vectors up, and
a groupBy merges the tasks' sums. Nothing but these k x components sums reaches the
driver. Integers that squares of 64 bits might not hold are Python's own, in object
arrays under the same operations, and sums travel as limbs, so that results are exact
for every finite component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Rounds, centroids, components and scale of the registered query.
ROUNDS, CENTROIDS, COMPONENTS, SCALE = 3, 16, 64, 64
#: Sums are split into limbs of this many bits, each added up as a long.
LIMB_BITS = 40
_LONG_MAX = 2**63 - 1


def whole_vector(vec: Column, components: int) -> Column:
    """Whether a vector has just so many components, none null or non-finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == components) & fine, F.lit(False))


def _limit(components: int) -> int:
    """Integers up to this have squared distances below 2 ** 62."""
    return math.isqrt(2**62 // max(components, 1)) // 2


def integers(vectors, scale: float, components: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where one is too large."""
    rows = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, components))
    # Large doubles are integers already; a product beyond double is taken exactly.
    with np.errstate(over="ignore"):
        found = np.floor(rows * scale)
    if not found.size or np.abs(found).max() <= _limit(components):
        return found.astype(np.int64)
    whole = [[int(f) if math.isfinite(f) else math.floor(int(x) * scale) for f, x in zip(fs, xs)] for fs, xs in zip(found.tolist(), rows.tolist())]
    return np.array(whole, dtype=object)


def as_array(centroids: list[tuple[int, ...]], components: int) -> np.ndarray:
    largest = max((abs(x) for c in centroids for x in c), default=0)
    kind = np.int64 if largest <= _limit(components) else object
    return np.array(centroids, dtype=kind).reshape(len(centroids), components)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smallest of equals, and squared distance."""
    if centroids.dtype == object:
        rows = rows.astype(object)
    far = np.empty((len(centroids), len(rows)), dtype=np.result_type(rows, centroids))
    for i, c in enumerate(centroids):
        apart = rows - c
        far[i] = (apart * apart).sum(axis=1)
    which = far.argmin(axis=0)
    return which, far[which, np.arange(len(rows))]


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """(limb, value) with total = sum of value << limb * LIMB_BITS."""
    sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        if part := rest & ((1 << LIMB_BITS) - 1):
            yield limb, sign * part
        rest >>= LIMB_BITS
        limb += 1


def starting_centroids(vectors: DataFrame, k: int, id_col: str, vec_col: str, scale: float, components: int) -> list[tuple[int, ...]]:
    """The k vectors with the smallest sha256 of `1:<id>`, in that order; of equal
    ids, the one with the smaller components comes first. Rows without an id are none."""
    order = F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256)
    rows = vectors.where(F.col(id_col).isNotNull()).select(order.alias("o"), F.col(vec_col).alias("v")).orderBy("o", "v").limit(k).collect()
    return [tuple(int(x) for x in row) for row in integers([r["v"] for r in rows], scale, components)]


def lloyd_round(vectors: DataFrame, centroids: list[tuple[int, ...]], vec_col: str, scale: float, components: int) -> list[tuple[int, ...]]:
    """Every centroid with vectors becomes their componentwise floor(sum / count)."""
    shared = vectors.sparkSession.sparkContext.broadcast(as_array(centroids, components))

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(shared.value)
        counts, totals = np.zeros(k, np.int64), np.zeros((k, components), object)
        for frame in frames:
            rows = integers(frame["v"].to_list(), scale, components)
            which, _ = nearest(rows, shared.value)
            for c in np.unique(which):
                own = rows[which == c]
                counts[c] += len(own)
                totals[c] += own.sum(axis=0).astype(object)
        out = [(c, -1, 0, int(counts[c])) for c in range(k) if counts[c]]
        out += [(c, i, limb, part) for c in range(k) if counts[c] for i in range(components) for limb, part in limbs(int(totals[c, i]))]
        yield pd.DataFrame(out, columns=["cluster", "component", "limb", "total"])

    parts = vectors.select(F.col(vec_col).alias("v")).mapInPandas(added, "cluster int, component int, limb int, total long")
    merged = parts.groupBy("cluster", "component", "limb").agg(F.sum("total").alias("total")).collect()
    shared.destroy()
    counts = {r["cluster"]: r["total"] for r in merged if r["component"] < 0}
    totals = {c: [0] * components for c in counts}
    for r in merged:
        if r["component"] >= 0:
            totals[r["cluster"]][r["component"]] += r["total"] << (LIMB_BITS * r["limb"])
    return [tuple(t // counts[c] for t in totals[c]) if c in counts else old for c, old in enumerate(centroids)]


def lloyd(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: float = SCALE,
    components: int = COMPONENTS,
) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(assigned, centroids): a row (id, cluster int, distance long, the squared
    Euclidean one) for each kept vector, written out, and the final centroids.

    Kept are vectors with just `components` components, none null or non-finite;
    others, null vectors included, have no row. Rows are rows: one that repeats an id
    counts again and is assigned by its own vector, and a null id is assigned but
    never starts a centroid. With fewer than k vectors to start from, there are that
    many centroids; without any, no rows are assigned. Ties go to the smaller number;
    a centroid without vectors stays. A distance that no long holds is null. Further
    columns are left out, whatever their names.
    """
    kept = vectors.where(whole_vector(F.col(vec_col), components)).select(id_col, vec_col)
    centroids = starting_centroids(kept, k, id_col, vec_col, scale, components)
    if not centroids:
        kept, rounds = kept.limit(0), 0
    for _ in range(rounds):
        centroids = lloyd_round(kept, centroids, vec_col, scale, components)
    final = as_array(centroids, components)

    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                which, far = nearest(integers(frame["_v"].to_list(), scale, components), final)
                fits = [int(d) if d <= _LONG_MAX else None for d in far]
                yield pd.DataFrame({"_id": frame["_id"], "cluster": which.astype(np.int32), "distance": pd.array(fits, "Int64")})

    # Ids travel as text so that null ones do not turn the others into floats.
    rows = kept.select(F.col(id_col).cast("string").alias("_id"), F.col(vec_col).alias("_v"))
    out = rows.mapInPandas(assigned, "_id string, cluster int, distance long")
    id_type = vectors.schema[id_col].dataType
    return stored(out.select(F.col("_id").cast(id_type).alias(id_col), "cluster", "distance"), "centroids"), centroids


def inertias(assigned: DataFrame) -> DataFrame:
    """Sums of distances by cluster, exact; null where no long holds them."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    whole = F.when(F.count("distance") == F.count(F.lit(1)), total)
    return assigned.groupBy("cluster").agg(whole.alias("_inertia"))


def op13_centroid_clustering(spark, sf_dir):
    assigned, centroids = lloyd(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["_inertia"] for r in inertias(assigned).collect()}  # at most k rows
    fits = lambda x: int(x) if x is not None and x <= _LONG_MAX else None
    whole = fits(None if None in sums.values() else sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    clusters = spark.createDataFrame(
        [(c, fits(s), whole, digest(c)) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # At most one row for each of the 16 centroids.
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Rounds one after the other; each takes the centroids of the one before."""
    nearest_sql = """SELECT vec_id, v, rn, i AS cluster, d AS distance FROM (
  SELECT k.vec_id, k.v, k.rn, c.i, list_sum(list_transform(range(1, 65), lambda p: (k.v[p] - c.v[p]) * (k.v[p] - c.v[p]))) AS d
  FROM kept k, c{r} c) QUALIFY row_number() OVER (PARTITION BY rn ORDER BY d, i) = 1"""
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS ({nearest_sql.format(r=r)})")
        steps.append(
            f"m{r} AS (SELECT cluster, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x\n"
            f"  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{r}) GROUP BY cluster, p)"
        )
        steps.append(
            f"c{r + 1} AS (SELECT c.i, coalesce(n.v, c.v) AS v FROM c{r} c\n"
            f"  LEFT JOIN (SELECT cluster, list(x ORDER BY p) AS v FROM m{r} GROUP BY cluster) n ON n.cluster = c.i)"
        )
    steps.append(f"f AS ({nearest_sql.format(r=ROUNDS)})")
    body = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v, row_number() OVER () AS rn
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, v FROM (
  SELECT v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM kept WHERE vec_id IS NOT NULL) ORDER BY h LIMIT {CENTROIDS}),
{body}
SELECT f.vec_id, CAST(f.cluster AS INTEGER) AS cluster, CAST(f.distance AS BIGINT) AS distance,
       CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(f.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} c ON c.i = f.cluster
"""


OP13_SQL = _sql()
