"""Exact deduplication by a heavy-hitter split (DataFrame functions only).

One scan makes a digest per row. A Misra-Gries sketch (Spark's approx_top_k, a
frequent-items sketch of `tracked` counters) proposes the digests that may be
frequent; an exact count over just those verifies them. At most `heavy_parts`
digests can reach 1/heavy_parts of the rows, so the verified table has a proven
size and is broadcast: frequent rows get their group's facts on the map side and
never meet in one task. The other digests, whose groups are smaller than that
share, are counted by an ordinary shuffle of partly counted digests and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

HEAVY_PARTS = 1024
TRACKED = 8192


def exact_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    heavy_parts: int = HEAVY_PARTS,
    tracked: int = TRACKED,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts
    as the empty text. The row with the largest id stays; null ids sort lowest.
    Of rows that repeat the id as well, exactly one stays. An empty table gives
    an empty result; other columns of the input are not read.
    """
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = stored(
        docs.select(F.col(id_col).alias("_id"), F.unhex(digest).alias("_digest"), F.monotonically_increasing_id().alias("_row")),
        "exact-digests",
    )
    proposed = rows.agg(
        F.expr(f"approx_top_k(xxhash64(_digest), {tracked // 4}, {tracked})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    least = max(2, -(-proposed["n"] // heavy_parts))
    keys = [x["item"] for x in proposed["top"] or []]
    facts = [F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_row")).alias("_keep")]
    winners = rows.where(F.xxhash64("_digest").isin(keys)).groupBy("_digest").agg(*facts).where(F.col("_n") >= least)
    split = rows.join(F.broadcast(winners), "_digest", "left")
    light = split.where(F.col("_n").isNull()).drop("_n", "_keep")
    light = light.join(light.groupBy("_digest").agg(*facts), "_digest")
    both = split.where(F.col("_n").isNotNull()).unionByName(light)
    return both.select(
        F.col("_id").alias(id_col),
        F.col("_keep._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_keep._row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
