"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches. The store holds every line key once, in the run of the
batch that saw it first, with the number of that batch's documents and the largest
id; runs are bucketed by the 128-bit key hash and sorted within buckets. A new batch
is counted by key and merge-anti-joined with the runs: what no run has becomes the
batch's own run, and what some run has goes to a log of repeats. When a level holds
`fanout` runs they are compacted into one run of the next level, whose keys differ.
Runs are joined and compacted bucket by bucket, without a shuffle of their rows; Spark
does not trust the order of bucket files and sorts a bucket again as it reads it.

A frequent line either had enough documents in its first batch or is in the log, so
only the log and the first entries that it names are added up: lines of one batch,
most of all, are never counted again. A line that a third of all documents hold is
one row of a run and one of each batch's log; the one join that meets it once for
each document is a sort-merge join whose skewed partition AQE splits.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, forget, shared_dir, stored, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
_STRIP = SPACE.encode()


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line stripped of ASCII white space with A-Z lower-cased;
    None if that has fewer than min_chars code points."""
    line = line.strip(_STRIP)
    if len(line) < min_chars or (not line.isascii() and len(line.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())


def line_keys(docs: DataFrame, text_col: str, id_col: str, min_chars: int) -> DataFrame:
    """(id, key) once for each distinct long line of a document."""

    def found(batches):
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {line_key(x, min_chars) for x in t.as_py().encode().split(b"\n")} - {None}
                ids.extend([i] * len(own))
                keys.extend(own)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["_id", "_key"])

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col)).mapInArrow(found, "_id long, _key binary")


class LineRuns:
    """Levelled runs of (key, n_docs, keep_id), each key in one run, and the log of
    repeats, as bucketed tables below the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.levels: list[list[str]] = []
        self.log: DataFrame | None = None
        self.tables: list[str] = []

    def _saved(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "_key").sortBy("_key").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        self.tables.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Take in one batch of (id, key) rows; a document lies in one batch."""
        batch = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("_id").alias("keep_id"))
        runs = self.runs()
        if not runs:
            self._put(0, self._saved(batch))
            return
        batch = self.spark.table(counted := self._saved(batch))
        fresh = repeats = batch
        for run in runs:
            fresh = fresh.join(run.select("_key").hint("merge"), "_key", "left_anti")
        fresh = self._saved(fresh)
        repeats = stored(batch.join(self.spark.table(fresh).select("_key").hint("merge"), "_key", "left_anti"), "line-repeats")
        self.log = repeats if self.log is None else self.log.unionByName(repeats)
        self._drop(counted)
        self._put(0, fresh)

    def _put(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            parts, self.levels[level] = self.levels[level], []
            merged = self.spark.table(parts[0])
            for p in parts[1:]:
                merged = merged.unionByName(self.spark.table(p))
            self._put(level + 1, self._saved(merged))
            for p in parts:
                self._drop(p)

    def _drop(self, name: str) -> None:
        forget(self.spark.table(name))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.remove(name)

    def frequent(self, min_docs: int) -> DataFrame:
        """(key, keep_id) of the lines in at least min_docs documents, written out."""
        totals = [F.sum("n_docs").alias("n_docs"), F.max("keep_id").alias("keep_id")]
        again = None if self.log is None else stored(self.log.groupBy("_key").agg(*totals), "line-again")
        out = None
        for run in self.runs():
            if again is None:
                rows = run
            else:
                more = again.select("_key", F.col("n_docs").alias("_n"), F.col("keep_id").alias("_k"))
                rows = run.join(more.hint("merge"), "_key", "left").select("_key", (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("keep_id", "_k").alias("keep_id"))
            rows = rows.where(F.col("n_docs") >= min_docs).select("_key", "keep_id")
            out = rows if out is None else out.unionByName(rows)
        out = stored(out, "line-frequent")
        for done in (again, self.log):
            if done is not None:
                forget(done)
        for name in list(self.tables):
            self._drop(name)
        return out


def line_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """The input's columns plus line_result: struct(n_lines, n_dropped, kept_text).

    Lines are split at line feeds only. A line whose key (see line_key) is in at
    least min_docs documents stays in the document with the largest id that holds
    it and goes everywhere else; within the keeper all its copies stay. Null and
    empty texts are one empty line. Rows with a null id are neither counted nor
    changed; rows that repeat an id count as one document and lose the same lines.
    Other columns stay, but one already named line_result is replaced. An empty
    table gives an empty result. Documents are dealt to the batches by a hash of the
    id; their number and the fan-out change the runs, never the result.
    """
    spark = docs.sparkSession
    own_id, own_drop = (f"_{uuid.uuid4().hex}" for _ in range(2))  # no name of the input's
    keys = line_keys(docs, text_col, id_col, min_chars).withColumn("_batch", F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int"))
    keys = stored(keys, "line-keys", ["_batch"])
    runs, again = LineRuns(spark, fanout), _repeats(docs, id_col)
    for b in range(batches):
        batch = keys.where(F.col("_batch") == b).select("_id", "_key")
        runs.add(batch.distinct() if again else batch)
    frequent = runs.frequent(min_docs)
    gone = keys.join(frequent, "_key").where(F.col("_id") != F.col("keep_id"))
    drops = stored(gone.groupBy(F.col("_id").alias(own_id)).agg(F.collect_set("_key").alias(own_drop)), "line-drops")
    forget(keys)
    forget(frequent)

    @F.arrow_udf("struct<n_lines:long,n_dropped:long,kept_text:string>")
    def applied(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        n, d, kept = [], [], []
        for t, gone in zip(texts, dropped):
            lines = (t.as_py() or "").encode().split(b"\n")
            n.append(len(lines))
            if gone.is_valid and len(gone):
                gone = set(gone.as_py())
                lines = [x for x in lines if line_key(x, min_chars) not in gone]
            d.append(n[-1] - len(lines))
            kept.append(b"\n".join(lines))
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_lines", "n_dropped", "kept_text"]
        )

    # The same join at every size: where drops were small, Spark would broadcast them.
    both = docs.join(drops.hint("merge"), docs[id_col].cast("long") == drops[own_id], "left")
    return both.withColumn("line_result", applied(docs[text_col], drops[own_drop])).drop(own_id, own_drop)


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id repeats: only then must keys be made distinct again. Row and
    distinct counts of a long column; no text is read."""
    n, d = docs.where(F.col(id_col).isNotNull()).select(id_col).groupBy(id_col).count().agg(F.sum("count"), F.count(F.lit(1))).first()
    return (n or 0) != d


def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id",
        F.col("line_result.n_lines").alias("n_lines"),
        F.col("line_result.n_dropped").alias("n_dropped"),
        F.sha2("line_result.kept_text", 256).alias("kept_sha256"),
    )


OP9_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND f.keep_id <> k.doc_id) AS gone
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
