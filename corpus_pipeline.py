"""Training-corpus pipeline: classify, clean lines, drop near copies and leaks, encode.

Each stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept and returns a DataFrame; run() writes every stage's result as
Parquet and reads it back as the next stage's documents. All stages but the last
return the columns of documents. Null texts count as empty; tables without rows
give results without rows; repeated rows are rows of their own until near copies
go. Further columns pass through, whatever their names; only the last stage's own
three replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import forget, stored, table
from sievework.llm.decontaminate import add_leaks
from sievework.llm.line_dedup import line_dedup
from sievework.llm.ngram_join import jaccard_components
from sievework.llm.quality import quality_scores
from sievework.llm.spm_codec import decode, default_model, encode

#: Near copies: word shingles of five, similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row in one column, apart from what operators add."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "doc_id", "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; the fit sees no held-out
    label. Rows stay as they are."""
    scored = quality_scores(_packed(docs), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent long lines stay in one document only; n_chars follows the text. A
    text of which nothing is left stays as an empty document."""
    done = line_dedup(_packed(docs))
    out = {"text": F.col("line_result.kept_text"), "n_chars": F.char_length("line_result.kept_text").cast("long")}
    return done.select(*[(out[c] if c in out else F.col("_row")[c]).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id.
    Rows with a null id, or with no words, are in no group and stay."""
    groups = jaccard_components(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return add_leaks(_packed(docs), table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select("_row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids (packed uint32, with begin and end), the
    number of ids, and whether decoding gives the text again."""
    model = default_model()
    both = decode(encode(_packed(docs), model), model)
    new = {
        "ids_le": F.col("ids_le"),
        "n_tokens": F.expr("octet_length(ids_le) div 4").cast("long"),
        "round_trip": F.col("decoded").eqNullSafe(F.translate(F.coalesce("text", F.lit("")), "▁", " ")),
    }
    return both.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in new], *[x.alias(c) for c, x in new.items()])


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("sentencepiece encoding", encoded),
]

#: The classifier and the encoder have no SQL form; a test holds every stage against
#: a brute-force version on the small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            forget(before)
    return docs
