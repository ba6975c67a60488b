"""Answers of language models as tables: fences, JSON lists, cut objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pair of a number and a text within an answer, quotes escaped.
PAIR = r'"(\d+)"\s*:\s*"((?:[^"\\]|\\.)*)"'
# End of fixed values.

SPACE = " \t\n\x0b\x0c\r"
NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")


def unfenced(raw: Column) -> Column:
    """The text without white space at its ends and without a markdown fence."""
    text = F.btrim(raw, F.lit(SPACE))
    # The first line goes, all of the text where it is the only one.
    rest = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"\A[^\n]*\n", "")).otherwise("")
    closed = F.when(F.endswith(rest, F.lit("```")), F.btrim(F.left(rest, F.char_length(rest) - 3), F.lit(SPACE))).otherwise(rest)
    return F.when(F.startswith(text, F.lit("```")), closed).otherwise(text)


def _kind(v: Column) -> Column:
    """Type of a variant's value, without precision."""
    return F.regexp_replace(F.schema_of_variant(v), r"[(<].*", "")


def ranked_answers(batches: DataFrame, raw: str, size: str, keys: list[str]) -> DataFrame:
    """(keys, index, score, matching_skills, missing_skills, reason, fallback): what a
    re-ranker answered for each batch of `size` candidates.

    An answer is a JSON list of objects. Absent members have defaults (index and score
    0, no skills, no reason), scores are held to 0..100. Where the answer is null, no
    JSON, no list, or has an element that is no object or whose index or score is no
    number, all rows of the batch are fallbacks: each candidate's index with score 0.
    An empty list has no rows. Skills that are no list count as none.
    """
    parsed = batches.withColumn("_v", F.try_parse_json(unfenced(F.col(raw))))
    item = lambda x, path, kind: F.try_variant_get(x, path, kind)
    number = lambda x, path: F.variant_get(x, path, "variant").isNull() | _kind(F.variant_get(x, path, "variant")).isin(*NUMBERS, "DECIMAL")
    listed = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("ARRAY<")), F.lit(False))
    elements = F.when(listed, F.try_variant_get("_v", "$", "array<variant>"))
    fine = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT<")) & number(x, "$.index") & number(x, "$.score")
    whole = listed & F.coalesce(F.forall(elements, fine), F.lit(False))
    parsed = parsed.withColumn("_items", F.when(whole, elements)).drop("_v")
    good = parsed.where("_items IS NOT NULL").select(*keys, F.explode("_items").alias("_x"))
    good = good.select(
        *keys,
        F.coalesce(item("_x", "$.index", "int"), F.lit(0)).alias("index"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(item("_x", "$.score", "double"), F.lit(0.0)))).alias("score"),
        *[F.coalesce(item("_x", f"$.{c}", "array<string>"), F.array().cast("array<string>")).alias(c) for c in ("matching_skills", "missing_skills")],
        F.coalesce(item("_x", "$.reason", "string"), F.lit("")).alias("reason"),
        F.lit(False).alias("fallback"),
    )
    none = F.array().cast("array<string>")
    poor = parsed.where(F.col("_items").isNull() & (F.col(size) > 0)).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col(size).cast("int") - 1)).alias("index"), F.lit(0.0).alias("score"), none.alias("matching_skills"), none.alias("missing_skills"), F.lit("").alias("reason"), F.lit(True).alias("fallback")
    )
    return good.unionByName(poor)


def salvaged_pairs(text: Column) -> Column:
    """map(number, text) of the whole pairs in a cut or malformed object; of pairs with
    one number, the last. Values whose escapes do not parse stay as written."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(PAIR), 1).alias("k"), F.regexp_extract_all(text, F.lit(PAIR), 2).alias("v"))
    plain = lambda v: F.coalesce(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), v, F.lit('"'))), "$", "string"), v)
    last = F.transform(pairs, lambda x: F.struct(x["k"].alias("k"), plain(x["v"]).alias("v")))
    return _last_of(last)


def _last_of(entries: Column) -> Column:
    """A map of entries, the last of equal keys."""
    return F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])),
    )


def answer_map(raw: Column) -> Column:
    """map(key, text) of an answer that is one JSON object, whatever stands around it;
    what is left whole of one that does not parse; null where nothing is."""
    text = unfenced(raw)
    first, last = F.locate("{", text), F.char_length(text) - F.locate("}", F.reverse(text)) + 1
    inner = F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substring(text, first, last - first + 1)).otherwise(text)
    whole = F.when(F.startswith(F.schema_of_variant(F.try_parse_json(inner)), F.lit("OBJECT<")), F.try_variant_get(F.try_parse_json(inner), "$", "map<string,string>"))
    parts = salvaged_pairs(inner)
    return F.coalesce(whole, F.when(F.size(parts) > 0, parts))


def answers_by_number(batches: DataFrame, raw: str, asked: str, keys: list[str]) -> DataFrame:
    """(keys, place, asked, answer): each text of the array `asked`, whose places are
    the numbers of the answer's object, with its answer; null where it has none, or
    only white space."""
    rows = batches.withColumn("_m", answer_map(F.col(raw))).select(*keys, "_m", F.posexplode(asked).alias("place", "asked"))
    text = F.btrim(F.col("_m")[F.col("place").cast("string")], F.lit(SPACE))
    return rows.select(*keys, "place", "asked", F.nullif(text, F.lit("")).alias("answer"))
