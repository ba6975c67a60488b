"""Work of injected models: vectors of new rows, languages, candidates and results of a re-ranker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as S

LANGUAGES = ["de", "fr", "en", "it"]


def embedded(df: DataFrame, text: Column, model: Callable[[list[str]], np.ndarray], column: str = "embedding", batch: int = 64) -> DataFrame:
    """Rows without a vector get the model's, scaled to length one; the others keep
    theirs and do not reach the model. Null texts stay without a vector."""

    @F.arrow_udf("array<float>")
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = part.to_pylist()
            found: list = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t is not None]
            for start in range(0, len(asked), batch):
                at = asked[start : start + batch]
                v = np.asarray(model([texts[i] for i in at]), np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                for i, row in zip(at, (v / np.where(norm == 0, 1, norm)).astype(np.float32)):
                    found[i] = row
            yield pa.array(found, pa.list_(pa.float32()))

    pending = F.when(F.col(column).isNull(), text)
    return df.withColumn("_new", vectors(pending)).withColumn(column, F.coalesce(F.col(column), F.col("_new"))).drop("_new")


def language(known: Column, title: Column, description: Column, guess: Column, least: float = 0.7, shortest: int = 50) -> Column:
    """The known language, else the detector's: guess is a struct(lang, prob) that
    counts from `shortest` characters and a probability of `least` on."""
    text = F.btrim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    sure = (F.char_length(text) >= shortest) & (guess["prob"] >= least)
    return F.coalesce(F.nullif(known, F.lit("")), F.when(sure & guess["lang"].isin(LANGUAGES), guess["lang"]))


def candidates(df: DataFrame, description: str = "description", tags: str = "tags", size: int = 800, most: int = 15) -> DataFrame:
    """What a re-ranker sees of a posting: the start of its description, its first tags."""
    return df.withColumns({description: F.substring(description, 1, size), tags: F.slice(tags, 1, most)})


def rerank_head(matches: DataFrame, user: str, order: list[Column], most: int = 150, head: int = 50, batch: int = 10) -> DataFrame:
    """Matches to re-rank, with their batch and place in it: all of a user with at
    most `most`, else the user's first `head`. Rows beyond most + 1 leave before the
    shuffle, so a user with many matches is no large group."""
    rank = F.row_number().over(Window.partitionBy(user).orderBy(*order))
    top = matches.withColumn("_n", rank).where(F.col("_n") <= most + 1)
    top = top.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(user)))
    chosen = top.where((F.col("_all") <= most) | (F.col("_n") <= head))
    place = F.col("_n") - 1
    return chosen.withColumns({"batch": F.floor(place / batch).cast("int"), "place": (place % batch).cast("int")}).drop("_n", "_all")


def by_place(head: DataFrame, answers: DataFrame, user: str) -> DataFrame:
    """Answers that name only the batch and the place in it, with their match; a match
    without an answer has none."""
    return head.join(answers, [user, "batch", "place"], "left")


def apply_results(matches: DataFrame, results: DataFrame, key: list[str], times: Column | None = None) -> DataFrame:
    """Matches with a re-ranker's results(key, llm, explanation, matching, missing).
    Only scores over 0 count. They replace the match's own, with the explanation and
    such skills as are not empty, and the final score is computed anew."""
    names = ("llm", "explanation", "matching", "missing")
    r = results.where("llm > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"_{c}") for c in names])
    j = matches.join(r, [matches[k] == r[f"_k{i}"] for i, k in enumerate(key)], "left")
    hit = F.col("_llm").isNotNull()
    j = j.withColumns(
        {
            "score_llm": F.when(hit, F.round(F.col("_llm") / 100.0, 4)).otherwise(F.col("score_llm")),
            "explanation": F.when(hit, F.coalesce("_explanation", F.lit(""))).otherwise(F.col("explanation")),
            "matching_skills": F.when(hit & (F.size("_matching") > 0), F.col("_matching")).otherwise(F.col("matching_skills")),
            "missing_skills": F.when(hit & (F.size("_missing") > 0), F.col("_missing")).otherwise(F.col("missing_skills")),
        }
    )
    parts = {k: F.col(f"score_{k}") for k in S.DEFAULT_WEIGHTS}
    final = F.bround(S.final_score(parts, F.col("score_weights")) * (times if times is not None else F.lit(1.0)), 2)
    return j.withColumn("score_final", F.when(hit, final).otherwise(F.col("score_final"))).select(*matches.columns)


def rejoined(matches: DataFrame, reranked: DataFrame, user: str, key: list[str], order: list[Column], score: str = "score_final") -> DataFrame:
    """All of a user's matches after a re-ranker saw some of them: rows of `reranked`
    (columns of matches) stand in for their match, the tail stays as it was, and both
    are ranked together: by score, those of equal score in their order before."""
    place = F.row_number().over(Window.partitionBy(user).orderBy(*order))
    before = matches.withColumn("_place", place)
    head = reranked.select(*matches.columns).join(before.select(*key, "_place"), key)
    tail = before.join(reranked.select(*key), key, "left_anti")
    both = head.select(*matches.columns, "_place").unionByName(tail)
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(score), "_place"))
    return both.withColumn("rank", rank).drop("_place")
