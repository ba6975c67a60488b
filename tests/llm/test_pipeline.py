"""Every stage of the corpus pipeline against a brute-force version of it."""

import re

import corpus_pipeline
import sentencepiece
from helpers import frame, lower
from pyspark.sql import functions as F
from test_decontaminate import leaked
from test_dedup import brute_lines

from sievework.llm.decontaminate import ItemIndex
from sievework.llm.quality import op7_quality_classifier
from sievework.llm.spm_codec import default_model, unpack_ids


def near(texts):
    """Ids that go: linked, by way of others or not, with a smaller id."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {i: i for i in texts}
    ids = sorted(texts)
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and least[a] != least[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low, high = sorted((least[a], least[b]))
                    least = {k: low if v == high else v for k, v in least.items()}
                    again = True
    return {i for i in ids if least[i] != i}


def test_run_against_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r["doc_id"] for r in op7_quality_classifier(spark, sf_dir).where("predicted = 1").collect()}
    texts = {i: t for i, t in rows.items() if i in good}
    cleaned = brute_lines(list(texts.items()))
    texts = {i: cleaned[i][2] for i in texts}
    gone = near(texts)
    texts = {i: t for i, t in texts.items() if i not in gone}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = ItemIndex(items)
    leaks = {i for i, t in texts.items() if leaked(index, items, t)}
    assert gone and leaks and len(good) < len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(texts) - leaks
    for i, r in got.items():
        assert r["text"] == texts[i] and r["n_chars"] == len(texts[i]) and r["round_trip"]
        assert unpack_ids(r["ids_le"]) == library.encode(texts[i], add_bos=True, add_eos=True) and r["n_tokens"] == len(unpack_ids(r["ids_le"]))


def test_columns_of_any_name_pass_through(spark, sf_dir):
    names = ["score", "predicted", "held_out", "line_result", "leaks", "ids_le", "decoded", "_row", "_keys", "component_id"]
    docs = frame(spark).select("doc_id", "text", "n_chars", *[F.concat(F.lit(n), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert len(set(out.columns)) == len(out.columns)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        for r in out.collect():
            for n in names:
                if n != "ids_le" or name != corpus_pipeline.STAGES[-1][0]:
                    assert r[n] == f"{n}{-1 if r['doc_id'] is None else r['doc_id']}", (name, n)
