"""The queries of this package and their SQL."""

from __future__ import annotations

from . import byte_bpe, centroids, decontaminate, exact_dedup, html_extract, line_dedup, merkle, ngram_join, quality, sharding, spm_codec, suffix_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_sentencepiece_codec": spm_codec.op4_sentencepiece_codec,
    "op5_sharding": sharding.op5_sharding,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}
SQL = {"op6_exact_dedup": exact_dedup.OP6_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op13_centroid_clustering": centroids.OP13_SQL}
