"""The registered queries of this subpackage and the same questions in SQL, where SQL can ask them."""

from __future__ import annotations

import corpus_pipeline

from quire.llm import (
    bpe, brown, centroids, decontamination, exact_dedup, html_text, language, mixing, nn_descent, quality, ranked_search,
    simhash, toxicity,
)

QUERIES = {
    "op1_html_text": html_text.query,
    "op2_nn_descent": nn_descent.query,
    "op3_bpe": bpe.query,
    "op4_brown_lm": brown.query,
    "op5_mixing": mixing.query,
    "op6_toxicity": toxicity.query,
    "op7_language": language.query,
    "op8_quality": quality.query,
    "op9_simhash": simhash.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_centroids": centroids.query,
    "op12_ranked_search": ranked_search.query,
    "op13_decontamination": decontamination.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op5_mixing": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_centroids": centroids.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op13_decontamination": decontamination.SQL,
}
