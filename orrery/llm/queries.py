"""The queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from . import fill_middle, langid, line_dedup, mixing, near_vectors, ngram_join, packing, periodic, pieces, topk, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.query,
        "op2_toxicity": toxicity.query,
        "op3_near_vectors": near_vectors.query,
        "op4_best_fit_packing": packing.query,
        "op5_language_id": langid.query,
        "op6_exact_top_k": topk.query,
        "op7_mixing": mixing.query,
        "op8_ngram_jaccard": ngram_join.query,
        "op9_line_dedup": line_dedup.query,
        "op10_warc": warc.query,
        "op11_sentencepiece": pieces.query,
        "op12_fill_middle": fill_middle.query,
        "op13_periodic_runs": periodic.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.ORACLE, "op6_exact_top_k": topk.ORACLE, "op7_mixing": mixing.ORACLE, "op12_fill_middle": fill_middle.ORACLE}
