"""The queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import alignment, collocations, decontaminate, licenses, line_dedup, lm_scores, mixing, ngram_join, sharding, suffix_dedup, tokens, topk, toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_toxicity": toxicity.query,
        "op4_token_counts": tokens.query,
        "op5_lm_scores": lm_scores.query,
        "op6_exact_top_k": topk.query,
        "op7_decontaminate": decontaminate.query,
        "op8_license_scan": licenses.query,
        "op9_line_dedup": line_dedup.query,
        "op10_ngram_join": ngram_join.query,
        "op11_shard": sharding.query,
        "op12_align_tokens": alignment.query,
        "op13_collocations": collocations.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op2_suffix_dedup": suffix_dedup.SQL, "op5_lm_scores": lm_scores.SQL, "op6_exact_top_k": topk.SQL, "op9_line_dedup": line_dedup.SQL, "op10_ngram_join": ngram_join.SQL, "op11_shard": sharding.SQL, "op13_collocations": collocations.SQL}
