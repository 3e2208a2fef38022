"""The registered queries of the corpus operators."""

from __future__ import annotations

from . import ann, langid, mixing, ngram_lm, pii, quality, sentencepieces, sharding, simhash, suffix_dedup


def queries() -> dict:
    return {
        "op4_mix_sources": mixing.op4_mix_sources,
        "op7_risk_controlled_quality": quality.op7_risk_controlled_quality,
        "op3_simhash_groups": simhash.op3_simhash_groups,
        "op8_weakly_supervised_pii": pii.op8_weakly_supervised_pii,
        "op1_byte_gru_language": langid.op1_byte_gru_language,
        "op2_ivf_pq_neighbours": ann.op2_ivf_pq_neighbours,
        "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
        "op9_elias_fano_scores": ngram_lm.op9_elias_fano_scores,
        "op6_sentencepiece_lattice": sentencepieces.op6_sentencepiece_lattice,
        "op5_hypergeometric_shards": sharding.op5_hypergeometric_shards,
    }


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express: the others train models, draw at random or use hashes that DuckDB lacks."""
    return {"op10_suffix_array_dedup": suffix_dedup.OP10_SQL}
