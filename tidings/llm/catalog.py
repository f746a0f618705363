"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from tidings.llm import byte_bpe, credentials, decontaminate, mixing, ngram_join, ordinal_quality, preferences, quality_rules, ranked_search, sharding, source_divergence, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_mixing": mixing.op3_mixing,
    "op4_preferences": preferences.op4_preferences,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_sharding": sharding.op6_sharding,
    "op7_secrets": credentials.op7_secrets,
    "op8_warc": warc.op8_warc,
    "op9_ordinal_quality": ordinal_quality.op9_ordinal_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}

ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_ngram_join": ngram_join.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op4_preferences": preferences.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op8_warc": warc.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
