"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from tidegraph.llm import chat, decontam, divergence, langid, lexical, lm, mixing, pii, quality, simhash, topk, toxicity, urlfilter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_pii": pii.op2_pii,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_language_model": lm.op5_language_model,
    "op6_top_k": topk.op6_top_k,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language": langid.op9_language,
    "op10_chat_perspectives": chat.op10_chat_perspectives,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_url_filter": urlfilter.op13_url_filter,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op6_top_k": topk.ORACLE,
    "op10_chat_perspectives": chat.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
}
