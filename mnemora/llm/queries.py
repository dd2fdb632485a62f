"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, expiring, language, licenses, mixing, negatives, quality_model, quality_rules, repeats, simhash, tokens, warc

QUERIES = {
    "op1_entropy_mix": mixing.op1_entropy_mix,
    "op2_subword_quality": quality_model.op2_subword_quality,
    "op3_minhash_containment": decontaminate.op3_minhash_containment,
    "op4_line_rules": quality_rules.op4_line_rules,
    "op5_simple8b_tokens": tokens.op5_simple8b_tokens,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_event_sourced_chat": chat.op7_event_sourced_chat,
    "op8_simhash_components": simhash.op8_simhash_components,
    "op9_prefix_free_repeats": repeats.op9_prefix_free_repeats,
    "op10_hyperdimensional_language": language.op10_hyperdimensional_language,
    "op11_blocked_negatives": negatives.op11_blocked_negatives,
    "op12_expiring_clicks": expiring.op12_expiring_clicks,
    "op13_fuzzy_licenses": licenses.op13_fuzzy_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_containment": decontaminate.SQL,
    "op4_line_rules": quality_rules.SQL,
    "op7_event_sourced_chat": chat.SQL,
    "op11_blocked_negatives": negatives.SQL,
    "op12_expiring_clicks": expiring.SQL,
}
