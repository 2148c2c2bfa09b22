"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import op1_decontaminate, op2_simhash, op3_mixing, op4_telephony, op5_toxicity, op6_chat, op7_html, op8_warc, op9_lines, op10_sharding, op11_quality, op12_divergence, op13_lexical

QUERIES = {
    "op1_decontaminate": op1_decontaminate.query,
    "op2_simhash": op2_simhash.query,
    "op3_mixing": op3_mixing.query,
    "op4_telephony": op4_telephony.query,
    "op5_toxicity": op5_toxicity.query,
    "op6_chat": op6_chat.query,
    "op7_html": op7_html.query,
    "op8_warc": op8_warc.query,
    "op9_lines": op9_lines.query,
    "op10_sharding": op10_sharding.query,
    "op11_quality": op11_quality.query,
    "op12_divergence": op12_divergence.query,
    "op13_lexical": op13_lexical.query,
}

SQL = {
    "op1_decontaminate": op1_decontaminate.SQL,
    "op6_chat": op6_chat.SQL,
    "op8_warc": op8_warc.SQL,
    "op10_sharding": op10_sharding.SQL,
    "op11_quality": op11_quality.SQL,
    "op12_divergence": op12_divergence.SQL,
    "op13_lexical": op13_lexical.SQL,
}
