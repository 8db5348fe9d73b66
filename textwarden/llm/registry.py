"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_telephony, op2_lines, op3_bagminhash, op4_packing, op5_html, op6_substrings, op7_chat, op8_toxicity, op9_decontaminate, op10_licenses

QUERIES = {
    "op1_telephony": op1_telephony.op1_telephony,
    "op2_lines": op2_lines.op2_lines,
    "op3_bagminhash": op3_bagminhash.op3_bagminhash,
    "op4_packing": op4_packing.op4_packing,
    "op5_html": op5_html.op5_html,
    "op6_substrings": op6_substrings.op6_substrings,
    "op7_chat": op7_chat.op7_chat,
    "op8_toxicity": op8_toxicity.op8_toxicity,
    "op9_decontaminate": op9_decontaminate.op9_decontaminate,
    "op10_licenses": op10_licenses.op10_licenses,
}

#: Those that SQL can express; tests/llm hold the others against brute force.
SQL = {
    "op2_lines": op2_lines.OP2_SQL,
    "op3_bagminhash": op3_bagminhash.OP3_SQL,
    "op6_substrings": op6_substrings.OP6_SQL,
    "op7_chat": op7_chat.OP7_SQL,
    "op9_decontaminate": op9_decontaminate.OP9_SQL,
}
