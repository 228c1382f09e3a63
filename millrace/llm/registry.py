"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, line_dedup, ngram_join, pieces, quality, toxicity, url_rules, warc_revisit

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_chat_collapse": chat.op2_chat_collapse,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_warc_revisits": warc_revisit.op4_warc_revisits,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_pieces": pieces.op8_pieces,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_rules": url_rules.op10_url_rules,
}

ORACLE_SQL = {
    "op2_chat_collapse": chat.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_warc_revisits": warc_revisit.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_url_rules": url_rules.SQL,
}
