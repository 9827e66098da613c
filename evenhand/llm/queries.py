"""The registered corpus queries: name to function, and name to DuckDB SQL where SQL can say it."""

from __future__ import annotations

from evenhand.llm import bpe, hamming, langid, line_rules, merkle, mixing, ngram_join, periods, shards, substrings, toolcalls, urls, warc

QUERIES = {
    "op1_top_k": hamming.op1_top_k,
    "op2_url_filter": urls.op2_url_filter,
    "op3_language": langid.op3_language,
    "op4_tool_calls": toolcalls.op4_tool_calls,
    "op5_mixing": mixing.op5_mix,
    "op6_shards": shards.op6_shards,
    "op7_line_rules": line_rules.op7_line_rules,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_warc": warc.op10_warc,
    "op11_merkle": merkle.op11_merkle,
    "op12_periods": periods.op12_periods,
    "op13_substrings": substrings.op13_substrings,
}

SQL = {
    "op1_top_k": hamming.SQL,
    "op4_tool_calls": toolcalls.SQL,
    "op5_mixing": mixing.SQL,
    "op7_line_rules": line_rules.SQL,
    "op10_warc": warc.SQL,
    "op11_merkle": merkle.SQL,
    "op12_periods": periods.SQL,
    "op13_substrings": substrings.SQL,
}
