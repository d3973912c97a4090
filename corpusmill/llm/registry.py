"""The operators' queries and their SQL."""

from __future__ import annotations

from corpusmill.llm import licenses, line_dedup, merkle, mixing, near_dedup, packing, quality, search, substring_dedup, suffix_dedup, toxicity, url_rules, whitening

QUERIES = {
    "op1_search": search.op1_search,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_pack": packing.op9_pack,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_url_filter": url_rules.op11_url_filter,
    "op12_whitening": whitening.op12_whitening,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op1_search": search.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_license_scan": licenses.OP3_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op11_url_filter": url_rules.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
