"""The queries of this subpackage and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from clustrel.llm import collocations, image_copies, jaccard_join, lexical_search, license_scan, line_dedup, mixing, packing, quality_model, quality_rules, secrets, token_counts, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_secrets": secrets.op3_secrets,
    "op4_quality_model": quality_model.op4_quality_model,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_image_copies": image_copies.op7_image_copies,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_packing": packing.op10_packing,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_collocations": collocations.op12_collocations,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op11_url_filter": url_filter.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
