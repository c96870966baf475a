"""The queries of this subpackage and the SQL that checks them."""

from canopy.llm import chat_format, language_id, license_scan, mixing, near_dedup, neighbours, packing, quality_rules, token_counts, toxicity

QUERIES = {
    "op1_chat_formatting": chat_format.op1_chat_formatting,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_language_id": language_id.op4_language_id,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_nearest_neighbours": neighbours.op6_nearest_neighbours,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_packing": packing.op9_packing,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}
SQL = {
    "op1_chat_formatting": chat_format.OP1_SQL,
    "op3_license_scan": license_scan.sql(),
    "op6_nearest_neighbours": neighbours.OP6_SQL,
    "op7_quality_rules": quality_rules.sql(),
    "op8_mixing": mixing.sql(),
    "op10_near_dedup": near_dedup.OP10_SQL,
}
