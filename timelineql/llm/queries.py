"""The queries of this subpackage, by name, each with its production parameters over its whole table; and SQL for those that have it."""

from __future__ import annotations

from . import license_scan, line_dedup, mixing, near_dedup, packing, quality, sanitise, search, token_counts, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_line_quality": quality.op3_line_quality,
    "op4_packing": packing.op4_packing,
    "op5_sanitise": sanitise.op5_sanitise,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_search": search.op9_search,
    "op10_license_scan": license_scan.op10_license_scan,
}
SQL = {"op8_line_dedup": line_dedup.SQL, "op9_search": search.SQL}
