"""The corpus queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, counting, licenses, lm, neardup, negatives, neighbours, packing, quality, secrets, spelling, substrings, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_byte_bpe": bpe.query,
    "op3_quality_rules": quality.query,
    "op4_license_scan": licenses.query,
    "op5_secret_scan": secrets.query,
    "op6_minhash_neardup": neardup.query,
    "op7_vp_neighbours": neighbours.query,
    "op8_packing": packing.query,
    "op9_substring_dedup": substrings.query,
    "op10_lm_scoring": lm.query,
    "op11_hard_negatives": negatives.query,
    "op12_token_counts": counting.query,
    "op13_spelling_variants": spelling.query,
}
SQL = {"op3_quality_rules": quality.SQL, "op4_license_scan": licenses.SQL, "op6_minhash_neardup": neardup.SQL, "op7_vp_neighbours": neighbours.SQL, "op9_substring_dedup": substrings.SQL, "op11_hard_negatives": negatives.SQL, "op13_spelling_variants": spelling.SQL}
