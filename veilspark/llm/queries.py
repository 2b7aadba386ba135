"""Queries of this subpackage for the driver, and their SQL where it can express them."""

from __future__ import annotations

from veilspark.llm import op1_topk, op2_simhash, op3_packing, op4_mixing, op5_quality_rules, op6_secret_scan, op7_sharding, op8_substring_dedup, op9_pii, op10_quality_classifier

QUERIES = {
    "op1_exact_topk": op1_topk.op1_exact_topk,
    "op2_simhash_near_dedup": op2_simhash.op2_simhash_near_dedup,
    "op3_packing": op3_packing.op3_packing,
    "op4_mixing": op4_mixing.op4_mixing,
    "op5_quality_rules": op5_quality_rules.op5_quality_rules,
    "op6_secret_scan": op6_secret_scan.op6_secret_scan,
    "op7_sharding": op7_sharding.op7_sharding,
    "op8_substring_dedup": op8_substring_dedup.op8_substring_dedup,
    "op9_pii": op9_pii.op9_pii,
    "op10_quality_classifier": op10_quality_classifier.op10_quality_classifier,
}
#: The others need hashes, training, tokenizers or iteration that SQL hasn't; tests hold them against brute force.
SQL = {"op1_exact_topk": op1_topk.SQL}
