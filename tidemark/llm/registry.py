"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from . import bpe_monoid, decontaminate, importance, license_scan, line_dedup, near_dup, prefix_trie, quality_gam, quality_rules, suffix_tree, token_counts, token_files, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_bpe_monoid": bpe_monoid.op4_bpe_monoid,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_quality_gam": quality_gam.op9_quality_gam,
    "op10_token_files": token_files.op10_token_files,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_suffix_tree": suffix_tree.op12_suffix_tree,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
ORACLES = {
    "op5_license_scan": license_scan.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op13_importance_resampling": importance.OP13_SQL,
}
