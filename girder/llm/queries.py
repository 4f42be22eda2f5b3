"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import fingerprints, jaccard, line_dedup, mixing, packing, prefix_trie, private, quality, resampling, search, sstable, suffixes, token_counts

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_search": search.op3_search,
    "op4_packing": packing.op4_packing,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_private": private.op7_private,
    "op8_sstable": sstable.op8_sstable,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_resampling": resampling.op13_resampling,
}

ORACLE_SQL = {"op6_mixing": mixing.SQL, "op11_line_dedup": line_dedup.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_resampling": resampling.SQL}
