"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from corpusmill.llm import ann, bpe, collisions, exact_dedup, fim, langid, lexical, lm_score, packing, secrets, simhash, suffix_dedup, warc

QUERIES = {
    "op1_bitmask_langid": langid.op1_bitmask_langid,
    "op2_length_packing": packing.op2_length_packing,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_cross_entropy_difference": lm_score.op4_cross_entropy_difference,
    "op5_linked_secrets": secrets.op5_linked_secrets,
    "op6_warc_pages": warc.op6_warc_pages,
    "op7_multiprobe_ann": ann.op7_multiprobe_ann,
    "op8_bpe_trie": bpe.op8_bpe_trie,
    "op9_bloom_exact_dedup": exact_dedup.op9_bloom_exact_dedup,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_dual_tree_search": lexical.op11_dual_tree_search,
    "op12_fenwick_fim": fim.op12_fenwick_fim,
    "op13_collision_near_dedup": collisions.op13_collision_near_dedup,
}

#: the others have no SQL form; tests/llm holds them against brute force
ORACLES = {
    "op2_length_packing": packing.oracle(),
    "op5_linked_secrets": secrets.oracle(),
    "op9_bloom_exact_dedup": exact_dedup.ORACLE,
    "op11_dual_tree_search": lexical.ORACLE,
    "op12_fenwick_fim": fim.ORACLE,
    "op13_collision_near_dedup": collisions.ORACLE,
}
