"""Queries of this subpackage, and SQL for those that SQL can express."""

from . import bpe, exact_dedup, merkle, mixing, pii, prefix_trie, quality, sharding, simhash, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality": quality.op6_quality,
    "op7_pii": pii.op7_pii,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_warc": warc.op9_warc,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
SQL = {"op1_mixing": mixing.SQL, "op2_exact_dedup": exact_dedup.SQL, "op9_warc": warc.SQL, "op10_substring_dedup": substring_dedup.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_suffix_dedup": suffix_dedup.SQL, "op13_merkle_manifest": merkle.SQL}
