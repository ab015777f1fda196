"""The queries of this folder by name, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from . import alignment, ann, licenses, lm_scoring, mixing, near_vectors, packing, prefix_trie, secret_scan, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_secrets": secret_scan.op2_secrets,
    "op3_ann": ann.op3_ann,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_packing": packing.op5_packing,
    "op6_licenses": licenses.op6_licenses,
    "op7_near_vectors": near_vectors.op7_near_vectors,
    "op8_warc": warc.op8_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash": simhash.op10_simhash,
    "op11_lm_score": lm_scoring.op11_lm_score,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES = {
    "op1_mix": mixing.ORACLE_SQL,
    "op2_secrets": secret_scan.ORACLE_SQL,
    "op3_ann": ann.ORACLE_SQL,
    "op6_licenses": licenses.ORACLE_SQL,
    "op7_near_vectors": near_vectors.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
}
