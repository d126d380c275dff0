"""The operators' queries, by name, and their SQL."""

from __future__ import annotations

from sessionloom.llm import bpe, decontaminate, exact_dedup, hard_negatives, jaccard_join, langid, licenses, merkle, secrets, substring_dedup, token_store, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_warc": warc.op2_warc,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_token_files": token_store.op10_token_files,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_license_scan": licenses.op13_license_scan,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_license_scan": licenses.OP13_SQL,
}
