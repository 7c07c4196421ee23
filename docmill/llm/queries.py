"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from docmill.llm import embedding_dedup, html_extract, language_id, license_scan, merkle_manifest, minhash_dedup, packing, pii, quality_rules, suffix_dedup, token_alignment, token_records, trie_bpe

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_html_extract": html_extract.query,
    "op3_token_records": token_records.query,
    "op4_best_fit_packing": packing.query,
    "op5_minhash_dedup": minhash_dedup.query,
    "op6_license_scan": license_scan.query,
    "op7_language_id": language_id.query,
    "op8_embedding_dedup": embedding_dedup.query,
    "op9_trie_bpe": trie_bpe.query,
    "op10_quality_rules": quality_rules.query,
    "op11_merkle_manifest": merkle_manifest.query,
    "op12_pii": pii.query,
    "op13_token_alignment": token_alignment.query,
}

SQL: dict[str, str] = {
    "op6_license_scan": license_scan.oracle(),
    "op11_merkle_manifest": merkle_manifest.SQL,
    "op12_pii": pii.oracle(),
}
