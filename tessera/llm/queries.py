"""The corpus operators' queries by name, and DuckDB SQL where it can give their rows."""

from __future__ import annotations

from tessera.llm import decontaminate, fim, jaccard_join, language_id, licenses, lm_score, media, mixing, prefix_trie, secrets, token_counts, url_filter, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_media_sniffing": media.op2_media_sniffing,
    "op3_winnowing": decontaminate.op3_winnowing,
    "op4_cube_mix": mixing.op4_cube_mix,
    "op5_jaccard_classes": jaccard_join.op5_jaccard_classes,
    "op6_language_mixture": language_id.op6_language_mixture,
    "op7_secret_ledger": secrets.op7_secret_ledger,
    "op8_lattice_score": lm_score.op8_lattice_score,
    "op9_merkle_audit": warc.op9_merkle_audit,
    "op10_patience_licenses": licenses.op10_patience_licenses,
    "op11_rank_select_fim": fim.op11_rank_select_fim,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_digest_filter": url_filter.op13_digest_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op9_merkle_audit": warc.ORACLE,
    "op11_rank_select_fim": fim.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_digest_filter": url_filter.ORACLE,
}
