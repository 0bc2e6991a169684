"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import fingerprints, html_text, language_id, lattice, mixing, packing, passages, prefix_trie, quality, repair, simhash, token_files, url_filter


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_mixing": mixing.op2_mixing,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_passages": passages.op5_passages,
        "op6_token_files": token_files.op6_token_files,
        "op7_lattice_score": lattice.op7_lattice_score,
        "op8_simhash": simhash.op8_simhash,
        "op9_html_text": html_text.op9_html_text,
        "op10_fingerprints": fingerprints.op10_fingerprints,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_language_id": language_id.op13_language_id,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.OP3_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL}
