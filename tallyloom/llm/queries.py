"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tallyloom.llm import ann, chat_format, decontamination, exact_topk, infilling, licenses, mixing, near_dedup, packing, quality, spelling, toxicity, warc

QUERIES = {
    "op1_exact_topk": exact_topk.op1_exact_topk,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_best_fit": packing.op3_best_fit,
    "op4_minhash_forest": near_dedup.op4_minhash_forest,
    "op5_line_quality": quality.op5_line_quality,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_posting_lists": ann.op7_posting_lists,
    "op8_chat_windows": chat_format.op8_chat_windows,
    "op9_clause_grammar": toxicity.op9_clause_grammar,
    "op10_warc_chunks": warc.op10_warc_chunks,
    "op11_decontaminate": decontamination.op11_decontaminate,
    "op12_fill_in_middle": infilling.op12_fill_in_middle,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {
    "op1_exact_topk": exact_topk.ORACLE_SQL,
    "op2_mix_sources": mixing.ORACLE_SQL,
    "op4_minhash_forest": near_dedup.ORACLE_SQL,
    "op6_license_scan": licenses.ORACLE_SQL,
    "op8_chat_windows": chat_format.ORACLE_SQL,
    "op10_warc_chunks": warc.ORACLE_SQL,
    "op11_decontaminate": decontamination.ORACLE_SQL,
    "op12_fill_in_middle": infilling.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
