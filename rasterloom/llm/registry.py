"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import ann_search, chat_format, exact_dedup, html_extract, licence_scan, minhash_dedup, mixing, packing, substring_dedup, toxicity

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_ann_search": ann_search.op2_ann_search,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_minhash_near_dedup": minhash_dedup.op4_minhash_near_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_licence_scan": licence_scan.op8_licence_scan,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op3_mix_sources": mixing.ORACLE_SQL,
    "op4_minhash_near_dedup": minhash_dedup.ORACLE_SQL,
    "op6_chat_format": chat_format.ORACLE_SQL,
    "op8_licence_scan": licence_scan.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
