"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from evidark.llm import alignment, bilinear, byte_bpe, chat, extraction, hilbert, host_rules, merkle, mixing, nbsvm, packing, simhash, url_lists

QUERIES = {
    "op1_host_quality_rules": host_rules.op1_host_quality_rules,
    "op2_bilinear_lm": bilinear.op2_bilinear_lm,
    "op3_nbsvm_quality": nbsvm.op3_nbsvm_quality,
    "op4_block_labeller": extraction.op4_block_labeller,
    "op5_preference_formatting": chat.op5_preference_formatting,
    "op6_hilbert_neighbours": hilbert.op6_hilbert_neighbours,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_url_list_asof": url_lists.op9_url_list_asof,
    "op10_pareto_mixing": mixing.op10_pareto_mixing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_group_dictionary": alignment.op12_group_dictionary,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLE_SQL = {
    "op1_host_quality_rules": host_rules.oracle(),
    "op5_preference_formatting": chat.ORACLE,
    "op9_url_list_asof": url_lists.ORACLE,
    "op10_pareto_mixing": mixing.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
}
