"""The dealt operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, embedding_whitening, filter_audit, html_extraction, jaccard_join, license_scan, packing, pii_bootstrap, quality_classifier, quality_rules, sharding, token_store

ORACLES: dict[str, str] = {
    "op1_perspective_rotation": chat_format.ORACLE,
    "op4_sentence_rules": license_scan.ORACLE,
    "op13_permutation_trie": filter_audit.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_decision_list": quality_rules.op10_decision_list,
        "op8_neighbour_vote": quality_classifier.op8_neighbour_vote,
        "op9_style_tree": html_extraction.op9_style_tree,
        "op1_perspective_rotation": chat_format.op1_perspective_rotation,
        "op4_sentence_rules": license_scan.op4_sentence_rules,
        "op5_pigeonhole": decontamination.op5_pigeonhole,
        "op6_part_enum": jaccard_join.op6_part_enum,
        "op7_linear_grouping": packing.op7_linear_grouping,
        "op3_virtual_slots": sharding.op3_virtual_slots,
        "op2_token_store": token_store.op2_token_store,
        "op11_welford_qr": embedding_whitening.op11_welford_qr,
        "op12_bootstrapped_pii": pii_bootstrap.op12_bootstrapped_pii,
        "op13_permutation_trie": filter_audit.op13_permutation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
