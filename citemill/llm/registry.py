"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, fill_middle, fingerprints, language, licenses, matroska, near_duplicates, packing, sentences, set_join, sharding, substrings, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": matroska.op1_matroska,
    "op2_one_permutation": fingerprints.op2_one_permutation,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_super_kmers": substrings.op4_super_kmers,
    "op5_language_spans": language.op5_language_spans,
    "op6_virtual_slots": sharding.op6_virtual_slots,
    "op7_bag_min_hash": near_duplicates.op7_bag_min_hash,
    "op8_minimum_bin_slack": packing.op8_minimum_bin_slack,
    "op9_token_files": token_files.op9_token_files,
    "op10_shared_prefix": sentences.op10_shared_prefix,
    "op11_set_join": set_join.op11_set_join,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_structure_repair": conversations.op13_structure_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": licenses.OP3_SQL,
    "op4_super_kmers": substrings.OP4_SQL,
    "op11_set_join": set_join.OP11_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
    "op13_structure_repair": conversations.OP13_SQL,
}
