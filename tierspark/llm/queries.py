"""Queries of the operators in this folder, and the DuckDB statements of those that SQL
can express. The others are tested against brute force in ``tests/llm``."""

from __future__ import annotations

from . import (best_fit_pack, chunk_dedup, decontaminate, histogram_shard, langid_kn, line_dedup,
               pfair_mix, prefix_trie, quality_qda, secret_scan, simhash_dedup, suffix_dedup,
               token_align)


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality": quality_qda.op2_quality,
        "op3_mix": pfair_mix.op3_mix,
        "op4_suffix": suffix_dedup.op4_suffix,
        "op5_exact_dedup": chunk_dedup.op5_exact_dedup,
        "op6_secrets": secret_scan.op6_secrets,
        "op7_language": langid_kn.op7_language,
        "op8_histogram_shard": histogram_shard.op8_histogram_shard,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_simhash": simhash_dedup.op10_simhash,
        "op11_pack": best_fit_pack.op11_pack,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_align": token_align.op13_align,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op5_exact_dedup": chunk_dedup.SQL,
        "op6_secrets": secret_scan.SQL,
        "op12_prefix_trie": prefix_trie.SQL,
    }
