"""Queries and SQL of the corpus operators, for the entry module."""

from . import byte_dedup, exact_dedup, mixing, periodic_runs, quality, sentencepiece_ops, sharding, simhash, spelling, substring_dedup, token_files, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_simhash_groups": simhash.op2_simhash_groups,
        "op3_host_quality": quality.op3_host_quality,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_sentencepiece": sentencepiece_ops.op7_sentencepiece,
        "op8_rendezvous_sharding": sharding.op8_rendezvous_sharding,
        "op9_suffix_array_dedup": byte_dedup.op9_suffix_array_dedup,
        "op10_url_aliases": url_filter.op10_url_aliases,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_token_files": token_files.op12_token_files,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict:
    return {
        "op1_mix_sources": mixing.OP1_SQL,
        "op3_host_quality": quality.OP3_SQL,
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op5_substring_dedup": substring_dedup.OP5_SQL,
        "op8_rendezvous_sharding": sharding.OP8_SQL,
        "op10_url_aliases": url_filter.OP10_SQL,
        "op11_spelling_variants": spelling.OP11_SQL,
    }
