"""The subpackage's registered queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import embedding_dedup, line_quality, mixing, ngram_join, packing, sharding, suffix_dedup, topk_search, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_sharding": sharding.op2_sharding,
        "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
        "op4_mixing": mixing.op4_mixing,
        "op5_packing": packing.op5_packing,
        "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
        "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
        "op8_topk_search": topk_search.op8_topk_search,
        "op9_quality_classifier": line_quality.op9_quality_classifier,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict:
    return {"op4_mixing": mixing.OP4_SQL, "op8_topk_search": topk_search.OP8_SQL, "op10_url_filter": url_filter.OP10_SQL}
