"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, decontamination, html, jaccard, language, mixing, negatives, neighbours, passages, quality, sharding, tokens

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_collinear_chains": passages.op1_collinear_chains,
        "op2_pre_token_counts": tokens.op2_pre_token_counts,
        "op3_tool_call_links": chat.op3_tool_call_links,
        "op4_min_cost_mix": mixing.op4_min_cost_mix,
        "op5_language_filters": language.op5_language_filters,
        "op6_nn_descent": neighbours.op6_nn_descent,
        "op7_histogram_sort": sharding.op7_histogram_sort,
        "op8_heavy_light_jaccard": jaccard.op8_heavy_light_jaccard,
        "op9_line_blocks": html.op9_line_blocks,
        "op10_spaced_seeds": decontamination.op10_spaced_seeds,
        "op11_voronoi_negatives": negatives.op11_voronoi_negatives,
        "op12_quality_rules": quality.op12_quality_rules,
        "op13_striped_alignment": alignment.op13_striped_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_tool_call_links": chat.ORACLE_SQL,
        "op8_heavy_light_jaccard": jaccard.ORACLE_SQL,
        "op10_spaced_seeds": decontamination.ORACLE_SQL,
        "op11_voronoi_negatives": negatives.ORACLE_SQL,
        "op12_quality_rules": quality.ORACLE_SQL,
    }
