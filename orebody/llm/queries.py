"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orebody.llm import brown_lm, decontaminate_cgk, fill_middle, html_templates, media_ogg, minhash_dedup, packing, periodic_runs, pii_surrogates, quality_qda, reply_trees, sharding, url_graph


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ogg": media_ogg.op1_ogg,
        "op2_quality": quality_qda.op2_quality,
        "op3_templates": html_templates.op3_templates,
        "op4_packing": packing.op4_packing,
        "op5_url_graph": url_graph.op5_url_graph,
        "op6_shards": sharding.op6_shards,
        "op7_brown": brown_lm.op7_brown,
        "op8_minhash": minhash_dedup.op8_minhash,
        "op9_surrogates": pii_surrogates.op9_surrogates,
        "op10_cgk": decontaminate_cgk.op10_cgk,
        "op11_replies": reply_trees.op11_replies,
        "op12_fim": fill_middle.op12_fim,
        "op13_runs": periodic_runs.op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_packing": packing.OP4_SQL,
        "op5_url_graph": url_graph.OP5_SQL,
        "op6_shards": sharding.OP6_SQL,
        "op8_minhash": minhash_dedup.OP8_SQL,
        "op11_replies": reply_trees.OP11_SQL,
        "op12_fim": fill_middle.OP12_SQL,
        "op13_runs": periodic_runs.OP13_SQL,
    }
