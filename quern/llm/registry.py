"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quern.llm import chat, decontaminate, dedup, html, licenses, neighbours, pack, shard, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_pack": pack.op2_pack,
        "op3_shard": shard.op3_shard,
        "op4_neighbours": neighbours.op4_neighbours,
        "op5_chat": chat.op5_chat,
        "op6_warc": warc.op6_warc,
        "op7_neardup": dedup.op7_neardup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_html": html.op9_html,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_shard": shard.OP3_SQL,
        "op4_neighbours": neighbours.OP4_SQL,
        "op5_chat": chat.OP5_SQL,
        "op6_warc": warc.OP6_SQL,
        "op7_neardup": dedup.OP7_SQL,
        "op10_decontaminate": decontaminate.OP10_SQL,
    }
