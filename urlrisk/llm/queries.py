"""The registered queries of this package and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from urlrisk.llm import (
    curves, embedding_dedup, html_blocks, jaccard, langid, mixing, packing, rtree, secrets, sharding, spelling, toxicity, url_lists,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_jaccard": jaccard.op2_jaccard,
        "op3_mixing": mixing.op3_mixing,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_sharding": sharding.op5_sharding,
        "op6_langid": langid.op6_langid,
        "op7_packing": packing.op7_packing,
        "op8_html": html_blocks.op8_html,
        "op9_neighbours": curves.op9_neighbours,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_url_lists": url_lists.op11_url_lists,
        "op12_spelling": spelling.op12_spelling,
        "op13_hard_negatives": rtree.op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are tested against brute force."""
    found = {
        "op2_jaccard": jaccard.ORACLE, "op3_mixing": mixing.oracle(), "op4_embedding_dedup": embedding_dedup.ORACLE,
        "op11_url_lists": url_lists.ORACLE, "op12_spelling": spelling.oracle(), "op13_hard_negatives": rtree.ORACLE,
    }
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
