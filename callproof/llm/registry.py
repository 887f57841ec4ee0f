"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, classifier, licences, media, packing, periodic, rules, secrets, sigtree, simhash, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_query,
        "op2_quality": classifier.op2_query,
        "op3_licences": licences.op3_query,
        "op4_packing": packing.op4_query,
        "op5_media": media.op5_query,
        "op6_rules": rules.op6_query,
        "op7_bpe": bpe.op7_query,
        "op8_toxicity": toxicity.op8_query,
        "op9_chat": chat.op9_query,
        "op10_secrets": secrets.op10_query,
        "op11_whitening": whitening.op11_query,
        "op12_jaccard_join": sigtree.op12_query,
        "op13_periodic": periodic.op13_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licences": licences.OP3_SQL, "op9_chat": chat.OP9_SQL, "op10_secrets": secrets.OP10_SQL, "op13_periodic": periodic.OP13_SQL}
