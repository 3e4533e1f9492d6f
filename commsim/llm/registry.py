"""The queries of this subpackage for the driver, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from commsim.llm import decontamination, embeddings, fill_in_middle, html, katz, mixing, packing, pii, runs, secrets, simhash, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_embeddings": embeddings.op2_embeddings,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_simhash": simhash.op4_simhash,
        "op5_mixing": mixing.op5_mixing,
        "op6_html": html.op6_html,
        "op7_katz": katz.op7_katz,
        "op8_pii": pii.op8_pii,
        "op9_substrings": substrings.op9_substrings,
        "op10_secrets": secrets.op10_secrets,
        "op11_runs": runs.op11_runs,
        "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE}
