"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import canonical, handwritten, incremental, leakage, packing, parse_check, quality
from knotwork.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: parse_check.found(table(s, d, "repo")),
        "p1_rates": lambda s, d: parse_check.rates(table(s, d, "repo")),
        "p1_reported": lambda s, d: parse_check.reported(table(s, d, "repo"), table(s, d, "metadata")),
        "p3_found": lambda s, d: canonical.found(table(s, d, "entity"), table(s, d, "layer_type_stardard")),
        "p3_report": lambda s, d: canonical.report(table(s, d, "entity"), table(s, d, "layer_type_stardard")),
        "p4_found": lambda s, d: incremental.found(table(s, d, "paper")),
        "p5_found": lambda s, d: handwritten.found(table(s, d, "repo")),
        "p5_reasons": lambda s, d: handwritten.summary(table(s, d, "repo")),
        "p6_placements": lambda s, d: packing.placements(table(s, d, "documents"), table(s, d, "container_spec")),
        "p6_fill": lambda s, d: packing.fill(table(s, d, "documents"), table(s, d, "container_spec")),
        "p7_found": lambda s, d: leakage.found(table(s, d, "documents"), table(s, d, "eval_item")),
        "p7_spans": lambda s, d: leakage.removal_spans(table(s, d, "documents"), table(s, d, "eval_item")),
        "p8_found": lambda s, d: quality.found(table(s, d, "documents"), table(s, d, "common_word")),
        "p8_statistics": lambda s, d: quality.verdicts(table(s, d, "documents"), table(s, d, "common_word")),
    }


def oracle_sql() -> dict[str, str]:
    return {}
