"""All queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knotwork.operators import analytics, code, construction, figures, graphdef, graphs, metrics, packed_values, render, sampling, tabular, texts, vocabulary
from knotwork.session import table
from knotwork.sources import queries as files
from knotwork.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that offer ``queries()`` and ``oracle_sql()``.
MODULES = (analytics, tabular, graphs, metrics, figures, texts, sampling, code, vocabulary, construction, graphdef, render, files, streams)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= m.queries()
    return out | {"p2_found": lambda s, d: packed_values.found(table(s, d, "paper"))}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.oracle_sql()
    return out
