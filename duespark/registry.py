"""Named queries over the driver's tables, each with its DuckDB oracle where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duespark.plans import accounting, fields, further, overview, pages, records, relations, rules, scalars, states, suggestions, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ag01_kpi_facet"

for module in (overview, accounting, relations, scalars, suggestions, texts, further, states, fields, pages, records, rules):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
