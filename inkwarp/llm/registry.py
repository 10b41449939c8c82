"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwarp.llm import chat, jaccard, language, mixing, neighbours, packing, pii, quality, search, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (packing, quality, chat, sharding, search, jaccard, pii, neighbours, language, mixing):
    QUERIES[module.NAME] = module.query
    if module.SQL:
        ORACLES[module.NAME] = module.SQL
