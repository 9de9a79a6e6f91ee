"""All queries of the retrieval engine by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import answers, collections, corpus, evidence, lookups, places, ranking, records, scans, scores, travel, wordings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (ranking, corpus, places, records, scores, lookups, scans, wordings, travel, evidence, answers, collections):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
