"""The engine's own queries, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetloom.plans import captures, flows, payloads, protocols, reports, topologies

Query = Callable[[SparkSession, str], DataFrame]
_FAMILIES = (flows, captures, reports, protocols, topologies, payloads)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with their roles, handshake and shape."""
    return flows.connections_build(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in _FAMILIES for name, text in family.ORACLES.items()}
