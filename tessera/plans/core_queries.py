"""The queries of the core: those of the reference's operators and problems 3 and 5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import orphans as o
from tessera.plans import build_queries as _build_queries  # noqa: F401
from tessera.plans import entity_queries as _entity_queries  # noqa: F401
from tessera.plans import graph_queries as _graph_queries  # noqa: F401  (fills the registry)
from tessera.plans import more_queries as _more_queries  # noqa: F401
from tessera.plans import source_queries as _source_queries  # noqa: F401
from tessera.plans.registry import QUERIES, SQL
from tessera.operators import skew
from tessera.session import read


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(read(spark, d, "edges"))


def p3_degrees(spark: SparkSession, d: str) -> DataFrame:
    return skew.degrees(read(spark, d, "edges"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return o.orphans(*(read(spark, d, t) for t in ("edges", "nodes", "shared_nodes", "removed_nodes")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("edge_id", "side", "status")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return o.orphan_report(_orphans(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_degrees, p5_found, p5_report)} | QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
