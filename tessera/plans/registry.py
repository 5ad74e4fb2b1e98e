"""Registry of the queries and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The graph in SQL: n, the last delivery of each node; e, the distinct edges between nodes; p, the simple graph; deg, degrees.
GRAPH = """WITH n AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY captured_at DESC NULLS LAST, seq DESC) AS rk FROM nodes WHERE id IS NOT NULL) WHERE rk = 1),
e AS (SELECT DISTINCT edge_id, source, target, relation, confidence, confidence_score, weight, context, source_file, captured_at FROM edges WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)),
p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM e WHERE source <> target),
links AS (SELECT a AS id, b AS other FROM p UNION ALL SELECT b, a FROM p),
deg AS (SELECT id, count(*) AS degree FROM links GROUP BY id)
"""
#: The same with upper-case confidence and default scores.
SCORED = GRAPH + """, s AS (SELECT e.*, upper(trim(coalesce(confidence, 'EXTRACTED'))) AS conf, coalesce(confidence_score, CASE upper(trim(coalesce(confidence, 'EXTRACTED'))) WHEN 'INFERRED' THEN 0.5 WHEN 'AMBIGUOUS' THEN 0.2 ELSE 1.0 END) AS score FROM e)
"""


def query(name: str, sql: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add
