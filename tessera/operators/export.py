"""Rows of the export formats; writers are Spark's own text and JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    kind = F.upper(F.regexp_replace(F.coalesce("relation", F.lit("related")), "[^A-Za-z0-9_]", "_"))
    line = F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("source")), F.lit("}), (b {id: "), _quoted(F.col("target")), F.lit("}) MERGE (a)-[:"), kind, F.lit("]->(b);"))
    return edges.select("edge_id", line.alias("line"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, json): one line per node and per link of a node-link document."""
    n = nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct("id", "label", "file_type", "source_file", "community")).alias("json"))
    return n.unionByName(edges.select(F.lit("links").alias("part"), F.to_json(F.struct("source", "target", "relation", "confidence")).alias("json")))


def read_node_link(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = lines.where("part = 'nodes'").select(F.from_json("json", "id string, label string, file_type string, source_file string, community int").alias("x")).select("x.*")
    return n, lines.where("part = 'links'").select(F.from_json("json", "source string, target string, relation string, confidence string").alias("x")).select("x.*")
