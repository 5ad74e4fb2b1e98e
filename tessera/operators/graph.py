"""The property graph: admission, collapse, degrees, set operations.

A graph is two DataFrames, nodes keyed by `id` and edges with `source` and `target`. Null ids and
endpoints are not admitted, repeated deliveries are folded, later ones win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ("edge_id", "source", "target", "relation", "confidence", "confidence_score", "weight", "context", "source_file", "captured_at")


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """Last delivery of each id wins."""
    start = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    order = F.struct(F.coalesce(F.col("captured_at").cast("timestamp_ntz"), start), F.col("seq"))
    rest = [c for c in nodes.columns if c != "id"]
    best = nodes.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("n"))
    return best.select("id", "n.*")


def linked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose two endpoints exist."""
    ids = nodes.select("id")
    once = edges.select(*(c for c in EDGE if c in edges.columns)).where("source is not null and target is not null").distinct()
    return once.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def pairs(edges: DataFrame) -> DataFrame:
    """(a, b): the undirected simple graph, without self-loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def both_ways(simple: DataFrame) -> DataFrame:
    """(id, other) in both directions."""
    return simple.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x")).select("x.*")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): number of distinct neighbours. Counts are partial per task."""
    return both_ways(pairs(edges)).groupBy("id").agg(F.count("*").alias("degree"))


def collapse_directed(edges: DataFrame) -> DataFrame:
    """One edge per (source, target): the last in order of relation, then of edge_id, wins."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    best = edges.groupBy("source", "target").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("relation", F.lit("")), F.col("edge_id"))).alias("e"))
    return best.select("source", "target", "e.*")


def collapse_undirected(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair, by (source, target, relation): the last wins, but a reverse
    edge of the relation of the last forward edge is skipped."""
    keyed = edges.select("source", "target", F.coalesce("relation", F.lit("")).alias("relation")).distinct().withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    forward = F.when(F.col("source") == F.col("a"), F.col("relation"))
    backward = F.when(F.col("source") != F.col("a"), F.col("relation"))
    sides = keyed.groupBy("a", "b").agg(F.max(forward).alias("f"), F.max(backward).alias("r"), F.min(backward).alias("r_least"))
    keeps = F.col("r").isNull() | (F.col("f").isNotNull() & (F.col("r") == F.col("f")) & (F.col("r_least") == F.col("f")))
    return sides.select(F.when(keeps, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(keeps, F.col("b")).otherwise(F.col("a")).alias("target"), F.when(keeps, F.col("f")).otherwise(F.col("r")).alias("relation"))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k of each group, with their rank. Spark keeps k rows per task and group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with a missing endpoint."""
    ids = nodes.select("id")
    once = edges.select("edge_id", "source", "target").distinct()
    good = once.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return once.join(good.select("edge_id"), "edge_id", "left_anti")


def same_topology(nodes: DataFrame, links: DataFrame, other_nodes: DataFrame, other_links: DataFrame) -> DataFrame:
    """(same): whether two graphs have equal nodes and links, repeated ones counted, apart from communities and scores."""
    faults = None
    for a, b, keys in ((nodes, other_nodes, ("id", "label", "file_type", "source_file")), (links, other_links, ("source", "target", "relation", "confidence"))):
        both = a.select(*keys, F.lit(1).alias("n")).unionByName(b.select(*keys, F.lit(-1).alias("n")))
        both = both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0").select("n")
        faults = both if faults is None else faults.unionByName(both)
    return faults.agg((F.count("*") == 0).alias("same"))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(change, keys): rows only in the new or only in the old."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    added = b.exceptAll(a).select(F.lit("added").alias("change"), *keys)
    return added.unionByName(a.exceptAll(b).select(F.lit("removed").alias("change"), *keys))
