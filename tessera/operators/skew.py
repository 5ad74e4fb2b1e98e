"""Problem 3: per-key results where a few keys hold most rows.

Every result is made by algebraic aggregates only: each task folds its rows into a hash table
of key states, and only these partial states are shuffled, so that a key costs each reducer at
most one row per map task, however many rows hold it. No key's rows ever meet in one task.

Nulls and blanks in an endpoint are no key; an edge without endpoints still counts in the
whole. Repeated deliveries of an edge count once. Further columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import node_reference
from tessera.session import cut


def _sides(source: Column, target: Column, *rest: Column) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(side).alias("side"), key.alias("key"), *rest) for side, key in (("source", source), ("target", target)))))


def heavy_keys(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(side, node_id) of the ids that hold at least `share` of the distinct edges on a side.

    The first pass moves three 64-bit numbers per edge (the id and hashes of its normalised
    endpoints) to drop repeated deliveries, then partial counts. At most 1/share keys per side
    can be heavy, so a bounded number of hashes reaches the driver; the second pass finds their
    names and counts them once more by name, so that a hash collision cannot add a key.
    """
    named = edges.select("edge_id", node_reference(F.col("source")).alias("s"), node_reference(F.col("target")).alias("t"))
    key = lambda name: F.when(F.col(name).isNotNull(), F.xxhash64(name))
    slim = named.select("edge_id", key("s").alias("s"), key("t").alias("t"))
    once = slim.groupBy("edge_id").agg(F.min("s").alias("s"), F.min("t").alias("t"))
    rows = once.select(F.explode(F.array(*(F.struct(F.lit(side).alias("side"), k.alias("key")) for side, k in (("", F.lit(0).cast("long")), ("source", F.col("s")), ("target", F.col("t")))))).alias("r")).select("r.*")
    counts = rows.where("key is not null").groupBy("side", "key").agg(F.count("*").alias("n"))
    bound = 1 + 2 * int(1 / share + 1e-9)
    top = counts.orderBy(F.desc("n")).limit(bound).collect()
    total = next((r.n for r in top if r.side == ""), 0)
    heavy = {side: [r.key for r in top if r.side == side and r.n >= share * total] for side in ("source", "target")}
    found = None
    for side, column in (("source", "s"), ("target", "t")):
        part = named.where(F.xxhash64(column).isin(heavy[side]) & F.col(column).isNotNull()) if heavy[side] else named.where("false")
        part = part.select(F.lit(side).alias("side"), F.col(column).alias("node_id"), "edge_id")
        found = part if found is None else found.unionByName(part)
    # distinct edges by name: a sketch-free exact count, partial by (name, edge bucket)
    exact = found.distinct().groupBy("side", "node_id").agg(F.count("*").alias("n"))
    return exact.where(F.col("n") >= share * total).select("side", "node_id")


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, relation, out_degree, in_degree) of every id, counting distinct edges.

    Repeated deliveries are dropped by edge_id on three 64-bit numbers per edge; counts are folded
    by numbers, and named at the end from a table of one row per id. Ids whose numbers collide,
    which a second hash shows, are counted by name instead. A null relation is a relation of its
    own; an edge of which deliveries differ counts as its greatest.
    """
    named = edges.select("edge_id", "relation", node_reference(F.col("source")).alias("s"), node_reference(F.col("target")).alias("t"))
    number = lambda name: F.when(F.col(name).isNotNull(), F.xxhash64(name)).alias(name)
    once = named.select("edge_id", number("s"), number("t"), F.coalesce(F.xxhash64("relation"), F.lit(0).cast("long")).alias("r")).groupBy("edge_id").agg(*(F.max(c).alias(c) for c in "str"))
    rows = once.select(_sides(F.col("s"), F.col("t"), F.col("r").alias("r")).alias("e")).select("e.*").where("key is not null")
    folded = rows.groupBy("key", "r").agg(F.count_if(F.col("side") == "source").alias("out_degree"), F.count_if(F.col("side") == "target").alias("in_degree"))

    # spellings are folded before they are normalised, so that a task passes each on once
    spelled = edges.select(F.explode(F.array("source", "target")).alias("name")).where("name is not null").groupBy("name").agg(F.lit(1).alias("one"))
    ids = spelled.select(node_reference(F.col("name")).alias("node_id")).where("node_id is not null").withColumn("key", F.xxhash64("node_id"))
    names = cut(ids.groupBy("key").agg(F.min("node_id").alias("node_id"), (F.min(F.xxhash64("node_id", F.lit(1))) != F.max(F.xxhash64("node_id", F.lit(1)))).alias("shared")))
    relations = edges.select("relation").distinct().withColumn("r", F.coalesce(F.xxhash64("relation"), F.lit(0).cast("long")))
    out = folded.join(names.where("not shared").select("key", "node_id"), "key").join(relations, "r").select("node_id", "relation", "out_degree", "in_degree")
    shared = [r.key for r in names.where("shared").select("key").collect()]  # two ids in about 2^32
    if shared:
        few = named.select("edge_id", _sides(F.col("s"), F.col("t"), F.col("relation").alias("relation")).alias("e")).select("edge_id", "e.*").where(F.xxhash64("key").isin(shared)).distinct()
        out = out.unionByName(few.groupBy(F.col("key").alias("node_id"), "relation").agg(F.count_if(F.col("side") == "source").alias("out_degree"), F.count_if(F.col("side") == "target").alias("in_degree")))
    return out
