"""Comparing states: manifests, caches, replacement by owner, federation of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state) of two manifests (path, mtime, hash): an equal mtime or an equal hash means unchanged."""
    old = previous.select("path", F.col("mtime").alias("m0"), F.col("hash").alias("h0"), F.lit(True).alias("was"))
    new = current.select("path", F.col("mtime").alias("m1"), F.col("hash").alias("h1"), F.lit(True).alias("is"))
    same = F.col("m0").eqNullSafe(F.col("m1")) | F.coalesce(F.col("h0") == F.col("h1"), F.lit(False))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return old.join(new, "path", "full").select("path", state.alias("state"))


def cache_split(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(key, hit): which of the wanted keys the cache holds."""
    return wanted.select(key).distinct().join(cache.select(key, F.lit(True).alias("hit")).distinct(), key, "left").fillna(False, ["hit"])


def replace_by_owner(stored: DataFrame, fresh: DataFrame, owner: str, pruned: DataFrame) -> DataFrame:
    """Rows of replaced or pruned owners give way to the fresh ones; all others stay as they are."""
    gone = fresh.select(owner).unionByName(pruned.select(owner)).distinct()
    return stored.join(gone, owner, "left_anti").select(*fresh.columns).unionByName(fresh)


def unexplained_losses(old: DataFrame, new: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(id): nodes that vanished although their source was not rebuilt."""
    lost = old.join(new.select("id"), "id", "left_anti").where("source_file is not null and source_file <> ''")
    return lost.join(rebuilt.select("source_file"), "source_file", "left_anti").select("id")


def append_unseen(stored: DataFrame, added: DataFrame, key: str) -> DataFrame:
    return stored.unionByName(added.where(F.col(key).isNotNull()).join(stored.select(key), key, "left_anti").select(*stored.columns))


def merge_by_label(nodes: DataFrame) -> DataFrame:
    """(id, merged): nodes without a source file go to the smallest id of their exact label that has one."""
    known = nodes.where("coalesce(source_file, '') <> '' and label is not null").groupBy("label").agg(F.min("id").alias("home"))
    loose = F.coalesce(F.col("source_file"), F.lit("")) == ""
    return nodes.join(known, "label", "left").select("id", F.when(loose & F.col("home").isNotNull(), F.col("home")).otherwise(F.col("id")).alias("merged"))


def unique_label_targets(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id) of the names that are the label of exactly one node."""
    index = nodes.select(F.regexp_replace(F.lower("label"), r"\(\)$", "").alias("name"), "id").where("name is not null").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    return names.select("name").distinct().join(index, "name").select("name", "id")


def members(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group, members): how many members of each group exist; groups without any are dropped."""
    held = groups.select("group", F.explode("members").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    return held.groupBy("group").agg(F.count("*").alias("members"))
