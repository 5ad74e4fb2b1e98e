"""The present state of source files, without moving their contents.

A file's present state is its scan with the greatest mtime; ties are equal, the smallest scan_id
stands for them. A null mtime is older than any. A scan without a path is no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.rules import slashes


def _age() -> Column:
    start = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(F.col("mtime").cast("timestamp_ntz"), start)


def named(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of `files` whose source_file some node names, in whatever spelling of separators and
    prefixes. Only the distinct paths of the nodes are shuffled."""
    path = F.regexp_replace(slashes(F.btrim("source_file")), r"/(\./|/)+", "/")
    paths = nodes.select(path.alias("source_file")).distinct()
    return files.join(paths, "source_file", "left_semi")


def with_version(sources: DataFrame, *columns: Column) -> DataFrame:
    """(source_file, version, columns): `version` grows with the time of the scan."""
    version = F.struct(_age().alias("at"), (-F.coalesce(F.col("scan_id"), F.lit(0))).alias("scan"))
    return sources.where("source_file is not null").select("source_file", version.alias("version"), *columns)


def latest(versions: DataFrame, *names: str) -> DataFrame:
    """The named values of each file's greatest version. These should be narrow: they are shuffled."""
    held = F.struct(*names).alias("held")
    return versions.groupBy("source_file").agg(F.max_by(held, "version").alias("held")).select("source_file", "held.*")


def present_texts(sources: DataFrame, least: int = 0, nodes: DataFrame | None = None) -> DataFrame:
    """(source_file, content) of the files whose present content has more than `least` characters;
    with `nodes`, of those that some node names.

    Only paths, times and lengths are shuffled to find the present scans; of the contents, only
    those that long are joined to them.
    """
    content = F.col("content")
    sizes = with_version(sources, F.length(content).alias("n"))
    now = sizes.groupBy("source_file").agg(F.max(F.struct("version", "n")).alias("m")).where(F.col("m.n") > least)
    now = now.select("source_file", F.col("m.version").alias("version"))
    now = now if nodes is None else named(now, nodes)
    texts = with_version(sources, content.alias("content")).where(F.length("content") > least)
    return texts.join(now, ["source_file", "version"], "left_semi").dropDuplicates(["source_file"]).select("source_file", "content")
