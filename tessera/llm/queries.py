"""The pN_ queries of the problems tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.handwritten import made

    return made(read(spark, d, "sources"), read(spark, d, "nodes"))


def p1_validation(spark: SparkSession, d: str) -> DataFrame:
    """How each classifier does on the repositories held out of the fit, against the weak labels of its side."""
    from tessera.llm.handwritten import validation

    return spark.createDataFrame(validation(read(spark, d, "sources")), "side string, files int, labelled int, found int, both int")


def p2_chunks(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.packing import pack_sources

    return pack_sources(read(spark, d, "sources"), nodes=read(spark, d, "nodes"))


def p2_fill(spark: SparkSession, d: str) -> DataFrame:
    """Number of chunks, characters, and the least number any packing could need."""
    from tessera.llm.packing import CAPACITY, pack_sources

    chunks = pack_sources(read(spark, d, "sources"), nodes=read(spark, d, "nodes")).groupBy("chunk").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    return chunks.agg(F.count("*").alias("chunks"), F.sum("n").alias("chars"), F.ceil(F.sum("n") / CAPACITY).alias("bound"), F.max("n").alias("fullest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.splitting import long_files

    return long_files(read(spark, d, "sources"), nodes=read(spark, d, "nodes"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.splitting import split_sources

    return split_sources(read(spark, d, "sources"), nodes=read(spark, d, "nodes"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.encoding import encode

    return encode(read(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.mixing import mix, shares

    targets = read(spark, d, "mix_targets")
    return shares(mix(read(spark, d, "documents"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from tessera.llm.spam import spam

    return spam(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_validation, p2_chunks, p2_fill, p4_found, p4_pieces, p6_ids, p7_mix, p7_shares, p8_found)}


def oracle_sql() -> dict[str, str]:
    present = """(SELECT source_file, any_value(content) AS content FROM
      (SELECT *, rank() OVER (PARTITION BY source_file ORDER BY mtime DESC NULLS LAST) AS r FROM sources) WHERE r = 1 GROUP BY source_file)"""
    return {"p4_found": f"SELECT source_file FROM {present} WHERE length(content) > 12000"}
