"""Lessons from dated outcomes: decayed scores, provenance and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 30.0
#: A day by itself or, as SQL has it, with a time of day and what follows that.
_DAY = r"(?s)\A\s*(\d{1,7})([-/\\ ])(\d{1,2})\2(\d{1,2})(?:\s*|[T ]\s*(?:[01]?\d|2[0-4]):[0-5]?\d(?!\d).*)\z"


def day(written: Column) -> Column:
    """The day that a text says; null where it says none, or more. A cast would end the query there, or
    read "2025" and "2025-05-17 or so" as days."""
    year = F.regexp_extract(written, _DAY, 1)
    parts = [F.lpad(year, F.greatest(F.length(year), F.lit(4)), F.lit("0")), F.regexp_extract(written, _DAY, 3), F.regexp_extract(written, _DAY, 4)]
    return F.concat_ws("-", *parts).try_cast("date")


def decay(at: Column, now: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400e6
    return F.when(at.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / half_life))


def lessons(outcomes: DataFrame, now: Column) -> DataFrame:
    """(node, score, pos, neg, last, verdict) of (node, outcome, at), outcome being useful, dead_end or corrected."""
    sign = F.when(F.col("outcome") == "useful", 1).when(F.col("outcome") == "dead_end", -1).otherwise(0)
    made = outcomes.groupBy("node").agg(F.round(F.sum(sign * decay(F.col("at"), now)), 6).alias("score"), F.count_if(sign > 0).alias("pos"), F.count_if(sign < 0).alias("neg"), F.max("at").alias("last"))
    verdict = F.when((F.col("pos") >= 2) & (F.col("neg") == 0), "preferred").when((F.col("pos") > 0) & (F.col("neg") > 0), "contested").when(F.col("pos") > 0, "tentative").otherwise("avoided")
    return made.withColumn("verdict", verdict)


def provenance(outcomes: DataFrame, most: int = 5) -> DataFrame:
    """(node, place, event_id): the last events of each node."""
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("at"), F.desc("event_id")))
    return outcomes.withColumn("place", place).where(F.col("place") <= most).select("node", "place", "event_id")


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, n): bursts of events without a pause of `gap`, by session windows."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def plurality(votes: DataFrame, key: str, choice: str) -> DataFrame:
    """(key, choice): the most frequent choice, the smallest on ties. Two partial aggregates, no window."""
    counts = votes.where(F.col(choice).isNotNull()).groupBy(key, choice).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(choice, F.struct(-F.col("n"), F.col(choice))).alias(choice))
