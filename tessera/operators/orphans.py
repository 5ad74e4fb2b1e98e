"""Problem 5: references to records that do not exist, as of the time of the reference.

A blocked Bloom filter of all parent ids, one 64-bit word per id, proves definite orphans: they
are `missing` and take part in no join with the parents. Only the references that pass the
filter are checked by an exact join with the captures and removals of their id.

The filter has a word for every IDS_A_WORD distinct parents, so that about one orphan in a
hundred passes, whatever the number of parents. Up to MAX_WORDS words it is broadcast; a larger
one stays partitioned by word and meets the references there, of which only numbers are moved.
Both joins are salted for ids that a sample of the references shows to be hot; the sample decides
on the route alone, never on a result.

Of each id the exact join needs its first capture, the time of the last removal that no capture
follows, and, by month, the closed spans in which it was deleted. Spans are found by windows over
an id's captures and removals of one month and over one row per month, never over all its rows.
Only references to ids with closed spans meet these, by id and month.

Null endpoints and those without a letter or digit are no references. A null `captured_at` of
a node means from the start; of a reference, the end of time. A removal with a null time or id
is void. Where a capture and a removal tie, the capture counts as the later. Repeated rows
count once. Empty tables give empty results (an empty parent table leaves every reference
missing). Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ids import node_reference
from tessera.session import cut

MIN_WORDS, MAX_WORDS, IDS_A_WORD = 2**10, 2**20, 3
#: Bits set per id in its word.
BITS = 4
#: A key with this share of the sampled references is salted, so that there are at most 1/HOT_SHARE such keys.
SAMPLE, HOT_SHARE, SALTS = 0.02, 0.003, 32
_START, _END = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def _time(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _word_and_mask(key: str, words: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(7))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return [F.pmod(F.xxhash64(key), F.lit(words).cast("long")).alias("word"), mask.alias("mask")]


def words_for(parents: int) -> int:
    words = MIN_WORDS
    while words * IDS_A_WORD < parents:
        words *= 2
    return words


def bloom_filter(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits): the words of the filter that are not empty."""
    return keys.select(*_word_and_mask(key, words)).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def _month(at: str) -> Column:
    return F.year(at) * 12 + F.month(at)


def lifetimes(nodes: DataFrame, shared: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, first, gone, closed): first capture, last removal without a later capture, and whether
    there are closed spans; and (node_id, month, from, until): these, once per month they touch."""
    ids = lambda df, at: df.select(node_reference(F.col("id")).alias("node_id"), at.alias("at"))
    captures = ids(nodes, F.coalesce(F.col("captured_at").cast("timestamp_ntz"), _time(_START))).unionByName(ids(shared, _time(_START))).where("node_id is not null")
    removals = ids(removed, F.col("removed_at").cast("timestamp_ntz")).where("node_id is not null and at is not null").distinct()
    first = captures.groupBy("node_id").agg(F.min("at").alias("first"))

    again = captures.join(removals.select("node_id").distinct(), "node_id", "left_semi").distinct()
    events = removals.withColumn("capture", F.lit(0)).unionByName(again.withColumn("capture", F.lit(1))).withColumn("month", _month("at"))
    captured = F.when(F.col("capture") == 1, F.col("at"))
    rest = Window.partitionBy("node_id", "month").orderBy("at", "capture").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = events.withColumn("near", F.first(captured, ignorenulls=True).over(rest)).where("capture = 0")
    months = events.groupBy("node_id", "month").agg(F.min(captured).alias("c"))
    later = Window.partitionBy("node_id").orderBy("month").rowsBetween(1, Window.unboundedFollowing)  # one row per month
    far = months.select("node_id", "month", F.first("c", ignorenulls=True).over(later).alias("far"))
    spans = near.join(far, ["node_id", "month"]).groupBy("node_id", F.coalesce("near", "far").alias("until")).agg(F.min("at").alias("from")).where("until is null or until > `from`")
    open_ = spans.groupBy("node_id").agg(F.min(F.when(F.col("until").isNull(), F.col("from"))).alias("gone"), (F.count("until") > 0).alias("closed"))
    whole = first.join(open_, "node_id", "full")
    touched = F.explode(F.sequence(_month("from"), _month("until"))).alias("month")
    return whole, spans.where("until is not null").select("node_id", touched, "from", "until")


def orphans(edges: DataFrame, nodes: DataFrame, shared: DataFrame, removed: DataFrame) -> DataFrame:
    """(edge_id, side, status, month): one row per faulty endpoint of a distinct edge."""
    lives, spans = map(cut, lifetimes(nodes, shared, removed))  # narrow, one row per parent and per span
    words = words_for(lives.count())

    ends = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("node_id")) for side in ("source", "target"))))
    references = (
        edges.select("edge_id", F.coalesce(F.col("captured_at").cast("timestamp_ntz"), _time(_END)).alias("at"), node_reference(F.col("source")).alias("source"), node_reference(F.col("target")).alias("target"))
        .select("edge_id", "at", ends.alias("e")).select("edge_id", "at", "e.*").where("node_id is not null")
    )
    hot = hot_ids(edges)
    is_hot = F.col("node_id").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("edge_id"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")

    bloom = bloom_filter(lives, "node_id", words)
    if words <= MAX_WORDS:
        tested = references.select("*", salt.alias("salt"), *_word_and_mask("node_id", words)).join(F.broadcast(bloom), "word", "left")  # at most MAX_WORDS rows of two numbers
    else:
        many = lives.select("node_id", salts).where("salt > 0").select(F.pmod(F.xxhash64("node_id"), F.lit(words).cast("long")).alias("word"), "salt").distinct()
        salted = bloom.withColumn("salt", F.lit(0)).unionByName(bloom.join(F.broadcast(many), "word"))  # at most SALTS / HOT_SHARE rows
        tested = references.select("*", salt.alias("salt"), *_word_and_mask("node_id", words)).join(salted, ["word", "salt"], "left")
    tested = tested.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))
    definite = tested.where("not maybe").select("edge_id", "at", "side", F.lit("missing").alias("status"))

    checked = tested.where("maybe").select("edge_id", "at", "side", "node_id", "salt")
    met = checked.join(lives.select("*", salts), ["node_id", "salt"], "left")
    status = F.when(F.col("gone") <= F.col("at"), "deleted").when(F.col("first") <= F.col("at"), None).when(F.col("first").isNotNull(), "late").otherwise("missing")
    plain = met.select("edge_id", "at", "side", status.alias("status")).where("status is not null")
    # a closed span leaves a reference without a fault, as the capture that ends it may be after it
    closed = met.where("closed").select("edge_id", "at", "side", "node_id", "salt", _month("at").alias("month"))
    in_span = closed.join(spans.select("node_id", "month", "from", "until", salts), ["node_id", "salt", "month"]).where("`from` <= at and until > at")
    found = definite.unionByName(plain).unionByName(in_span.select("edge_id", "at", "side", F.lit("deleted").alias("status")))
    return found.groupBy("edge_id", "side").agg(F.min("status").alias("status"), F.min("at").alias("at")).select("edge_id", "side", "status", F.date_trunc("month", F.nullif("at", _time(_END))).cast("date").alias("month"))


def hot_ids(edges: DataFrame) -> list[str]:
    """The at most 1/HOT_SHARE ids that hold that share of a sample of the references."""
    seen = edges.select(F.explode(F.array("source", "target")).alias("key")).where("key is not null").sample(SAMPLE, 11)
    counts = seen.groupBy("key").agg(F.count("*").alias("n")).groupBy(node_reference(F.col("key")).alias("node_id")).agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over the rows of a top-k
    top = counts.orderBy(F.desc("n")).limit(int(1 / HOT_SHARE)).withColumn("all", whole)
    return [r.node_id for r in top.where(F.col("n") >= HOT_SHARE * F.col("all")).where("node_id is not null").collect()]


def orphan_report(found: DataFrame) -> DataFrame:
    """Faults per endpoint column, kind and month."""
    return found.groupBy("side", "status", F.date_format("month", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
