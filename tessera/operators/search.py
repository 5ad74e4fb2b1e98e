"""Ranked search over labels and bounded traversal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ids import search_form
from tessera.operators.graph import both_ways, degree, first_by
from tessera.session import cut

# Question and filler words that seed no search.
STOPWORDS = frozenset(
    # English
    "how what why when where which who whom whose does did is are was were be been being can could should would will shall may might must has have had the and but not for from with"
    " without into onto off that this these those there here its their them they about any all some work works working"
    # German
    " der die das den dem ein eine und oder nicht wie wer wann wo warum wieso welche welcher welches ist sind wird wurde hat haben kann koennen können soll muss sich"
    " bei mit von fuer für ueber über nach aus gibt es funktioniert geaendert geändert aendert ändert"
    # French
    " pourquoi quand quel quelle quels quelles quoi qui que est sont fonctionne cette dans avec où"
    # Spanish
    " cómo como qué cuál cuáles cuándo dónde donde porque por para funciona está están hay"
    # Portuguese
    " qual quais quando onde são estão tem uma não"
    # Italian
    " perché cosa quale quali dove funziona sono che della".split()
)
CONTEXT_HINTS = {
    "call": "call calls called invoke invokes invoked",
    "import": "import imports imported module modules",
    "field": "field fields member members property properties",
    "parameter_type": "parameter parameters param params argument arguments",
    "return_type": "return returns returned",
    "generic_arg": "generic generics template templates",
}
EXACT, PREFIX, FULL_EXACT, FULL_PREFIX, SOURCE = 1000.0, 100.0, 10000.0, 1000.0, 0.5


def query_terms(question: str) -> list[str]:
    """Words of more than two letters without fillers; all of them if nothing else is left."""
    terms = [t for t in re.findall(r"\w+", question.lower()) if len(t) > 2 or not t.isascii()]
    return list(dict.fromkeys([t for t in terms if t not in STOPWORDS] or terms))


def context_filters(question: Column) -> Column:
    """Contexts that the words of a question hint at, in the order of the hints."""
    tokens = F.split(search_form(F.translate(question, "?,", "  ")), r"\s+")
    hinted = [F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words.split()))), name) for name, words in CONTEXT_HINTS.items()]
    return F.array_compact(F.array(*hinted))


def searchable(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("norm", search_form(F.coalesce("label", F.lit("")))).withColumn("file", F.lower(F.coalesce("source_file", F.lit(""))))


def idf(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, idf): df counts the labels that contain the term. One pass, one row per term."""
    counted = searchable(nodes).agg(F.count("*").alias("n"), *(F.count_if(F.col("norm").contains(t)).alias(f"t{i}") for i, t in enumerate(terms)))
    rows = counted.select("n", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)))).alias("x")).select("n", "x.*")
    return rows.select("term", "df", F.round(F.log(1 + F.greatest("n", F.lit(1)) / (1 + F.col("df"))), 9).alias("idf"))


def ranked(nodes: DataFrame, question: str) -> DataFrame:
    """(id, label, score) of all nodes that match, by the tiers exact, prefix, contained, source.

    The terms become expressions of one projection over the nodes; their idf is one row per term."""
    terms = query_terms(question)
    weights = {r.term: r.idf for r in idf(nodes, terms).collect()}
    whole, top = " ".join(terms), max(weights.values(), default=0.0)
    name = F.col("norm")
    bare = F.regexp_replace(name, r"\(\)$", "")
    tier, rest, matched = F.lit(0.0), F.lit(0.0), F.lit(0)
    for t in terms:
        w = weights[t]
        tier += F.when(bare == t, EXACT * w).when(bare.startswith(t), PREFIX * w).otherwise(0.0)
        rest += F.when((bare != t) & ~bare.startswith(t) & name.contains(t), w).otherwise(0.0) + F.when(F.col("file").contains(t), SOURCE * w).otherwise(0.0)
        matched += name.contains(t).cast("int")
    full = F.when(bare == whole, FULL_EXACT * top).when(bare.startswith(whole), FULL_PREFIX * top).otherwise(0.0)
    score = full + tier * F.pow(matched / len(terms), F.lit(2)) + rest
    return searchable(nodes).select("id", "label", F.round(score, 6).alias("score")).where("score > 0")


def seeds(scores: DataFrame, most: int = 3, gap: float = 0.2) -> DataFrame:
    """At most three seeds, one per label, none under a fifth of the best score."""
    order = [F.desc("score"), F.length("label"), F.col("id")]
    one = first_by(scores.withColumn("key", F.lower(F.coalesce("label", F.lit("")))), ["key"], order)
    few = one.orderBy(*order).limit(most).withColumn("best", F.max("score").over(Window.partitionBy(F.lit(0))))
    return few.where(F.col("score") >= gap * F.col("best")).select("id", "label", "score")


def hub_threshold(degrees: DataFrame) -> DataFrame:
    """(threshold): max(50, the degree at index floor(0.99 n) of the sorted degrees), by counts per degree."""
    histogram = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    running = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return running.where(F.col("upto") > F.floor(F.col("all") * 0.99)).agg(F.greatest(F.lit(50), F.min("degree")).alias("threshold"))


def breadth_first(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hops): nodes within `depth` of the start over directed edges; hubs are reached but not
    passed. Each level joins the frontier with the edges; what was visited is cut out by an anti-join."""
    degrees = degree(edges)
    limit = degrees.join(F.broadcast(hub_threshold(degrees)), F.col("degree") >= F.col("threshold"), "left_semi").select("id")
    links = edges.select("source", "target").distinct()
    visited = start.select("id", F.lit(0).alias("hops"))
    frontier = start.select("id")
    for hop in range(1, depth + 1):
        reached = links.join(frontier.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        new = cut(reached.join(visited, "id", "left_anti"))
        visited = visited.unionByName(new.withColumn("hops", F.lit(hop)))
        frontier = new.join(limit, "id", "left_anti")
    return visited


def affected(edges: DataFrame, start: DataFrame, relations: list[str], depth: int = 2) -> DataFrame:
    """(id, hops, via): what depends on the start over the given relations, against their direction."""
    links = edges.where(F.col("relation").isin(relations)).select("source", "target", "relation").distinct()
    seen = start.select("id")
    frontier, out = seen, None
    for hop in range(1, depth + 1):
        reached = links.join(frontier.withColumnRenamed("id", "target"), "target", "left_semi").groupBy(F.col("source").alias("id")).agg(F.min("relation").alias("via"))
        new = cut(reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        seen, frontier = seen.unionByName(new.select("id")), new.select("id")
        out = new if out is None else out.unionByName(new)
    return out.select("id", "hops", "via")


def distances(links: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(id, hops): distances from the start over links (id, other) in both directions, at most `most`."""
    start = cut(start)
    seen = start.select("id", F.lit(0).alias("hops"))
    frontier = start.select("id")
    for hop in range(1, most + 1):
        reached = links.join(frontier, "id", "left_semi").select(F.col("other").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(direction, id, relation): successors and predecessors."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("id"), "relation")
    return out.unionByName(edges.where(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("source").alias("id"), "relation")).distinct()


def components(simple: DataFrame) -> DataFrame:
    """(id, component) of pairs (a, b): smallest id reachable. Alternates large and small stars,
    so that the number of rounds grows with the logarithm of the diameter."""
    links = cut(simple.select("a", "b").where("a <> b").distinct())
    while True:
        out = both_ways(links)
        least = out.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("m"))
        large = out.join(least, "id").where("other > id").select(F.col("m").alias("a"), F.col("other").alias("b")).where("a <> b").distinct()
        near = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(near, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        after = cut(small)
        if after.exceptAll(links).isEmpty() and links.exceptAll(after).isEmpty():
            break
        links = after
    roots = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return roots.unionByName(links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
