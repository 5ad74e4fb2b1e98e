"""Resolution by rules: ignore patterns, alias chains, symbol indexes, nearest ancestors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression on a path, negated) of a line of an ignore file, or None for comments and blanks."""
    rule = re.sub(r"(?<!\\) +$", "", line.rstrip("\n"))
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    folder, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
    rule = rule.strip("/")
    out, i = "", 0
    while i < len(rule):
        if rule[i : i + 3] == "**/":
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rule[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif rule[i] in "*?":
            out, i = out + ("[^/]*" if rule[i] == "*" else "[^/]"), i + 1
        elif rule[i] == "\\" and i + 1 < len(rule):
            out, i = out + re.escape(rule[i + 1]), i + 2
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.+' if folder else '(?:/.*)?'}$", negated


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether a path is ignored: the last matching rule wins, but nothing below an excluded folder
    comes back, as a folder's exclusion also matches all paths in it before a later `!`."""
    out: Column = F.lit(False)
    for rule in filter(None, map(ignore_regex, lines)):
        regex, negated = rule
        hit = path.rlike(regex)
        if negated:
            parents = F.lit(False)  # an excluded parent folder cannot be reopened by a rule for a file in it
            for earlier in filter(None, map(ignore_regex, lines)):
                if earlier == rule:
                    break
                if not earlier[1]:
                    parents = parents | F.regexp_extract(path, r"^(.*)/[^/]*$", 1).rlike(earlier[0])
            out = F.when(hit & ~parents, False).otherwise(out)
        else:
            out = F.when(hit, True).otherwise(out)
    return out


def follow(links: DataFrame) -> DataFrame:
    """(name, end, hops): all ends that chains of (name, to) reach, and the fewest links to each. An end
    leads nowhere; names that lead only into cycles reach none and are left out. From the ends back,
    each level joins the pairs found last with the links; pairs known before are cut out by an anti-join."""
    links = cut(links.select("name", "to").where("name is not null and to is not null").distinct())
    new = cut(links.join(links.select(F.col("name").alias("to")).distinct(), "to", "left_anti").select("name", F.col("to").alias("end"), F.lit(1).alias("hops")))
    seen, level = new, 1
    while not new.isEmpty():
        level += 1
        up = links.join(new.select(F.col("name").alias("to"), "end"), "to").select("name", "end").distinct()
        new = cut(up.join(seen.select("name", "end"), ["name", "end"], "left_anti").withColumn("hops", F.lit(level)))
        seen = seen.unionByName(new)
        if level % 16 == 0:  # else the plan grows with the chains
            seen = cut(seen)
    return seen


def nearest(owners: DataFrame, parents: DataFrame, members: DataFrame, most: int = 16) -> DataFrame:
    """(key, target, hops): for each (key, owner, name), the member of that name on the nearest base
    of the owner, if that base has exactly one."""
    unique = members.groupBy("owner", "name").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n"))
    open_, out = owners.select("key", F.col("owner").alias("at"), "name"), None
    links = parents.select(F.col("child").alias("at"), F.col("base")).distinct()
    for hop in range(1, most + 1):
        up = cut(open_.join(links, "at").select("key", F.col("base").alias("at"), "name").distinct())
        if up.isEmpty():
            break
        met = up.join(unique.withColumnRenamed("owner", "at"), ["at", "name"])
        found = met.groupBy("key").agg(F.min("id").alias("target"), F.countDistinct("id").alias("k"), F.max("n").alias("n"))
        good = found.where("k = 1 and n = 1").select("key", "target", F.lit(hop).alias("hops"))
        out = good if out is None else out.unionByName(good)
        open_ = up.join(found.select("key"), "key", "left_anti")
    return out if out is not None else owners.select("key", F.lit(None).cast("string").alias("target"), F.lit(0).alias("hops")).where("false")


def symbol_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions (symbol, path, kind) and relations (source, target, path) of symbol-index documents
    (json): a relation's target is taken from its own document, else from the only other one that has it."""
    shape = "struct<documents: array<struct<relative_path: string, symbols: array<struct<symbol: string, kind: string, relationships: array<struct<symbol: string>>>>>>>"
    docs = documents.select(F.explode(F.from_json("json", shape)["documents"]).alias("d"))
    symbols = docs.select(F.col("d.relative_path").alias("path"), F.explode("d.symbols").alias("s"))
    defined = symbols.select("s.symbol", "path", "s.kind").distinct()
    wanted = symbols.select("path", F.col("s.symbol").alias("source"), F.explode("s.relationships.symbol").alias("target"))
    own = defined.select(F.col("symbol").alias("target"), "path", F.col("path").alias("here"))
    only = defined.groupBy(F.col("symbol").alias("target")).agg(F.min("path").alias("there"), F.countDistinct("path").alias("n"))
    joined = wanted.join(own, ["target", "path"], "left").join(only, "target", "left")
    return defined, joined.select("source", "target", F.coalesce("here", F.when(F.col("n") == 1, F.col("there")), F.lit("stub")).alias("path")).distinct()


def within_budget(lines: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """The first lines whose running length (with line ends) stays within the budget. For rendered
    results, which are bounded by the query's top-k or depth."""
    running = F.sum(F.length("line") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("upto", running).where(F.col("upto") <= budget)
