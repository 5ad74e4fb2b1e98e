"""Readers of semi-structured text, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def html_text(html: Column, cap: int = 8000) -> Column:
    """Text of a page: scripts and styles dropped, tags to spaces, white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    return F.substring(F.btrim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"[ \t\r\n]+", " ")), 1, cap)


def links(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, url): the distinct http links of each text, ended by white space of any script."""
    return texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"https?://[^\s\p{Z}\x{85}<>\"\)\]|]+"), F.lit(0))).alias("url")).distinct()


def headings(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, title, parent): Markdown headings outside of code fences, and the line of
    the nearest heading above of a smaller level (0 if none). Per file by array functions, without a shuffle."""
    lines = F.transform(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    fenced = sources.select(key, lines.alias("lines")).withColumn("fences", F.filter("lines", lambda x: x["text"].rlike(r"^\s*(```|~~~)")))
    heads = F.filter("lines", lambda x: x["text"].rlike(r"^#{1,6}\s+\S") & (F.size(F.filter("fences", lambda f: f["line"] < x["line"])) % 2 == 0))
    found = F.transform(heads, lambda x: F.struct(x["line"].alias("line"), F.length(F.regexp_extract(x["text"], r"^(#+)", 1)).alias("level"), F.btrim(F.regexp_replace(x["text"], r"^#+\s+", "")).alias("title")))
    parent = F.transform("heads", lambda x: F.struct(x["line"].alias("line"), x["level"].alias("level"), x["title"].alias("title"), F.coalesce(F.array_max(F.transform(F.filter("heads", lambda y: (y["line"] < x["line"]) & (y["level"] < x["level"])), lambda y: y["line"])), F.lit(0)).alias("parent")))
    return fenced.select(key, found.alias("heads")).select(key, F.explode(parent).alias("h")).select(key, "h.*")


def server_config(configs: DataFrame, text: str) -> DataFrame:
    """(server, command, variables) of tool-server maps; values of the environment are never selected."""
    shape = "struct<mcpServers: map<string, struct<command: string, args: array<string>, env: map<string, string>>>>"
    parsed = configs.select(F.explode(F.from_json(F.col(text), shape)["mcpServers"]).alias("server", "x"))
    return parsed.select("server", "x.command", F.sort_array(F.map_keys("x.env")).alias("variables"))


def front_matter(docs: DataFrame, text: str) -> DataFrame:
    field = lambda name: F.nullif(F.btrim(F.regexp_extract(F.col(text), rf"(?m)^{name}:[ \t]*\"?([^\"\n]*)\"?[ \t]*$", 1)), F.lit(""))
    names = F.filter(F.transform(F.split(F.regexp_extract(F.col(text), r"(?m)^source_nodes:[ \t]*\[([^\]]*)\]", 1), ","), lambda x: F.btrim(x, F.lit(" \"'"))), lambda x: x != "")
    return docs.select("*", *(field(n).alias(n) for n in ("type", "date", "question", "outcome", "contributor", "correction")), names.alias("source_nodes"))


def defanged(text: Column) -> Column:
    """Chat-control tokens made harmless."""
    return F.regexp_replace(text, r"<\|([A-Za-z_]+)\|>", r"< | $1 | >")
