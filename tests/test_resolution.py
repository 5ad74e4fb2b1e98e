"""Ignore rules, chains, nearest bases and symbol indexes."""

import json

from pyspark.sql import functions as F

from tessera.operators import resolution as r


def _ignored(spark, lines, paths):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    return {x.p for x in df.where(r.ignored(F.col("p"), lines)).collect()}


def test_ignore_rules(spark):
    paths = ["a.log", "x/a.log", "keep.log", "build/o.c", "x/build/o.c", "docs/a/b.md", "docs/b.md", "src/build.py", "build"]
    assert _ignored(spark, ["*.log", "!keep.log", "# note", ""], paths) == {"a.log", "x/a.log"}
    assert _ignored(spark, ["build/"], paths) == {"build/o.c", "x/build/o.c"}
    assert _ignored(spark, ["/build/"], paths) == {"build/o.c"}
    assert _ignored(spark, ["docs/*.md"], paths) == {"docs/b.md"}
    assert _ignored(spark, ["docs/**/b.md"], paths) == {"docs/a/b.md", "docs/b.md"}
    assert _ignored(spark, ["build", "!build/o.c"], paths) == {"build/o.c", "x/build/o.c", "build"}


def test_chains(spark):
    links = [(f"c{i}", f"c{i + 1}") for i in range(20)] + [("x", "y"), ("y", "x"), ("z", "x"), ("s", "end")]
    got = {(t.name, t.end, t.hops) for t in r.follow(spark.createDataFrame(links, "name string, to string")).collect()}
    assert got == {(f"c{i}", "c20", 20 - i) for i in range(20)} | {("s", "end", 1)}
    assert r.follow(spark.createDataFrame([], "name string, to string")).count() == 0


def test_nearest_base(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("d", "e")], "child string, base string")
    members = spark.createDataFrame([("c", "run", "c.run"), ("b", "stop", "b.stop"), ("e", "stop", "e.stop"), ("b", "two", "b.two1"), ("b", "two", "b.two2")], "owner string, name string, id string")
    owners = spark.createDataFrame([("k1", "a", "run"), ("k2", "a", "stop"), ("k3", "d", "stop"), ("k4", "a", "two"), ("k5", "a", "none")], "key string, owner string, name string")
    got = {(t.key, t.target, t.hops) for t in r.nearest(owners, parents, members).collect()}
    assert got == {("k1", "c.run", 2), ("k2", "b.stop", 1)}


def test_symbol_index(spark):
    doc = {"documents": [{"relative_path": "a", "symbols": [{"symbol": "S", "kind": "class", "relationships": [{"symbol": "T"}, {"symbol": "U"}, {"symbol": "V"}, {"symbol": "W"}]}, {"symbol": "T", "kind": "x", "relationships": []}, {"symbol": "V", "kind": "x"}]}, {"relative_path": "b", "symbols": [{"symbol": "U", "kind": "x"}, {"symbol": "V", "kind": "x"}]}]}
    defined, relations = r.symbol_index(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    assert defined.count() == 5
    assert {(t.target, t.path) for t in relations.collect()} == {("T", "a"), ("U", "b"), ("V", "a"), ("W", "stub")}
