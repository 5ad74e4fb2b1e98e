"""Operators that SQL does not express, against brute force or literal graphs."""

import random

from tessera.operators import graph as g
from tessera.operators import search as s
from tessera.sources import extractors, text


def _edges(spark, rows):
    return spark.createDataFrame([(i, *r, "EXTRACTED", None, None, None, None, None) for i, r in enumerate(rows)], "edge_id long, source string, target string, relation string, confidence string, confidence_score double, weight double, context string, source_file string, captured_at timestamp_ntz")


def test_components_against_union_find(spark):
    rng = random.Random(4)
    pairs = [(f"v{rng.randrange(120):03}", f"v{rng.randrange(120):03}") for _ in range(70)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in s.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {v: find(v) for v in root}


def test_undirected_collapse_folds_in_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice("abc"), rng.choice(["r1", "r2", "r3"])) for _ in range(60)]
    fold = {}
    for source, target, relation in sorted(set(rows)):
        pair = frozenset((source, target))
        if pair in fold and fold[pair][:2] == (target, source) and fold[pair][2] == relation and source != target:
            continue
        fold[pair] = (source, target, relation)
    got = {tuple(r) for r in g.collapse_undirected(_edges(spark, rows)).collect()}
    assert got == set(fold.values())


def test_search_prefers_exact_labels(spark):
    nodes = spark.createDataFrame([("1", "token cache", "a/b.py"), ("2", "cache", "a/token.py"), ("3", "Tokén", None), ("4", None, None), ("5", "other", "x.py")], "id string, label string, source_file string")
    ranked = [r.id for r in s.ranked(nodes, "where is the token cache").orderBy("score", ascending=False).collect()]
    assert ranked[0] == "1" and set(ranked) == {"1", "2", "3"}
    assert s.query_terms("how does it") == ["how", "does"]
    assert [r.id for r in s.seeds(s.ranked(nodes, "token cache")).collect()] == ["1"]


def test_breadth_first_does_not_pass_hubs(spark):
    rows = [("s", "hub", "r"), ("hub", "beyond", "r"), ("s", "x", "r"), ("x", "y", "r")] + [("hub", f"leaf{i}", "r") for i in range(60)]
    start = spark.createDataFrame([("s",)], "id string")
    got = {r.id: r.hops for r in s.breadth_first(_edges(spark, rows), start, 3).collect()}
    assert got == {"s": 0, "hub": 1, "x": 1, "y": 2}
    assert {r.id for r in s.affected(_edges(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("z", "c", "other")]), spark.createDataFrame([("c",)], "id string"), ["calls"]).collect()} == {"a", "b"}


def test_headings_and_front_matter(spark):
    doc = "# A\n\n```\n# no\n```\n## B\ntext\n### C\n## D\n"
    rows = text.headings(spark.createDataFrame([(1, doc), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert {(r.title, r.level, r.parent) for r in rows} == {("A", 1, 0), ("B", 2, 1), ("C", 3, 6), ("D", 2, 1)}
    memo = '---\ntype: qa\ndate: "2026-01-01"\nquestion: "why?"\noutcome: useful\nsource_nodes: ["a", b]\n---\nbody'
    row = text.front_matter(spark.createDataFrame([(memo,)], "t string"), "t").first()
    assert (row.type, row.date, row.outcome, row.source_nodes, row.correction) == ("qa", "2026-01-01", "useful", ["a", "b"], None)
    config = '{"mcpServers": {"db": {"command": "run", "args": ["x"], "env": {"KEY": "secret"}}}}'
    row = text.server_config(spark.createDataFrame([(config,)], "t string"), "t").first()
    assert (row.server, row.command, row.variables) == ("db", "run", ["KEY"])


def test_extractors(spark):
    files = [("r/a.py", "import os\nclass A(B):\n  def f(self):\n    g()\n"), ("r/b.sql", "create table t(id int references u(id)); create view v as select * from t"), ("r/c.py", "def ("), ("r/d.go", 'import "fmt"\nfunc (x *T) Run() {}\ntype T struct{}'), ("r/e.unknown", "x"), ("r/f.py", None)]
    rows = extractors.extract(spark.createDataFrame(files, "source_file string, content string")).collect()
    nodes = {(r.source_file, r.kind, r.label) for r in rows if r.part == "node"}
    assert {("r/a.py", "class", "A"), ("r/a.py", "function", "f()"), ("r/b.sql", "table", "t"), ("r/b.sql", "view", "v"), ("r/d.go", "function", "Run()"), ("r/c.py", "file", "c.py"), ("r/f.py", "file", "f.py")} <= nodes
    uses = {(r.kind, r.target) for r in rows if r.part == "edge" and r.kind != "contains"}
    assert {("imports", "os"), ("inherits", "b"), ("calls", "g"), ("references", "u"), ("reads_from", "t"), ("imports_from", "fmt")} <= uses
