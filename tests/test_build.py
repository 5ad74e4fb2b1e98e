"""Identity of nodes, namesakes and communities, against brute force on small fixtures."""

import os
import random

import pytest

from tessera.functions.ids import label_key_text, normalize_id_text
from tessera.operators import dedup, identity, rules
from tessera.plans import core_queries

NODES = "id string, label string, source_file string, source_location string, file_type string, parsed boolean, n long, found string, alias string"


def _nodes(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y") for r in rows], NODES)


def _ghosts(rows):
    canon, clash, last = {}, set(), {}
    by_id = {r[0]: r for r in rows}
    keys = {}
    for i, r in by_id.items():
        label, name = (r[1] or "").strip(" "), (r[2] or "").split("/")[-1]
        if label and name:
            keys[i] = (name, label)
    for i in sorted(keys):
        k, r = keys[i], by_id[i]
        if r[5]:
            if k in canon and by_id[canon[k]][5]:
                clash.add(k)
            canon[k] = i
        elif r[3] is not None:
            if k not in canon:
                canon[k] = i
            elif not by_id[canon[k]][5] and by_id[canon[k]][2] != r[2]:
                clash.add(k)
    for i in sorted(keys):
        k = keys[i]
        if not by_id[i][5] and k not in clash and k in canon and canon[k] != i:
            last[k] = i
    return {(i, canon[k]) for k, i in last.items()}


def test_ghosts(spark):
    rng = random.Random(1)
    for seed in range(3):
        rows = [(f"n{i:03}", rng.choice(["A", "B ", "C", None, " "]), rng.choice(["x/a.py", "y/a.py", "a.py", None, "x/b.md"]), rng.choice([None, "L1"]), "code", rng.random() < 0.15) for i in range(25)]
        got = {tuple(r) for r in identity.ghosts(_nodes(spark, rows)).select("end", "id").collect()}
        assert got == _ghosts(rows), seed
    assert identity.ghosts(_nodes(spark, [])).count() == 0


def test_endpoints_and_remapping(spark):
    nodes = _nodes(spark, [(i, "x", "f", None, "code", True) for i in ("a::b", "A_B", "größe", "plain", None)])
    edges = spark.createDataFrame([(1, "a-b", "plain", "r"), (2, "A_B", "GRÖSSE", "r"), (3, None, "gone", "r"), (1, "a-b", "plain", "s"), (4, "plain", "plain", "t")], "edge_id long, source string, target string, end string")
    got = {tuple(r) for r in identity.resolved_endpoints(edges, nodes).collect()}
    assert got == {(1, "A_B", "plain"), (2, "A_B", "größe"), (3, None, None), (4, "plain", "plain")}
    assert {tuple(r) for r in identity.aliases(nodes).collect()} == {("a_b", "A_B"), (normalize_id_text("größe"), "größe")}
    mapping = spark.createDataFrame([("a-b", "plain"), ("gone", "new")], "end string, id string")
    assert sorted((r.edge_id, r.source, r.target) for r in identity.remapped(edges, mapping).where("edge_id <> 2 and source is not null").collect()) == [(4, "plain", "plain")]
    assert identity.remapped(edges.where("false"), mapping).count() == 0


def test_doc_twins(spark):
    rows = [("d", "x", "a.md", None, "document", False), ("d_doc", "x", "a.md", None, "document", False), ("e_doc", "x", "b.md", None, "document", False), ("e", "x", "c.md", None, "document", False), ("f", "x", "d.md", None, "code", False), ("f_doc", "x", "d.md", None, "document", False)]
    assert [tuple(r) for r in identity.doc_twins(_nodes(spark, rows)).collect()] == [("d", "d_doc")]


def _winner(cands, call):
    is_test = lambda p: any(x in ("test", "tests") for x in p.split("/")[:-1])
    if len(cands) == 1:
        return next(iter(cands))
    tests = {c: f for c, f in cands.items() if is_test(f)}
    left = (tests or cands) if is_test(call) else {c: f for c, f in cands.items() if c not in tests}
    if len(left) == 1:
        return next(iter(left))
    folder = lambda p: p.split("/")[:-1]
    for same in (lambda f: f == call, lambda f: folder(f) == folder(call)):
        hit = [c for c, f in left.items() if same(f)]
        if hit:
            return hit[0] if len(hit) == 1 else None
    near = {c: next((i for i, (a, b) in enumerate(zip(folder(f), folder(call))) if a != b), min(len(folder(f)), len(folder(call)))) for c, f in left.items()}
    best = [c for c, k in near.items() if k == max(near.values(), default=0)]
    return best[0] if len(best) == 1 and near[best[0]] > 0 else None


def test_namesakes(spark):
    rng = random.Random(4)
    files = ["a/b/x.py", "a/b/y.py", "a/c/x.py", "a/tests/t.py", "z.py", "q/r/s/t.py", "a/b/d/e.py", "tests/u.py"]
    nodes = [(f"n{i:02}", rng.choice(["load()", "Load", "walk()", "emit", "one", None, "()"]), rng.choice(files), None, "code", True) for i in range(30)] + [("only", "single", "z.py", None, "code", True)]
    calls = [(f, n) for f in [*files, "a/b/new.py", "nowhere/at/all.py"] for n in ("load", "walk", "emit", "single", "missing")]
    want = set()
    for file, name in calls:
        cands = {i: f for i, label, f, *_ in nodes if label and label.lower().removesuffix("()") == name}
        if cands and (w := _winner(cands, file)):
            want.add((file, name, w))
    got = {tuple(r) for r in identity.namesakes(spark.createDataFrame(calls + calls[:5], "file string, name string"), _nodes(spark, nodes)).collect()}
    assert got == want and any(n == "load" for _, n, _ in want)


def test_communities_keep_their_names(spark):
    rng = random.Random(5)
    old = {f"n{i:03}": rng.randrange(6) * 3 for i in range(80)}
    new = {f"n{i:03}": old[f"n{i:03}"] + 100 if i < 80 and rng.random() < 0.6 else rng.choice([100, 101, 102, 103, 199]) for i in range(100)}
    pairs = sorted(((-sum(new[x] == b and old.get(x) == a for x in new), a, b) for a in set(old.values()) for b in set(new.values())))
    final, used = {}, set()
    for n, a, b in pairs:
        if n and a not in used and b not in final:
            final[b] = a
            used.add(a)
    number = 0
    for c in sorted(set(new.values()) - set(final), key=lambda c: (-sum(v == c for v in new.values()), min(k for k, v in new.items() if v == c))):
        while number in used:
            number += 1
        final[c] = number
        used.add(number)
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, community int")
    assert {r.community: r.final for r in identity.matched_communities(frame(new), frame(old)).collect()} == final
    assert identity.matched_communities(frame(new).where("false"), frame(old)).count() == 0
    assert {r.final for r in identity.matched_communities(frame(new), frame(old).where("false")).collect()} == set(range(len(set(new.values()))))


def test_row_rules(spark):
    df = spark.createDataFrame([("  .run() ", "code", "http://10.0.0.1/x", "useCache"), ("a.py", "code", "https://user@ok.example:80/", "Graph"), (None, None, None, None), ("()", "code", "ftp://x", "load()")], "label string, kind string, url string, raw string")
    rows = df.selectExpr("*").select(rules.callable_name(df.label), rules.is_resolvable(df.kind, df.label), rules.is_public_url(df.url), rules.node_kind(df.label, df.raw, df.label, df.kind)).collect()
    assert [tuple(r) for r in rows] == [("run", True, False, "ui"), ("a.py", False, True, "klass"), (None, False, False, "function"), ("", False, False, "function")]


def test_nothing_is_merged_across_repositories(spark):
    rows = [("a", "Incremental snapshot writer", "r"), ("b", "Incremental snapshot writter", "r"), ("c", "Incremental snapshot writer", "s"), ("d", "Release 2024 notes", "r"), ("e", "Release 2025 notes", "r"), ("f", "Incremental snapshot writer", None)]
    got = {r.id: (r.entity, r.links) for r in dedup.entities(spark.createDataFrame([(i, x, "document", p) for i, x, p in rows], "id string, label string, file_type string, repo string")).collect()}
    assert got["a"] == got["b"] and got["a"][1] == 1 and len({got[x][0] for x in "acf"}) == 3 and got["d"][0] != got["e"][0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_of_similar_labels(spark):
    """Every row whose number is divisible by 100, against all rows of its repository."""
    rows = spark.read.parquet("/root/testdata/sf0.1/nodes.parquet").where("label is not null and repo is not null and coalesce(file_type, '') <> 'code'").select("seq", "repo", "label").collect()
    keys = {(r.repo, label_key_text(r.label)) for r in rows}
    asked = {(r.repo, label_key_text(r.label)) for r in rows if r.seq % 100 == 0}
    digits = lambda x: sorted("".join(c if c.isdigit() else " " for c in x).split())
    near = []
    for repo, a in asked:
        for other, b in keys:
            if repo == other and a != b and a and b and min(len(a), len(b)) >= 0.6 * max(len(a), len(b)) and digits(a) == digits(b) and dedup.jaro_winkler(a, b) >= dedup.THRESHOLD:
                near.append((repo, min(a, b), max(a, b)))
    pairs = spark.createDataFrame(near, "repo string, a string, b string").distinct()
    short = "least(length(a), length(b)) < 12"
    like = {(r.repo, r.a, r.b) for r in pairs.where(dedup.allowed(pairs.a, pairs.b)).where(dedup.entropy(pairs.a) >= dedup.MIN_ENTROPY).where(dedup.entropy(pairs.b) >= dedup.MIN_ENTROPY).where(f"not {short}").collect()}
    found = {(r.repo, r.a, r.b) for r in dedup.linked_keys(spark.createDataFrame(sorted(keys), "repo string, key string")).collect()}
    assert len(like) > 20 and len(like & found) >= 0.9 * len(like), (len(like), len(like & found))


def test_every_query_of_the_build_is_registered():
    names = core_queries.queries()
    assert {"j02_resolved_endpoints", "j03_ghosts", "j06_remapped_edges", "j16_namesakes", "u06_matched_communities", "j26_citations", "k13_report"} <= set(names)
