"""Entity resolution and communities."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import communities, dedup


def _nodes(spark, labels):
    return spark.createDataFrame([(f"n{i:03}", label, kind) for i, (label, kind) in enumerate(labels)], "id string, label string, file_type string")


def test_jaro_winkler_against_duckdb():
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 15))) for _ in range(60)]
    base = duckdb.connect()
    for a, b in zip(words, words[1:]):
        want, plain = base.execute("SELECT jaro_winkler_similarity(?, ?), jaro_similarity(?, ?)", [a, b, a, b]).fetchone()
        assert dedup.jaro(a, b) == pytest.approx(plain, abs=1e-9)
        assert dedup.jaro_winkler(a, b) == pytest.approx(want, abs=1e-9)


def test_entities(spark):
    labels = ["Graph Extractor", "graph_extractor", "Graph-Extractor!", "Incremental snapshot writer", "Incremental snapshot writter", "UserService", "OrderService", "AI", "ML", "Release 2024 notes", "Release 2025 notes", None, "", "Cache of tokens", "Cache of tokens and more"]
    nodes = _nodes(spark, [(x, "document") for x in labels] + [("Graph Extractor", "code")])
    got = {r.id: (r.entity, r.links) for r in dedup.entities(nodes).collect()}
    assert len(got) == len(labels)
    same = lambda *ids: len({got[f"n{i:03}"][0] for i in ids}) == 1
    assert same(0, 1, 2) and same(3, 4) and got["n003"][1] == 1
    assert not same(5, 6) and not same(7, 8) and not same(9, 10) and not same(11, 12) and not same(13, 14)
    assert dedup.entities(nodes.where("false")).count() == 0


def test_communities(spark):
    rng = random.Random(6)
    rows = []
    for block in range(4):
        members = [f"b{block}_{i:02}" for i in range(12)]
        rows += [(a, b) for i, a in enumerate(members) for b in members[i + 1 :] if rng.random() < 0.7]
    rows += [("b0_00", "b1_00"), ("b1_01", "b2_00"), ("b2_03", "b3_00"), ("b0_00", "b0_00")]
    edges = spark.createDataFrame(rows, "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in sorted({v for r in rows for v in r}) + ["alone"]], "id string")
    found = communities.detect(nodes, edges).cache()
    got = {r.id: r.community for r in found.collect()}
    assert len(got) == nodes.count() and got["alone"] == "alone"
    assert communities.modularity(edges, found) > 0.6
    again = {r.id: r.community for r in communities.detect(nodes.orderBy("id", ascending=False), edges.orderBy("target")).collect()}
    assert again == got


def _blocks(blocks, size, seed):
    """Links of nodes in blocks, one in eight of them between blocks."""
    rng = random.Random(seed)
    name = lambda block: f"é{block}/{rng.randrange(size):03}"
    return sorted({tuple(sorted((name(b), name(rng.randrange(blocks) if rng.random() < 0.125 else b)))) for b in range(blocks) for _ in range(3 * size)})


def _modularity(links, of):
    degree, inside = Counter(), 0
    for a, b in links:
        inside += 2 * (of[a] == of[b])
        degree[of[a]] += 1
        degree[of[b]] += 1
    return inside / (2 * len(links)) - sum((k / (2 * len(links))) ** 2 for k in degree.values())


def test_communities_take_few_jobs_and_no_node_would_move(spark, monkeypatch):
    links = [x for x in _blocks(6, 60, 7) if x[0] != x[1]]
    ids = sorted({v for x in links for v in x})
    nodes, edges = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(links, "source string, target string")
    kept, stored = [], communities.stored
    monkeypatch.setattr(communities, "stored", lambda df: kept.append(1) or stored(df))
    of = {r.id: r.community for r in communities.detect(nodes, edges).collect()}
    assert len(kept) < 10 and set(of) == set(ids)
    assert all(of[c] == c == min(v for v in ids if of[v] == c) for c in set(of.values()))
    best = _modularity(links, of)
    assert best > 0.68 and communities.modularity(edges, nodes.join(spark.createDataFrame(list(of.items()), "id string, community string"), "id")) == pytest.approx(best)
    for a, b in links + [x[::-1] for x in links]:
        assert of[a] == of[b] or _modularity(links, of | {a: of[b]}) < best + communities.LEAST_RISE
    again = communities.detect(nodes, edges.select(F.col("target").alias("source"), F.col("source").alias("target")).orderBy(F.desc("target")))
    assert {r.id: r.community for r in again.collect()} == of


def test_communities_too_large_for_a_task(spark):
    """The first level, or all of them, by joins."""
    links = [x for x in _blocks(4, 20, 8) if x[0] != x[1]]
    nodes, edges = spark.createDataFrame([(x,) for x in sorted({v for x in links for v in x})], "id string"), spark.createDataFrame(links, "source string, target string")
    for whole in (0, len(links) - 1):
        of = {r.id: r.community for r in communities.detect(nodes, edges, whole=whole).collect()}
        assert len(of) == nodes.count() and _modularity(links, of) > 0.5


@pytest.mark.parametrize("seed", range(20))
def test_levels_of_weighted_links(monkeypatch, seed):
    """The rise that is told is the rise of modularity, loops and weights beyond 2^31 included."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 30))
    found = sorted({(min(x, y), max(x, y)) for x, y in rng.integers(0, n, (60, 2)).tolist()})
    a, b = (np.searchsorted(sorted({v for x in found for v in x}), side).astype(np.int32) for side in zip(*found))
    n, w = int(max(a.max(), b.max())) + 1, rng.integers(1, 4, len(a)) * (1 << 31 if seed == 0 else 1)
    monkeypatch.setattr(communities, "PART", int(rng.integers(1, 20)))
    degree = np.bincount(a, w, n) + np.bincount(b[a != b], w[a != b], n)
    inside = lambda m: (np.where(a == b, 1, 2) * w)[m[a] == m[b]].sum()
    quality = lambda m: inside(m) / degree.sum() - ((np.bincount(m, degree, n) / degree.sum()) ** 2).sum()
    level = communities._Level(a, b, w, n)
    state, rise = level.settle(np.arange(n))
    assert quality(state) - quality(np.arange(n)) == pytest.approx(rise)
    smallest, place = np.unique(state, return_inverse=True)
    above = level.above(place, len(smallest))
    assert above.degree.sum() == degree.sum() and above.loops.sum() == inside(state)
    order, turned = rng.permutation(len(a)), rng.random(len(a)) < 0.5
    x, y = np.where(turned, b, a)[order], np.where(turned, a, b)[order]
    assert (communities.levels(a, b, w) == communities.levels(x, y, w[order])).all()
