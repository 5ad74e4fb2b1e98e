"""Problems 3 and 5 on small fixtures, against brute force."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.functions.ids import normalize_id_text
from tessera.operators import orphans as o
from tessera.operators import skew

EDGES = "edge_id long, source string, target string, relation string, captured_at timestamp_ntz, side string, node_id string, salt int"
NODES = "id string, captured_at timestamp_ntz, at string, word int"
SHARED = "id string, kind string"
REMOVED = "id string, removed_at timestamp_ntz, reason string"
DAY = datetime(2025, 1, 1)


def edge(i, s, t, day=10, rel="calls"):
    return (i, s, t, rel, DAY + timedelta(days=day), "x", "y", 7)


@given(st.text())
def test_normal_form_is_stable(text):
    once = normalize_id_text(text)
    assert "__" not in once and once == once.strip("_")


def test_heavy_keys(spark):
    rng = random.Random(1)
    rows = [edge(i, f"n{rng.randrange(400)}", "Hub::Node" if i % 3 else f"m{i}") for i in range(600)]
    rows += [edge(600, None, "hub-node"), edge(601, "  ", "HUB_NODE"), edge(5, rows[5][1], rows[5][2])] + [edge(1000 + i, "Ｆｕｌｌ", None, rel=None) for i in range(50)]
    got = {tuple(r) for r in skew.heavy_keys(spark.createDataFrame(rows, EDGES), 0.05).collect()}
    assert got == {("target", "hub_node"), ("source", "full")}
    assert skew.heavy_keys(spark.createDataFrame([], EDGES)).count() == 0


def test_degrees(spark):
    rows = [edge(1, "A b", "c"), edge(1, "A b", "c"), edge(2, "a_B", "c", rel=None), edge(3, None, "!!"), edge(4, "c", "C")]
    got = {tuple(r) for r in skew.degrees(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == {("a_b", "calls", 1, 0), ("a_b", None, 1, 0), ("c", "calls", 1, 2), ("c", None, 0, 1)}
    assert skew.degrees(spark.createDataFrame([], EDGES)).count() == 0


def _brute(edges, nodes, shared, removed):
    events = defaultdict(list)
    for i, at, *_ in nodes:
        if i:
            events[normalize_id_text(i)].append((at or datetime.min, 1))
    for i, _ in shared:
        events[normalize_id_text(i)].append((datetime.min, 1))
    for i, at, _ in removed:
        if i and at:
            events[normalize_id_text(i)].append((at, 0))
    out = set()
    for e in edges:
        for side, value in (("source", e[1]), ("target", e[2])):
            key = normalize_id_text(value or "")
            if key:
                past = [x for x in events[key] if x[0] <= (e[4] or datetime.max)]
                if past and max(past)[1] == 0:
                    out.add((e[0], side, "deleted"))
                elif not past:
                    out.add((e[0], side, "late" if any(k for _, k in events[key]) else "missing"))
    return out


def test_orphans(spark):
    rng = random.Random(2)
    name = lambda: rng.choice(["k{}", "K-{}", "k::{}"]).format(rng.randrange(60))
    day = lambda: DAY + timedelta(days=rng.randrange(30))
    nodes = [(name(), day() if rng.random() < 0.9 else None, "q", 1) for _ in range(40)] + [(None, day(), None, None)]
    removed = [(name(), day() + timedelta(hours=1), None) for _ in range(40)] + [(None, day(), None), ("k1", None, None)]
    shared = [("k:3", "x")]
    edges = [(i, name() if rng.random() < 0.5 else "hub", name(), "r", day(), "a", "b", 1) for i in range(500)] + [(900, None, " ", "r", day(), "a", "b", 1), (901, "gone", "k3", "r", None, "a", "b", 1)]
    edges += edges[:20]
    frames = [spark.createDataFrame(x, s) for x, s in ((edges, EDGES), (nodes, NODES), (shared, SHARED), (removed, REMOVED))]
    got = o.orphans(*frames).cache()
    rows = [tuple(r)[:3] for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == _brute(edges, nodes, shared, removed)
    report = {(r.side, r.status): r.n for r in o.orphan_report(got).groupBy("side", "status").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert report == Counter((side, status) for _, side, status in rows)


def test_orphans_of_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (EDGES, NODES, SHARED, REMOVED)]
    assert o.orphans(*empty).count() == 0
    some = spark.createDataFrame([edge(1, "a", "b")], EDGES)
    assert {r.status for r in o.orphans(some, *empty[1:]).collect()} == {"missing"}


@pytest.mark.parametrize("most", [2, 1 << 20])
def test_filters_within_and_beyond_what_is_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(o, "MIN_WORDS", 2)
    monkeypatch.setattr(o, "MAX_WORDS", most)
    nodes = spark.createDataFrame([(f"n{i}", None, None, None) for i in range(300)] + [("hub", None, None, None)], NODES)
    edges = spark.createDataFrame([edge(i, f"n{i}" if i % 3 else "hub", f"z{i}" if i % 2 else "gone hub") for i in range(300)], EDGES)
    got = o.orphans(edges, nodes, spark.createDataFrame([], SHARED), spark.createDataFrame([], REMOVED)).collect()
    assert len(got) == 300 and {(r.side, r.status) for r in got} == {("target", "missing")}


def test_few_orphans_pass_the_filter_at_any_size(spark):
    for parents in (50, 3_000, 40_000):
        words = o.words_for(parents)
        keys = spark.range(parents).selectExpr("concat('k', id) as node_id")
        bloom = o.bloom_filter(keys, "node_id", words)
        probes = spark.range(20_000).selectExpr("concat('z', id) as node_id").unionByName(keys)
        tested = probes.select("node_id", *o._word_and_mask("node_id", words)).join(bloom, "word", "left").selectExpr("substr(node_id, 1, 1) as kind", "coalesce(bits & mask = mask, false) as maybe")
        passed = {r.kind: r.share for r in tested.groupBy("kind").agg({"maybe": "count"}).join(tested.where("maybe").groupBy("kind").count(), "kind", "left").selectExpr("kind", "coalesce(count, 0) / `count(maybe)` as share").collect()}
        assert passed["k"] == 1.0 and passed["z"] < 0.02


def test_often_captured_and_removed(spark):
    hours = lambda n: DAY + timedelta(hours=n)
    nodes = [("k", hours(20 * i), None, 1) for i in range(300)] * 2
    removed = [("K", hours(20 * i + k), None) for i in range(300) for k in (5, 9)] + [("only", hours(50), None)] * 2 + [("k", hours(40), None)]
    edges = [(i, "k", "only", "r", hours(3 * i - 10), "a", "b", 1) for i in range(2100)]
    frames = [spark.createDataFrame(x, s) for x, s in ((edges, EDGES), (nodes, NODES), ([], SHARED), (removed, REMOVED))]
    assert {tuple(r)[:3] for r in o.orphans(*frames).collect()} == _brute(edges, nodes, [], removed)


def test_degrees_where_hashes_collide(spark, monkeypatch):
    weak = skew.F.xxhash64
    monkeypatch.setattr(skew.F, "xxhash64", lambda *c: weak(*c) if len(c) > 1 else weak(*c) % 3)
    rows = [edge(i, f"n{i % 7}", f"n{i % 5}", rel="calls" if i % 2 else None) for i in range(70)]
    got = {(r.node_id, r.relation): (r.out_degree, r.in_degree) for r in skew.degrees(spark.createDataFrame(rows, EDGES)).where("relation is null").collect()}
    assert got == {(f"n{k}", None): (sum(i % 7 == k and i % 2 == 0 for i in range(70)), sum(i % 5 == k and i % 2 == 0 for i in range(70))) for k in range(7)}
