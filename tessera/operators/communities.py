"""Community detection by modularity on the whole edge table, in levels.

In a level, nodes move to the neighbouring community with the greatest modularity gain, ties to the
smallest name; then its communities become the nodes of the next level, until none merge. Nodes
without an edge are communities of their own. The result does not depend on the order of rows.

A level of at most WHOLE links is settled in one task, with all levels above it: one node moves at a
time, in the order of names, until a full cycle of turns moves none. Links are numbers there, of
about 80 bytes each, and gains are whole numbers, so that each move raises modularity.

A larger level is settled by joins: the nodes of one colour class after the other (by a hash of the
id and the cycle of turns) move at once. It ends when a full cycle of turns moves no node, or raises
modularity by less than LEAST_RISE. Sums per community and per (node, community) are partial
aggregates, so that a hub's edges never meet in one task.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import both_ways, pairs
from tessera.session import stored

#: Nodes of one class that move at once can undo each other's gain for ever, so a level also ends by this.
LEAST_RISE = 1e-4
#: The most links, each counted once, that one task settles.
WHOLE = 12_000_000
#: Of them, so many are looked at together.
PART = 1 << 20


def detect(nodes: DataFrame, edges: DataFrame, colours: int = 2, whole: int = WHOLE) -> DataFrame:
    """(id, community): community is named by a node in it."""
    links = stored(both_ways(pairs(edges)).withColumn("w", F.lit(1.0)))
    members = None
    while True:
        last = links.count() <= 2 * whole
        state = settled_whole(links) if last else settle(links, colours)
        if state.where("id <> community").isEmpty():  # no two nodes of this level belong together
            break
        members = state if members is None else stored(members.withColumnRenamed("community", "at").join(state.withColumnRenamed("id", "at"), "at").select("id", "community"))
        if last:
            break
        ends = links.join(state, "id").select("other", "w", F.col("community").alias("a")).join(state.select(F.col("id").alias("other"), F.col("community").alias("b")), "other")
        links = stored(ends.groupBy(F.col("a").alias("id"), F.col("b").alias("other")).agg(F.sum("w").alias("w")))
    if members is None:
        return nodes.select("id", F.col("id").alias("community"))
    return nodes.select("id").join(members, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def settled_whole(links: DataFrame) -> DataFrame:
    """(id, community) of a level and all above it, in one task, over links as those of settle."""
    names = stored(links.select("id").distinct().orderBy("id").withColumn("n", F.monotonically_increasing_id()))  # numbers in the order of names
    numbered = links.where("id <= other").join(names, "id").select(F.col("n").alias("a"), "other", "w").join(names.select(F.col("id").alias("other"), F.col("n").alias("b")), "other").select("a", "b", F.col("w").cast("long").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[b[name].to_numpy() for name in ("a", "b", "w")] for b in batches]
        if not rows:
            return
        found, ends = _numbers(rows)
        community = levels(*ends)
        for start in range(0, len(found), 1 << 16):
            part = slice(start, start + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(found[part]), pa.array(found[community[part]])], names=["a", "b"])

    state = stored(stored(numbered).coalesce(1).mapInArrow(run, "a long, b long"))
    of = lambda end, name: names.select(F.col("n").alias(end), F.col("id").alias(name))
    return stored(state.join(of("a", "id"), "a").join(of("b", "community"), "b").select("id", "community"))


def _numbers(rows: list[list[np.ndarray]]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The numbers of nodes, and the links with their places among them. Numbers are consecutive within
    each of Spark's partitions, the upper bits, and every one has a link."""
    sizes: dict[int, int] = {}
    for ends in rows:
        for x in ends[:2]:
            for part in np.unique(x >> 33):
                sizes[part] = max(sizes.get(part, 0), int((x[x >> 33 == part] & 0x1FFFFFFFF).max()) + 1)
    parts = sorted(sizes)
    count = np.array([sizes[p] for p in parts])
    first = np.zeros(int(parts[-1]) + 1, np.int64)
    first[parts] = np.cumsum(count) - count
    found = np.concatenate([(p << 33) + np.arange(sizes[p], dtype=np.int64) for p in parts])
    place = lambda x: (first[x >> 33] + (x & 0x1FFFFFFFF)).astype(np.int32)
    a, b = (np.concatenate([place(r[end]) for r in rows]) for end in (0, 1))
    weights = np.concatenate([r[2] for r in rows])
    rows.clear()
    return found, (a, b, weights)


def levels(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per node, the smallest of its community, over links that are given once each; every node has a link.
    Once no communities merge, single nodes have their turns again, and the levels above, while that
    raises modularity by LEAST_RISE."""
    n = int(max(a.max(), b.max())) + 1
    nodes = _Level(a, b, w, n)
    members, rise = nodes.settle(np.arange(n))
    while True:
        smallest, members = np.unique(members, return_inverse=True)
        level = nodes.above(members, len(smallest))
        while True:
            community, _ = level.settle(np.arange(level.n))
            smallest, place = np.unique(community, return_inverse=True)
            members = place[members]
            if len(smallest) == level.n:
                break
            level = level.above(place, len(smallest))
        members, rise = nodes.settle(members)
        if rise < LEAST_RISE:
            break
    least = np.full(n, n)
    np.minimum.at(least, members, np.arange(n))
    return least[members]


class _Level:
    """The links of a level, by the node that they leave: arrays that loops read as fast as lists, and
    numpy's views of them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int):
        within = a == b
        self.n, self.loops = n, np.bincount(a[within], w[within], n).astype(np.int64)
        a, b, w = (x[~within] for x in (a, b, w))
        wide, degree = len(w) and int(w.max()) >= 1 << 31, np.bincount(a, w, n) + np.bincount(b, w, n)
        order = np.argsort(np.r_[a, b] * np.int64(n) + np.r_[b, a], kind="stable")  # whatever the order of rows
        self.starts, starts = _held("q", np.r_[0, np.cumsum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n))])
        self.others, others = _held("i", np.r_[b, a][order])
        self.weights, weights = _held("q" if wide else "i", np.r_[w, w][order])
        self.degree, degree = _held("q", degree.astype(np.int64) + self.loops)
        self.held = others, weights, starts, degree

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
        """The links of some nodes after the other: (node, other, weight, the first of the nodes, the next one's first)."""
        first = 0
        while first < self.n:
            end = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + PART, "right")) - 1)
            links = slice(self.starts[first], self.starts[end])
            yield np.repeat(np.arange(first, end), np.diff(self.starts[first : end + 1])), self.others[links], self.weights[links].astype(np.int64), first, end
            first = end

    def above(self, place: np.ndarray, n: int) -> _Level:
        """The next level, place being the community of each node."""
        found = [_sums(place * (n + 1), self.loops)]
        for node, other, w, _, _ in self.parts():
            once = node < other
            x, y, w = place[node[once]], place[other[once]], w[once]
            found.append(_sums(np.minimum(x, y) * n + np.maximum(x, y), np.where(x == y, 2 * w, w)))  # a link within counts from both ends
        key, w = _sums(*(np.concatenate(x) for x in zip(*found)))
        return _Level((key // n).astype(np.int32), (key % n).astype(np.int32), w, n)

    def wishes(self, community: np.ndarray, mass: np.ndarray, total: int) -> np.ndarray:
        """The nodes that would gain by a move."""
        found, kind = [], np.int64 if total < 1 << 31 else np.float64  # a turn's gains are exact in any case
        for node, other, w, first, end in self.parts():
            key, into = _sums(node * self.n + community[other], w)
            node, to = key // self.n, key % self.n
            own, k = to == community[node], self.degree[node]
            gain = into.astype(kind) * total - k.astype(kind) * (mass[to] - np.where(own, k, 0))
            best, stay = np.zeros(end - first, kind), np.zeros(end - first, kind)
            stay[node[own] - first] = gain[own]
            node, gain = node[~own], gain[~own]
            if len(node):
                at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                best[node[at] - first] = np.maximum.reduceat(gain, at)
            found.append(first + np.flatnonzero(best > np.maximum(stay, 0)))
        return np.concatenate(found)

    def settle(self, start: np.ndarray) -> tuple[np.ndarray, float]:
        """The community of each node after moves of single nodes, and the rise of modularity. In a cycle, all
        nodes that would gain by a move have their turns, and those whose neighbour has left them."""
        total, rises = int(self.degree.sum()), 0.0
        all_communities, community = _held("i", start)
        all_masses, mass = _held("q", np.bincount(start, self.degree, self.n))
        others, weights, starts, degree = self.held
        while True:
            turns = self.wishes(all_communities, all_masses, total)
            rise, queue, waiting = 0, deque(turns.tolist()), bytearray(self.n)
            np.frombuffer(waiting, np.uint8)[turns] = 1
            while queue:
                node = queue.popleft()
                waiting[node] = 0
                now, k, first, end = community[node], degree[node], starts[node], starts[node + 1]
                near, into = others[first:end], {}
                for other, weight in zip(near, weights[first:end]):
                    c = community[other]
                    into[c] = into.get(c, 0) + weight
                stay = into.pop(now, 0) * total - k * (mass[now] - k)
                to, most = now, max(0, stay)
                for c, weight in into.items():
                    gain = weight * total - k * mass[c]
                    if gain > most or (gain == most and c < to != now):
                        to, most = c, gain
                if to != now:
                    rise += most - stay
                    community[node] = to
                    mass[now] -= k
                    mass[to] += k
                    for other in near:
                        if not waiting[other] and community[other] != to:
                            waiting[other] = 1
                            queue.append(other)
            rise = 2 * rise / total**2
            rises += rise
            if rise < LEAST_RISE:
                break
        return all_communities.astype(np.int64), rises


def _held(kind: str, values: np.ndarray) -> tuple[np.ndarray, array]:
    """A numpy array and an array that share their memory."""
    held = array(kind)
    held.frombytes(np.ascontiguousarray(values, kind).data.cast("B") if len(values) else b"")
    return np.frombuffer(held, kind) if len(held) else np.zeros(0, kind), held


def _sums(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of w by key, in order of key."""
    if not len(key):
        return key, w
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], np.add.reduceat(w[order], at)


def settle(links: DataFrame, colours: int, least: float = LEAST_RISE) -> DataFrame:
    """(id, community) of one level, by moves of single nodes over links (id, other, w) in both
    directions, a community's own links being a link to itself."""
    degrees = links.groupBy("id").agg(F.sum("w").alias("k"))
    state = stored(degrees.select("id", "k", F.col("id").alias("community")))
    total = state.agg(F.sum("k").alias("m")).first().m or 1.0
    best, kept, n = _quality(links, state, total), state, 0
    while True:
        moves = 0
        for colour in range(colours):  # in a cycle, each node has one turn
            state = stored(_moved(links, state, total, F.pmod(F.xxhash64("id", F.lit(n)), F.lit(colours)) == colour))
            moves += state.where("moved").count()
            state = state.drop("moved")
        n += 1
        if not moves:
            break
        now = _quality(links, state, total)
        if now > best:
            rise, best, kept = now - best, now, state
        if now < best or rise < least:
            break
    names = kept.groupBy("community").agg(F.min("id").alias("name"))
    return stored(kept.join(names, "community").select("id", F.col("name").alias("community")))


def _moved(links: DataFrame, state: DataFrame, total: float, turn: Column) -> DataFrame:
    mass = state.groupBy("community").agg(F.sum("k").alias("mass"))
    near = links.where("id <> other").join(state.select(F.col("id").alias("other"), "community"), "other").groupBy("id", "community").agg(F.sum("w").alias("into"))
    options = near.join(mass, "community").join(state.where(turn).select("id", "k", F.col("community").alias("now")), "id")
    gain = F.col("into") - F.col("k") * (F.col("mass") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)) / total
    best = options.withColumn("gain", F.round(gain, 9)).groupBy("id").agg(F.min_by(F.struct("community", "gain"), F.struct(-F.col("gain"), F.col("community"))).alias("to"), F.max(F.when(F.col("community") == F.col("now"), F.col("gain"))).alias("stay"))
    better = F.coalesce((F.col("to.gain") > F.coalesce("stay", F.lit(0.0))) & (F.col("to.gain") > 0), F.lit(False))
    return state.join(best, "id", "left").select("id", "k", F.when(better, F.col("to.community")).otherwise(F.col("community")).alias("community"), better.alias("moved"))


def _quality(links: DataFrame, state: DataFrame, total: float) -> float:
    """Modularity of a level's state."""
    of = state.select("id", "community")
    inside = links.join(of, "id").join(of.toDF("other", "c2"), "other").where("community = c2").agg(F.sum("w")).first()[0] or 0.0
    return inside / total - (state.groupBy("community").agg(F.sum("k").alias("mass")).agg(F.sum(F.pow(F.col("mass") / total, F.lit(2)))).first()[0] or 0.0)


def modularity(edges: DataFrame, members: DataFrame) -> float:
    links = both_ways(pairs(edges))
    total = links.count() or 1
    inside = links.join(members, "id").join(members.select(F.col("id").alias("other"), F.col("community").alias("c2")), "other").where("community = c2").count()
    mass = links.groupBy("id").agg(F.count("*").alias("k")).join(members, "id").groupBy("community").agg(F.sum("k").alias("mass"))
    return inside / total - (mass.agg(F.sum(F.pow(F.col("mass") / total, F.lit(2)))).first()[0] or 0.0)
