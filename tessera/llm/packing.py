"""Problem 2: filling chunks of fixed capacity with files, as few chunks as possible.

Shortest-pack-first over the histogram of lengths: lengths are placed longest first, each into
the pack with the most room left, and only counts of equal packs are kept. The plan depends on
the histogram alone, which has at most `capacity` bars however many files there are, so it is
made on the driver. Two orders of choice are planned (most room first, least room first) and
the one with fewer packs is taken. Files then find their places by their rank among the files
of their length.

A file longer than the capacity is cut into full chunks and a rest, and only such a file; the
rest is packed like a file. An empty content takes no room and goes to chunk 0. A null content
has no place. Repeated scans count once (the present state). Extra columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.present import latest, named, with_version
from tessera.llm.ranks import ranked
from tessera.session import cut

CAPACITY = 20_000


def _plan(histogram: dict[int, int], capacity: int, most_room: bool) -> tuple[int, list[tuple[int, int, list[tuple[int, int]]]]]:
    """Number of packs, and patterns: (first pack, packs, [(length, times)])."""
    packs: dict[int, list[list]] = defaultdict(list)  # room left -> [count, items]
    rooms: list[int] = []  # ascending for least room first, a heap of negatives otherwise
    done: list[list] = []

    def keep(count: int, room: int, items: list[tuple[int, int]]) -> None:
        if not room:
            done.append([count, items])
            return
        if room not in packs or not packs[room]:
            heapq.heappush(rooms, -room) if most_room else bisect.insort(rooms, room)
        packs[room].append([count, items])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if most_room:
                room = -rooms[0] if rooms and -rooms[0] >= length else None
            else:
                at = bisect.bisect_left(rooms, length)
                room = rooms[at] if at < len(rooms) else None
            if room is None:  # as many new packs as it takes, each filled with this length
                each = min(capacity // length, left)
                full = left // each
                keep(full, capacity - each * length, [(length, each)])
                left -= full * each
                continue
            count, items = packs[room].pop()
            if not packs[room]:
                heapq.heappop(rooms) if most_room else rooms.pop(at)
            used = min(count, left)
            if count > used:
                keep(count - used, room, items)
            last, times = items[-1]
            keep(used, room - length, [*items[:-1], (last, times + 1)] if last == length else [*items, (length, 1)])
            left -= used
    for same in packs.values():
        done += same
    first, out = 0, []
    for count, items in done:
        out.append((first, count, items))
        first += count
    return first, out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[int, list, str]:
    """The plan with fewer packs of the two, and the name of its order; most room first on ties."""
    plans = ((*_plan(histogram, capacity, most_room), name) for most_room, name in ((True, "most room first"), (False, "least room first")))
    return min(plans, key=lambda p: p[0])


def _slots(patterns: list) -> dict[int, np.ndarray]:
    """Per length: first rank, first pack, packs and place in the pack of each run of slots."""
    runs, taken = defaultdict(list), defaultdict(int)
    for first, count, items in patterns:
        place = 0
        for length, times in items:
            runs[length].append((taken[length], first, count, place))
            taken[length] += count * times
            place += times
    return {length: np.array(r, dtype=np.int64) for length, r in runs.items()}


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(source_file, start, end, chunk, place) of items (source_file, n)."""
    sized = cut(items.where("n is not null"))  # two narrow columns, so that contents are read once
    whole = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int")))
    parts = sized.select("source_file", "n", whole.alias("part")).select("source_file", (F.col("part") * capacity).cast("long").alias("start"), F.least(F.col("n").cast("long"), ((F.col("part") + 1) * capacity).cast("long")).alias("end"))
    parts = parts.withColumn("size", (F.col("end") - F.col("start")).cast("int"))
    histogram = {r.size: r.n for r in parts.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    _, patterns, _ = plan(histogram, capacity)
    slots = items.sparkSession.sparkContext.broadcast(_slots(patterns))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b["size"].to_numpy(), b["rank"].to_numpy()
            chunk, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int32)
            order = np.argsort(size, kind="stable")
            edges = np.flatnonzero(np.diff(size[order])) + 1
            for rows in np.split(order, edges):
                if not len(rows) or not size[rows[0]]:
                    continue
                runs = slots.value[int(size[rows[0]])]
                run = runs[np.searchsorted(runs[:, 0], rank[rows], side="right") - 1]
                step = rank[rows] - run[:, 0]
                chunk[rows], at[rows] = run[:, 1] + step % run[:, 2], run[:, 3] + step // run[:, 2]
            yield pa.RecordBatch.from_arrays([b["source_file"], b["start"], b["end"], pa.array(chunk), pa.array(at)], names=["source_file", "start", "end", "chunk", "place"])

    numbered = ranked(parts.withColumn("item", F.concat_ws("\x00", "source_file", "start")), "size", "item").select("source_file", "start", "end", "size", F.col("rank").cast("long").alias("rank"))
    return numbered.mapInArrow(place, "source_file string, start long, end long, chunk long, place int")


def sizes(sources: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(source_file, n): length of the present content of all files or, with `nodes`, of those that some node names."""
    now = latest(with_version(sources, F.length("content").alias("n")), "n")
    return now if nodes is None else named(now, nodes)


def pack_sources(sources: DataFrame, capacity: int = CAPACITY, nodes: DataFrame | None = None) -> DataFrame:
    return pack(sizes(sources, nodes), capacity)
