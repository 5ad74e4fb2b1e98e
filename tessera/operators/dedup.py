"""Entity resolution: a similarity join of labels, and the classes it leads to.

The join works on distinct label keys of a repository (the class representatives); copies of a key
are members of its class and never expanded into pairs, and nothing is merged across repositories.
Candidates share one of BANDS MinHash bands over character trigrams; a pair is a link if its
Jaro-Winkler similarity reaches THRESHOLD and no guard forbids it. Within a band bucket only keys of
the same repository, the same numbers and compatible length meet (a similarity of 0.92 bounds the
ratio of lengths by 0.6), by an equi-join, so that a bucket is not paired with all of itself.
Bands are of few rows, as labels of 0.92 Jaro-Winkler may share no more than half their trigrams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import label_key
from tessera.operators.rules import entropy
from tessera.operators.search import components
from tessera.session import cut

# Permutations, trigrams, entropy gate and threshold.
PERMUTATIONS, SHINGLE, MIN_ENTROPY, THRESHOLD, SHORT, LEAST_RATIO = 128, 3, 2.5, 0.92, 12, 0.6
#: Bands and rows of each: a pair of trigram similarity 0.4 meets with probability 0.94.
BANDS, ROWS = 42, 3
_PRIME = np.uint64((1 << 61) - 1)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    state = np.random.RandomState(1)
    pairs = [(state.randint(1, int(_PRIME), dtype=np.int64), state.randint(0, int(_PRIME), dtype=np.int64)) for _ in range(PERMUTATIONS)]
    a, b = np.array(pairs, dtype=np.uint64).T
    return a, b


def signature(key: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    text = key.replace(" ", "")
    grams = {text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)} or {text}
    hashes = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams], dtype=np.uint64)
    return ((a[:, None] * hashes[None, :] + b[:, None]) % _PRIME & np.uint64(0xFFFFFFFF)).min(axis=1)


def bands(keys: DataFrame) -> DataFrame:
    """(key, band): BANDS rows per key; `band` holds the band's number and a hash of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        for batch in batches:
            names = batch["key"].to_pylist()
            codes = []
            for name in names:
                s = signature(name, a, b)
                codes += [int.from_bytes(hashlib.blake2b(bytes([i]) + s[i * ROWS : (i + 1) * ROWS].tobytes(), digest_size=8).digest(), "little", signed=True) for i in range(BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n in names for _ in range(BANDS)], pa.string()), pa.array(codes, pa.int64())], names=["key", "band"])

    return keys.select("key").mapInArrow(run, "key string, band long")


def jaro(a: str, b: str) -> float:
    """Jaro similarity: common characters within half the longer length, less half the swaps."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    base = jaro(a, b)
    shared = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return base + shared * 0.1 * (1 - base) if base > 0.7 else base


def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([jaro_winkler(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def linked_keys(keys: DataFrame) -> DataFrame:
    """(repo, a, b) of the distinct (repo, key) that are alike, a < b."""
    from pyspark.sql.types import DoubleType

    _similar.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    similar = F.arrow_udf(_similar, DoubleType())
    gated = keys.where("key <> ''").select(F.coalesce("repo", F.lit("")).alias("repo"), "key").distinct().where(entropy(F.col("key")) >= MIN_ENTROPY)
    numbers = F.array_join(F.array_sort(F.regexp_extract_all("key", F.lit("[0-9]+"), F.lit(0))), " ")
    sized = gated.select("repo", "key", numbers.alias("numbers"), F.floor(F.log(F.length("key")) / float(-np.log(LEAST_RATIO))).cast("int").alias("size"))
    spread = bands(gated.select("key").distinct()).join(sized, "key")
    on = ["repo", "numbers", "band", "size"]
    near = spread.select("repo", "numbers", "band", F.col("key").alias("b"), F.explode(F.array("size", F.col("size") - 1)).alias("size"))
    met = spread.select(*on, F.col("key").alias("a")).join(near, on).where("a <> b").select("repo", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    scored = met.where(allowed(F.col("a"), F.col("b"))).withColumn("like", similar(F.col("a"), F.col("b")))
    short = F.least(F.length("a"), F.length("b")) < SHORT
    return scored.where((F.col("like") >= THRESHOLD) & (~short | (F.col("like") >= 0.97))).select("repo", "a", "b")


def allowed(a: Column, b: Column) -> Column:
    """Whether no guard forbids to link two keys of equal numbers, a < b: one must not extend the other,
    and short ones may differ in one character only."""
    short = F.least(F.length(a), F.length(b)) < SHORT
    return ~b.startswith(a) & (~short | ((F.length(a) == F.length(b)) & (F.levenshtein(a, b) <= 1)))


def entities(nodes: DataFrame) -> DataFrame:
    """(id, entity, links): for each node that is no code, its class (the smallest key in its repository)
    and the number of other keys that its own key is linked to. Nodes without a key are their own class;
    those without a repository form one together."""
    repo = F.coalesce("repo", F.lit("")) if "repo" in nodes.columns else F.lit("")
    keyed = nodes.where("coalesce(file_type, '') <> 'code'").select("id", repo.alias("repo"), F.coalesce(label_key(F.col("label")), F.lit("")).alias("key"))
    pairs = cut(linked_keys(keyed.select("repo", "key")))
    name = lambda c: F.concat_ws("\x00", "repo", c)
    classes = components(pairs.select(name("a").alias("a"), name("b").alias("b")))
    degree = pairs.select("repo", F.explode(F.array("a", "b")).alias("key")).groupBy("repo", "key").agg(F.count("*").alias("links"))
    out = keyed.withColumn("name", name("key")).join(classes.withColumnRenamed("id", "name"), "name", "left").join(degree, ["repo", "key"], "left")
    whole = F.coalesce("component", "name")
    of, key = F.substring_index(whole, "\x00", 1), F.substring_index(whole, "\x00", -1)
    own = F.when(F.col("key") == "", F.col("id")).when(of == "", key).otherwise(F.concat_ws("::", of, key))
    return out.select("id", own.alias("entity"), F.coalesce("links", F.lit(0)).alias("links"))
