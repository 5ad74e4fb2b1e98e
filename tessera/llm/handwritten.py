"""Problem 1: files that a tool made, vendored copies and data saved as code.

Three linear support-vector classifiers look at a file from three sides:

- path: hashed path components, their pairs, the words and suffixes of the file name;
- statement: the lines of the comments that stand at a file's edges (before, between and right
  after its imports, or at its very end), as hashed character n-grams and words. Names of
  packages and tools, versions, file names and quotations are masked, so that it learns how
  an origin is stated and not whose;
- body: hashed character n-grams of the rest, with digits made equal, and of its shape (runs of
  letters and of digits as one sign each). The edge comments are masked here, so that this
  classifier learns how made files look and not what they say of themselves.

No labels are given. First labels are weak, and each comes from what its side's features do not
show or what holds everywhere: path, from folders and suffixes that package managers and tools
are known for, and from package names met in such folders; statement, from the notices that
tools are known to leave, and from lines that name a package which some path vendors (its name
is masked in the features, so the classifier learns the sentences around names, in whatever
language); body, from plain structure (hardly any line breaks, lines that differ in numbers
only, mostly literals) and from folders of tool output. Files that another side labels or finds
are neither examples nor counter-examples of a side. A file is found if any side's margin is
positive.

The fit takes a sample of about TRAINING_FILES code scans, of each at most KEPT features a side
and SAMPLE_LINES lines, and at most MOST_NAMES names; nothing else is bounded. For validation, a fit that holds out a fifth of
the repositories is measured on these (`validation`). Every scan is then classified whole; only
paths, times and margins are shuffled to take each file's present state.

A null content is judged by its path alone, an empty one as well. Files with another suffix than
the seven of code are never found, whatever their letter case. Repeated scans and rows that tie
give one row. Without any scan the result is empty. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.present import latest, named, with_version

#: Scans the classifiers are fitted to, and what is taken of each.
TRAINING_FILES, KEPT, SAMPLE_LINES, LINE_CHARS, EPOCHS = 3_000, 1_024, 64, 400, 8
#: Package names that are used as labels and masked, and the share of their paths that shows them to be such.
MOST_NAMES, INSIDE = 5_000, 0.2
BUCKETS = {"path": 1 << 14, "statement": 1 << 15, "body": 1 << 15}
SUFFIX = r"(?i)\.(py|js|ts|go|java|rs|c)$"
#: Weight of an error on a made file against one on a hand-written file, and the cost of errors.
POSITIVE_WEIGHT, COST = 2.0, 4.0

# Folders and suffixes that tools and package managers are known for.
COPY_FOLDERS = frozenset("node_modules bower_components site-packages third_party vendor vendored extern external deps Pods".split())
TOOL_FOLDERS = frozenset("generated autogen __generated__ generated-sources gen".split())
OUTPUT_FOLDERS = frozenset("build dist out target".split())  # as the repository's first folder
MADE_SUFFIX = re.compile(r"\.min\.js$|\.bundle\.js$|\.chunk\.js$|\.generated\.\w+$|\.gen\.\w+$|\.g\.\w+$|\.pb\.\w+$|_pb2(_grpc)?\.py$|\.tab\.[ch]$|_generated\.\w+$|\.d\.ts$")
VERSIONED = re.compile(r".-v?\d+(\.\d+)+$")
#: Notices of tools, where a line begins with them: published conventions and their translations.
NOTICE = re.compile(
    r"(?i)^\W{0,3}(code generated .*do not edit|@generated\b|<auto-?generated|<generated|auto-?generated (file|on|by|from)|(automatically )?(re)?generated? (by|from|with)\b|do not edit"
    r"|this file (was|is) (auto(matically )?-?generated|machine)|automatisch (erzeugt|generiert|erstellt)|(fichier )?(produit|généré|créé) automatiquement|(archivo )?(generado|creado) automáticamente)"
)
TOOL_CODE = re.compile(r"sourceMappingURL=|\b__esModule\b|__webpack_|^/\*\*\*/ ", re.M)

_COMMENT = re.compile(r'\s*(?:(?://|#(?!include|define|if|pragma|!\[)|--|;)[^\n]*|/\*.*?\*/|""".*?"""|\'\'\'.*?\'\'\')', re.S)
_IMPORT = re.compile(r'\s+|(?:import|from|use|using|package|require|extern crate|mod|#include|#pragma|"use strict")\b[^\n]*(?:\n|\Z)')
_WORDS = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"")
_VERSION = re.compile(r"v?\d+(\.\d+)+")
_FILE = re.compile(r"\b[\w/]+\.\w{1,6}\b")
_LITERALS = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|\d+')


def edges_of(text: str) -> tuple[list[str], str]:
    """The comments at the edges of a text, and the rest of it."""
    at, comments, kept = 0, [], []
    while at < len(text):
        if (m := _COMMENT.match(text, at)) and m.end() > at:
            comments.append(m.group())
        elif (m := _IMPORT.match(text, at)) and m.end() > at:
            kept.append(m.group())
        else:
            break
        at = m.end()
    end = len(text)
    tail = text.rstrip()
    if len(tail) > at:
        start = len(tail)
        if tail.endswith("*/"):
            start = tail.rfind("/*")
        elif tail.endswith(('"""', "'''")):
            start = tail.rfind(tail[-3:], 0, len(tail) - 3)
        else:
            while start > at and tail.startswith(("//", "#", "--", ";"), line := tail.rfind("\n", 0, start - 1) + 1):
                start = line
        if at <= start < len(tail) and (start == 0 or tail[start - 1] == "\n"):
            comments.append(tail[start:])
            end = start
    return comments, "".join(kept) + text[at:end]


def lines_of(comments: list[str]) -> list[str]:
    bare = (line.strip(" \t\r*/#;-\"'!") for c in comments for line in c.split("\n"))
    return [line for line in bare if _WORDS.search(line)]


def _hash_words(words: list[str], salt: int, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace"), salt) % buckets for w in words), np.int64, count=len(words))


def _hash_grams(data: np.ndarray, n: int, salt: int, buckets: int) -> np.ndarray:
    if len(data) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(data) - n + 1, salt, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) ^ data[k : len(data) - n + 1 + k].astype(np.uint32)
    h ^= h >> np.uint32(15)
    return (h % np.uint32(buckets)).astype(np.int64)


_EQUAL = np.arange(256, dtype=np.uint8)
_EQUAL[ord("0") : ord("9") + 1] = ord("0")
_SHAPE = _EQUAL.copy()
for _first, _last in (("a", "z"), ("A", "Z")):
    _SHAPE[ord(_first) : ord(_last) + 1] = ord("a")
_SHAPE[128:] = ord("a")


def _shape(data: np.ndarray) -> np.ndarray:
    s = _SHAPE[data]
    if len(s) < 2:
        return s
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | ~np.isin(s[1:], (ord("a"), ord("0"), ord(" ")))
    return s[keep]


def _weighed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and values: 1 + log of the counts, of length 1."""
    counts = np.bincount(hashes, minlength=buckets)
    at = np.flatnonzero(counts)
    values = 1 + np.log(counts[at])
    return at, values / max(1e-9, math.sqrt(float(values @ values)))


def path_features(path: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [re.sub(r"\d+", "0", p) for p in path.split("/")[1:]] or [path]
    folders, name = parts[:-1], parts[-1].split(".")
    kinds = [re.sub(r"^.*?(-v?0(\.0)+)$", r"\1", f) for f in folders]
    marks = [f"d {f}" for f in folders] + [f"k {k}" for k in kinds] + [f"p {a}/{b}" for a, b in zip(folders, folders[1:])]
    marks += [f"n {w}" for w in _WORDS.findall(name[0].lower())] + ["x " + ".".join(name[1:]), "y " + ".".join(name[1:-1])]
    marks += [f"l {len(folders)} {folders[-1]}"] if folders else []
    return _weighed(_hash_words(marks, 17, BUCKETS["path"]), BUCKETS["path"])


def names_pattern(names: list[str]) -> re.Pattern | None:
    """Finds the names, also where a suffix of up to two letters makes a tool's name of a package's."""
    return re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(map(re.escape, names)) + r")\w{0,2}(?![^\W_])") if names else None


def statement_features(line: str, names: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    text = (names.sub(" name ", line) if names else line).lower()
    text = re.sub(r"\d+", "0", _FILE.sub(" file ", _VERSION.sub(" version ", _QUOTED.sub(" quoted ", text))))
    words, buckets = re.findall(r"\w+", text), BUCKETS["statement"]
    grams = _hash_grams(np.frombuffer(" ".join(words).encode("utf-8", "replace"), np.uint8), 4, 3, buckets)
    marks = words + [f"{a} {b}" for a, b in zip(words, words[1:])] + ["^ " + " ".join(words[:n]) for n in (1, 2, 3)]
    return _weighed(np.concatenate([grams, _hash_words(marks, 5, buckets)]), buckets)


def body_features(body: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(re.sub(r"(?m)^.*sourceMappingURL=.*$", "", body).encode("utf-8", "replace"), np.uint8)
    buckets = BUCKETS["body"]
    return _weighed(np.concatenate([_hash_grams(_EQUAL[data], 4, 7, buckets), _hash_grams(_shape(data), 6, 9, buckets)]), buckets)


def made_by_structure(body: str) -> bool:
    """Whether the text has hardly any line breaks, or lines that differ in numbers only, or is mostly data."""
    data = np.frombuffer(body.encode("utf-8", "replace"), np.uint8)
    lines = [line for line in map(bytes.strip, data.tobytes().split(b"\n")) if line]
    size = sum(map(len, lines))
    if size < 150:
        return False
    if sum(len(line) for line in lines if len(line) > 400) > 0.6 * size:
        return True
    if np.isin(data, (9, 10, 13, 32)).sum() < 0.07 * len(data):  # minified, if wrapped at some width
        return True
    if len(lines) >= 8:
        for same, most, share in ((re.sub(rb"\d+", b"0", data.tobytes()), 6, 0.85), (_shape(data).tobytes(), 3, 0.9)):
            equal = Counter(line for line in map(bytes.strip, same.split(b"\n")) if line)
            if sum(n for _, n in equal.most_common(most)) > share * len(lines):
                return True
    unbroken = sum(len(t) for t in body.split() if len(t) >= 50)
    digits = int(((data >= 48) & (data <= 57)).sum())
    if unbroken > 0.6 * size or digits > 0.3 * size:
        return True
    written = [line for line in map(str.strip, body.split("\n")) if line]
    literal = sum(len(line) for line in written if len(line) > 12 and not any(map(str.isalpha, _LITERALS.sub("", line))))
    return literal > 0.7 * sum(map(len, written))


def is_copy(path: str) -> bool:
    return any(p in COPY_FOLDERS or VERSIONED.search(p) for p in path.split("/")[1:-1])


def marked_path(path: str) -> bool:
    parts = path.split("/")
    return is_copy(path) or any(p in TOOL_FOLDERS for p in parts[1:-1]) or (len(parts) > 2 and parts[1] in OUTPUT_FOLDERS) or bool(MADE_SUFFIX.search(parts[-1]))


def package_names(sources: DataFrame) -> list[str]:
    """Names of folders that stand right inside of folders of copies in at least INSIDE of all paths with
    such a folder; of these, the MOST_NAMES that most scans hold. One partial aggregate over the paths."""
    parts = F.split(F.lower("source_file"), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    bare = lambda x: F.regexp_replace(x, r"-v?\d+(\.\d+)+$", "")
    pairs = F.transform(folders, lambda x, i: F.struct(bare(x).alias("name"), F.coalesce(F.get(folders, i - 1).isin(*(f.lower() for f in COPY_FOLDERS)), F.lit(False)).alias("inside")))
    met = sources.where(F.col("source_file").rlike(SUFFIX)).select(F.explode(F.slice(pairs, 2, 1 << 30)).alias("p")).select("p.*")
    counts = met.groupBy("name").agg(F.count_if("inside").alias("inside"), F.count("*").alias("n")).where(f"length(name) >= 4 and inside >= {INSIDE} * n and inside > 0")
    return sorted(r.name for r in counts.orderBy(F.desc("inside"), "name").limit(MOST_NAMES).collect())  # at most MOST_NAMES


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, seed: int = 1) -> np.ndarray:
    """Weights and bias of a linear support-vector classifier, by dual coordinate descent (squared hinge loss)."""
    w = np.zeros(buckets + 1)
    if not labels.any() or labels.all():
        w[-1] = 1.0 if labels.size and labels.all() else -1.0
        return w
    sign = np.where(labels, 1.0, -1.0)
    cost = np.where(labels, POSITIVE_WEIGHT * COST, COST)
    alpha = np.zeros(len(rows))
    squares = 1.0 + 1.0 + 1 / (2 * cost)  # rows have length 1, and the bias feature is 1
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, values = rows[i]
            gradient = sign[i] * (w[at] @ values + w[-1]) - 1 + alpha[i] / (2 * cost[i])
            if alpha[i] == 0 and gradient >= 0:
                continue
            new = max(0.0, alpha[i] - gradient / squares[i])
            step = (new - alpha[i]) * sign[i]
            alpha[i] = new
            w[at] += step * values
            w[-1] += step
    return w


def margin(w: np.ndarray, row: tuple[np.ndarray, np.ndarray]) -> float:
    return float(w[row[0]] @ row[1] + w[-1])


def statement_margin(w: np.ndarray, lines: list[str], names: re.Pattern | None) -> float:
    """The margin of the line that shows a made file most clearly."""
    return max((margin(w, statement_features(line, names)) for line in lines), default=-1.0)


def learn(sample: list[dict], names: list[str], held: frozenset[str] = frozenset()) -> dict:
    """The model. Adds labels and margins to the sample's rows; those of the repositories `held` take no part in the fit."""
    fitted = [f for f in sample if f["repo"] not in held]
    pattern = names_pattern(names)
    for f in sample:
        in_path = bool(pattern) and any(pattern.fullmatch(VERSIONED.sub(lambda m: m.group()[0], p)) for p in f["file"].split("/")[1:-1])
        lines = [bool(NOTICE.search(x) or (pattern and pattern.search(x))) for x in f["lines"]]
        f["labels"] = {"path": marked_path(f["file"]) or in_path, "statement": any(lines), "body": f["structure"]}
        f["told"] = lines

    examples = {(x, y) for f in fitted for x, y in zip(f["lines"], f["told"]) if y or not any(f["labels"].values())}
    lines = sorted(examples)
    weights = {"statement": train([statement_features(x, pattern) for x, _ in lines], np.array([y for _, y in lines], bool), BUCKETS["statement"])}
    for f in sample:
        f["margins"] = {"statement": statement_margin(weights["statement"], f["lines"], pattern)}

    rest = [f for f in fitted if not any(f["labels"].values()) and f["margins"]["statement"] <= 0]
    tool_path = lambda f: f["labels"]["path"] and not is_copy(f["file"])
    for side, made in (("path", [f for f in fitted if f["labels"]["path"]]), ("body", [f for f in fitted if f["seen"] and (f["structure"] or tool_path(f))])):
        rows = [f[side] for f in made] + [f[side] for f in rest if side == "path" or f["seen"]]
        weights[side] = train(rows, np.arange(len(rows)) < len(made), BUCKETS[side])
        for f in sample:
            f["margins"][side] = margin(weights[side], f[side]) if side == "path" or f["seen"] else -1.0
    return {"weights": {side: w.astype(np.float32) for side, w in weights.items()}, "names": names}


def _kept(row: tuple[np.ndarray, np.ndarray]) -> bytes:
    at, values = row
    if len(at) > KEPT:
        most = np.sort(np.argpartition(values, -KEPT)[-KEPT:])
        at, values = at[most], values[most]
    return at.astype(np.uint16).tobytes() + values.astype(np.float16).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 4
    at, values = np.frombuffer(data, np.uint16, n).astype(np.int64), np.frombuffer(data, np.float16, n, 2 * n).astype(float)
    return at, values / max(1e-9, math.sqrt(float(values @ values)))


def sampled(sources: DataFrame) -> list[dict]:
    """Features of about TRAINING_FILES code scans, chosen by a hash of their number."""
    code = sources.where(F.col("source_file").rlike(SUFFIX))
    part = min(1.0, TRAINING_FILES / max(1, code.count()))
    key = F.xxhash64(F.coalesce("scan_id", F.lit(0)), "source_file")
    chosen = code.where(F.pmod(key, F.lit(1_000_000)) < int(part * 1_000_000)).select("source_file", "content")
    schema = pa.schema([("file", pa.string()), ("seen", pa.bool_()), ("structure", pa.bool_()), ("lines", pa.list_(pa.string())), ("path", pa.binary()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b["source_file"].to_pylist(), b["content"].to_pylist()):
                comments, body = edges_of(content or "")
                lines = [x[:LINE_CHARS] for x in lines_of(comments)[:SAMPLE_LINES]]
                rows.append((path, bool(content), bool(TOOL_CODE.search(body)) or made_by_structure(body), lines, _kept(path_features(path)), _kept(body_features(body))))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    table = chosen.mapInArrow(run, "file string, seen boolean, structure boolean, lines array<string>, path binary, body binary").toArrow()  # about TRAINING_FILES rows of bounded size
    rows = sorted(table.to_pylist(), key=lambda r: (r["file"], r["body"]))
    return [r | {"repo": r["file"].split("/")[0], "path": _unpack(r["path"]), "body": _unpack(r["body"])} for r in rows]


class _Model:
    """What is sent to the tasks: weights, and names as a pattern that each worker compiles once."""

    def __init__(self, model: dict) -> None:
        self.weights, self.names, self._pattern = model["weights"], model["names"], None

    def margins(self, path: str, content: str | None) -> tuple[float, float | None, float | None]:
        self._pattern = self._pattern or (names_pattern(self.names),)
        w = self.weights
        by_path = margin(w["path"], path_features(path))
        if not content:
            return by_path, None, None
        comments, body = edges_of(content)
        return by_path, statement_margin(w["statement"], lines_of(comments), self._pattern[0]), margin(w["body"], body_features(body))


def validation(sources: DataFrame) -> list[tuple]:
    """(side, files, labelled, found, both): how each side, and all together, do on the fifth of the
    repositories that the fit did not see. `labelled` is what the weak labels of the side say; for
    body_of_tool_paths it is what paths say of tool output, judged by bodies alone."""
    sample = sampled(sources)
    repos = sorted({f["repo"] for f in sample})
    held = frozenset(repos[::5]) if len(repos) >= 5 else frozenset()
    repo = F.split_part(F.col("source_file"), F.lit("/"), F.lit(1))
    learn(sample, package_names(sources.where(~repo.isin(*sorted(held))) if held else sources), held)
    unseen = [f for f in sample if f["repo"] in held]
    out = []
    for side in (*BUCKETS, "body_of_tool_paths", "all"):
        rows = unseen if side != "body_of_tool_paths" else [f for f in unseen if f["seen"] and not is_copy(f["file"])]
        labelled = [any(f["labels"].values()) if side == "all" else f["labels"]["path" if side == "body_of_tool_paths" else side] for f in rows]
        found = [any(m > 0 for m in f["margins"].values()) if side == "all" else f["margins"]["body" if side == "body_of_tool_paths" else side] > 0 for f in rows]
        out.append((side, len(rows), sum(labelled), sum(found), sum(a and b for a, b in zip(labelled, found))))
    return out


def judged(sources: DataFrame) -> DataFrame:
    """(source_file, path, statement, body) with the margins of the present state; null where a side shows nothing."""
    model = sources.sparkSession.sparkContext.broadcast(_Model(learn(sampled(sources), package_names(sources))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [model.value.margins(path, content) for path, content in zip(b["source_file"].to_pylist(), b["content"].to_pylist())]
            sides = [pa.array(c, pa.float64()) for c in (zip(*rows) if rows else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([b["source_file"], b["version"], *sides], names=["source_file", "version", "path", "statement", "body"])

    code = with_version(sources.where(F.col("source_file").rlike(SUFFIX)), F.col("content").alias("content"))
    version = code.schema["version"].dataType.simpleString()
    return latest(code.mapInArrow(run, f"source_file string, version {version}, path double, statement double, body double"), "path", "statement", "body")


def made(sources: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(source_file) of the code files that are not hand-written: those that any side shows to be made.
    With `nodes`, only of the files that some node names."""
    found = judged(sources).where((F.col("path") > 0) | (F.col("statement") > 0) | (F.col("body") > 0)).select("source_file")
    return found if nodes is None else named(found, nodes)
