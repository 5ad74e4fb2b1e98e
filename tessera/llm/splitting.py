"""Problem 4: splitting long files at natural boundaries.

Boundaries are the starts of lines, graded: headings, starts of paragraphs, of definitions, any
line; where lines are too far apart, the characters after white space and, failing that, any
character. Dynamic programming over the boundaries finds the cuts with the least sum of
penalties and of squared deviations from equal size, each piece being at most `limit` long and
each after the first beginning with the last `overlap` characters of the one before.

A text of at most `limit` characters, an empty and a null one have no pieces here (there is
nothing to cut). Lengths are in Unicode code points; the whole text is covered, whatever its
length. Repeated scans count once. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.present import present_texts

LIMIT, OVERLAP = 12_000, 200
#: Cut penalties of the grades; 1 is about the cost of a piece half as long as the others.
HEADING, PARAGRAPH, DEFINITION, LINE, SPACE, ANY = 0.0, 0.15, 0.1, 0.6, 3.0, 8.0
#: A gap between lines longer than this gets boundaries at spaces, or anywhere.
GAP = 1_500

_HEADING = re.compile(r"#{1,6}\s|={3,}\s*$|-{4,}\s*$|<h[1-6]\b")
_DEFINITION = re.compile(r"(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|pub(?:\([^)]*\))?\s+|default\s+|abstract\s+|final\s+)*(?:def|class|func|fn|function|interface|struct|enum|trait|impl|type|module|const\s+\w+\s*=\s*(?:async\s*)?\()\b|(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\(|@\w+")
_BREAK = re.compile(r"\r\n|\r|\n")


def boundaries(text: str, limit: int, overlap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the text may be cut, from 0 to its end, and their penalties."""
    spots: dict[int, float] = {}
    starts = [0, *(m.end() for m in _BREAK.finditer(text)), len(text)]
    blank = False
    for this, following in zip(starts, starts[1:]):
        line = text[this:following]
        if this:
            underlined = text[following : following + 4] in ("====", "----", "~~~~")
            grade = HEADING if (_HEADING.match(line) and line[0] in "#<") or underlined else DEFINITION if _DEFINITION.match(line.lstrip() if line[:4].isspace() is False else line) else PARAGRAPH if blank and line.strip() else LINE
            spots[this] = grade
        blank = not line.strip()
    gap = max(1, min(GAP, limit // 4, limit - overlap))  # so that every run of what a piece can add holds a boundary
    lines = sorted({0, *spots, len(text)})
    for this, following in zip(lines, lines[1:]):
        at = this
        while following - at > gap:
            window = text[at + gap // 2 : at + gap]
            space = max(window.rfind(" "), window.rfind("\t"))
            at, grade = (at + gap // 2 + space + 1, SPACE) if space >= 0 else (at + gap, ANY)
            spots[at] = grade
    spots.pop(0, None)
    spots.pop(len(text), None)
    positions = np.array([0, *sorted(spots), len(text)], dtype=np.int64)
    return positions, np.array([0.0, *(spots[p] for p in positions[1:-1].tolist()), 0.0])


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of the pieces of a text longer than the limit."""
    at, penalty = boundaries(text, limit, overlap)
    fresh = limit - overlap  # what a piece after the first can add
    pieces = max(2, 1 + -(-(len(text) - limit) // fresh))
    even = len(text) / pieces
    best, back = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    best[0] = 0.0
    low = np.searchsorted(at, at - fresh)
    for j in range(1, len(at)):
        first = 0 if at[j] <= limit else low[j]
        span = slice(first, j)
        sizes = at[j] - at[span]
        fits = (sizes <= fresh) | (at[span] == 0)
        ends = at[span] == 0
        fits &= ends | (at[span] >= overlap)
        cost = np.where(fits, best[span] + ((sizes - even) / even) ** 2, np.inf)
        k = int(np.argmin(cost))
        best[j], back[j] = cost[k] + penalty[j] + 0.05, first + k
    cuts, j = [len(text)], len(at) - 1
    while j:
        j = int(back[j])
        cuts.append(int(at[j]))
    cuts.reverse()
    return [(max(0, s - overlap), e) for s, e in zip(cuts, cuts[1:])]


def pieces(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(source_file, piece, start, end, text) of (source_file, content)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than a piece")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("source_file", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
        for b in batches:
            for name, text in zip(b["source_file"].to_pylist(), b["content"].to_pylist()):
                if text is None or len(text) <= limit:
                    continue
                spans = split(text, limit, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(spans)), pa.array(range(len(spans)), pa.int32()), pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64()), pa.array([text[s:e] for s, e in spans])], schema=schema)

    return texts.select("source_file", "content").mapInArrow(cut, "source_file string, piece int, start long, end long, text string")


def split_sources(sources: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, nodes: DataFrame | None = None) -> DataFrame:
    """The pieces of all long files or, with `nodes`, of those that some node names."""
    return pieces(present_texts(sources, limit, nodes), limit, overlap)


def long_files(sources: DataFrame, limit: int = LIMIT, nodes: DataFrame | None = None) -> DataFrame:
    """(source_file) of the files that had to be cut: those with a second piece."""
    return split_sources(sources, limit, nodes=nodes).where("piece = 1").select("source_file")
