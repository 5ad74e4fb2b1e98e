"""Structural extractors: source files to nodes and edges.

A registry maps a suffix to a function of (path, content) giving nodes (id, label, kind, line) and
edges (source, target, relation). One pass of Arrow batches over the files; a parse error of one
file gives that file's node alone. Python is parsed by its own grammar, the others by patterns.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import normalize_id_text

Found = list[tuple[str, str, int]]  # kind, name, line
REGISTRY: dict[str, Callable[[str], tuple[Found, Found]]] = {}


def extractor(*suffixes: str) -> Callable:
    def add(function: Callable[[str], tuple[Found, Found]]) -> Callable:
        REGISTRY.update(dict.fromkeys(suffixes, function))
        return function

    return add


@extractor("py")
def python(text: str) -> tuple[Found, Found]:
    symbols, uses = [], []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            symbols.append(("function", node.name + "()", node.lineno))
        elif isinstance(node, ast.ClassDef):
            symbols.append(("class", node.name, node.lineno))
            uses += [("inherits", b.id, node.lineno) for b in node.bases if isinstance(b, ast.Name)]
        elif isinstance(node, ast.Import):
            uses += [("imports", a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            uses.append(("imports_from", "." * node.level + (node.module or ""), node.lineno))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            uses.append(("calls", node.func.id, node.lineno))
    return symbols, uses


def _by_patterns(symbols: dict[str, str], uses: dict[str, str]) -> Callable[[str], tuple[Found, Found]]:
    made = {k: re.compile(p, re.M) for k, p in (symbols | {f" {k}": p for k, p in uses.items()}).items()}

    def run(text: str) -> tuple[Found, Found]:
        at = lambda m: text.count("\n", 0, m.start()) + 1
        names = lambda k: [(k.strip(), m.group(1) + ("()" if k == "function" else ""), at(m)) for m in made[k].finditer(text)]
        return [x for k in symbols for x in names(k)], [x for k in uses for x in names(" " + k)]

    return run


REGISTRY |= dict.fromkeys(("js", "ts", "jsx", "tsx"), _by_patterns({"function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*|const\s+(?=\w+\s*=\s*(?:async\s*)?\())(\w+)", "class": r"^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)"}, {"imports_from": r"^\s*(?:import|export)\b[^'\"\n]*from\s*['\"]([^'\"]+)['\"]", "inherits": r"\bclass\s+\w+\s+extends\s+(\w+)"}))
REGISTRY["go"] = _by_patterns({"function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "class": r"^type\s+(\w+)"}, {"imports_from": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"})
REGISTRY["rs"] = _by_patterns({"function": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "class": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"}, {"imports_from": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "implements": r"^\s*impl(?:<[^>]*>)?\s+(\w+)\s+for\b"})
REGISTRY["java"] = _by_patterns({"class": r"\b(?:class|interface|enum|record)\s+(\w+)", "function": r"^\s*(?:public|protected|private)\s+(?:static\s+)?(?:final\s+)?[\w<>\[\], ]+\s+(\w+)\s*\("}, {"imports": r"^\s*import\s+(?:static\s+)?([\w.]+)", "inherits": r"\bextends\s+(\w+)", "implements": r"\bimplements\s+(\w+)"})
REGISTRY["c"] = REGISTRY["h"] = _by_patterns({"function": r"^(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w*]*[\s*]+(\w+)\s*\([^;{}]*\)\s*\{", "class": r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{"}, {"includes": r"^\s*#include\s*[<\"]([^>\"]+)[>\"]"})
REGISTRY["sql"] = _by_patterns({"table": r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)", "view": r"(?i)\bcreate\s+(?:or\s+replace\s+)?view\s+([\w.]+)", "function": r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)"}, {"references": r"(?i)\breferences\s+([\w.]+)", "reads_from": r"(?i)\b(?:from|join)\s+([\w.]+)"})
REGISTRY |= dict.fromkeys(("sh", "bash"), _by_patterns({"function": r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"}, {"imports_from": r"^\s*(?:source|\.)\s+(\S+)"}))
REGISTRY["rb"] = _by_patterns({"class": r"^\s*(?:class|module)\s+([\w:]+)", "function": r"^\s*def\s+(?:self\.)?(\w+[?!]?)"}, {"imports": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)", "inherits": r"^\s*class\s+\w+\s*<\s*([\w:]+)"})
REGISTRY["php"] = _by_patterns({"class": r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)", "function": r"\bfunction\s+(\w+)\s*\("}, {"imports": r"^\s*use\s+([\w\\]+)", "inherits": r"\bextends\s+(\w+)"})
REGISTRY |= dict.fromkeys(("kt", "scala", "groovy"), _by_patterns({"class": r"\b(?:class|interface|object|trait)\s+(\w+)", "function": r"\b(?:fun|def)\s+(?:<[^>]*>\s*)?(\w+)\s*\("}, {"imports": r"^\s*import\s+([\w.]+)"}))
REGISTRY["swift"] = _by_patterns({"class": r"\b(?:class|struct|enum|protocol|extension)\s+(\w+)", "function": r"\bfunc\s+(\w+)"}, {"imports": r"^\s*import\s+(\w+)"})
REGISTRY["cs"] = _by_patterns({"class": r"\b(?:class|interface|struct|enum|record)\s+(\w+)", "function": r"^\s*(?:public|private|protected|internal)\s+(?:static\s+|async\s+|override\s+|virtual\s+)*[\w<>\[\],?]+\s+(\w+)\s*\("}, {"imports": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"})
REGISTRY["lua"] = _by_patterns({"function": r"^\s*(?:local\s+)?function\s+([\w.:]+)"}, {"imports": r"\brequire\s*\(?\s*['\"]([^'\"]+)"})
REGISTRY["zig"] = _by_patterns({"function": r"\bfn\s+(\w+)\s*\(", "class": r"\bconst\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b"}, {"imports_from": r"@import\(\"([^\"]+)\"\)"})
REGISTRY["jl"] = _by_patterns({"class": r"^\s*(?:mutable\s+)?(?:struct|module|abstract\s+type)\s+(\w+)", "function": r"^\s*function\s+(\w+!?)"}, {"imports": r"^\s*(?:using|import)\s+([\w.]+)", "inherits": r"<:\s*(\w+)"})
REGISTRY |= dict.fromkeys(("ex", "exs"), _by_patterns({"class": r"^\s*defmodule\s+([\w.]+)", "function": r"^\s*defp?\s+(\w+[?!]?)"}, {"imports": r"^\s*(?:import|alias|use|require)\s+([\w.]+)"}))
REGISTRY |= dict.fromkeys(("f90", "f95", "f03"), _by_patterns({"class": r"(?i)^\s*(?:module|program)\s+(?!procedure)(\w+)", "function": r"(?i)^\s*(?:pure\s+|elemental\s+|recursive\s+)*(?:subroutine|function)\s+(\w+)"}, {"imports": r"(?i)^\s*use\s*,?\s*(?:intrinsic\s*::\s*)?(\w+)", "calls": r"(?i)\bcall\s+(\w+)"}))
REGISTRY |= dict.fromkeys(("v", "sv"), _by_patterns({"class": r"^\s*(?:module|interface|package|class)\s+(\w+)", "function": r"^\s*(?:function|task)\s+(?:automatic\s+)?(?:\w+\s+)?(\w+)\s*[(;]"}, {"imports_from": r"^\s*import\s+(\w+)::"}))
REGISTRY["tf"] = _by_patterns({"block": r"^\s*(?:resource|data|module|variable|output)\s+(?:\"[^\"]+\"\s+)?\"([^\"]+)\"\s*\{"}, {"references": r"\$\{([\w.]+)"})
REGISTRY["ps1"] = _by_patterns({"function": r"(?i)^\s*function\s+([\w-]+)", "class": r"(?i)^\s*class\s+(\w+)"}, {"imports_from": r"(?i)^\s*(?:using\s+module|import-module)\s+(\S+)"})
REGISTRY |= dict.fromkeys(("pas", "dpr"), _by_patterns({"class": r"(?i)^\s*(\w+)\s*=\s*class\b", "function": r"(?i)^\s*(?:procedure|function)\s+([\w.]+)"}, {"inherits": r"(?i)=\s*class\s*\(\s*(\w+)"}))
REGISTRY["dart"] = _by_patterns({"class": r"^\s*(?:abstract\s+)?(?:class|mixin|enum)\s+(\w+)"}, {"imports": r"^\s*import\s+['\"]([^'\"]+)", "extends": r"\bextends\s+(\w+)", "implements": r"\bimplements\s+(\w+)", "mixes_in": r"\bwith\s+(\w+)"})
REGISTRY |= dict.fromkeys(("md", "mdx", "rst", "txt"), _by_patterns({"heading": r"^#{1,6}\s+(.+?)\s*$"}, {"references": r"\]\(([^)\s]+)\)"}))


def extract(sources: DataFrame) -> DataFrame:
    """(source_file, part, source, target, label, kind, line): part is `node` (target null) or `edge`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source_file", "part", "source", "target", "label", "kind", "line"]
        for b in batches:
            rows: list[tuple] = []
            for path, text in zip(b["source_file"].to_pylist(), b["content"].to_pylist()):
                stem = normalize_id_text(path.rsplit(".", 1)[0])
                rows.append((path, "node", stem, None, path.rsplit("/", 1)[-1], "file", 1))
                try:
                    symbols, uses = REGISTRY[path.rsplit(".", 1)[-1].lower()](text or "")
                except (KeyError, SyntaxError, ValueError, RecursionError):
                    continue
                for kind, name, line in symbols:
                    own = f"{stem}_{normalize_id_text(name)}"
                    rows.append((path, "node", own, None, name, kind, line))
                    rows.append((path, "edge", stem, own, None, "contains", line))
                rows += [(path, "edge", stem, normalize_id_text(name), None, kind, line) for kind, name, line in uses]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "line" else pa.string()) for n, c in zip(names, columns)], names=names)

    return sources.where(F.col("source_file").isNotNull()).select("source_file", "content").mapInArrow(run, "source_file string, part string, source string, target string, label string, kind string, line int")
