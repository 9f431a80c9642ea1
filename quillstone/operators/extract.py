"""Entities and facts from source text. Parsing needs Python: table functions over batches of files (path, content)."""

from __future__ import annotations

import ast
import bisect
import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import bounded

BLOCK_LINES = 50
ROWS = 20_000  # rows of a table that goes back from a Python task
# Patterns of lines.
_FROM, _REQUIRE = re.compile(r"from\s+['\"]([^'\"]+)['\"]"), re.compile(r"require\(['\"]([^'\"]+)['\"]\)")
_CLASS, _DEF = re.compile(r"class\s+(\w+)"), re.compile(r"def\s+(\w+)")
_JS_NAME = re.compile(r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=)")
_JS_IMPORTS = [re.compile(p) for p in (r"require\(['\"]([^'\"]+)['\"]\)", r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", r"import\s+['\"]([^'\"]+)['\"]")]
_JS_CALL = re.compile(r"(\w+)\s*\(")
ENTITY = "path string, name string, type string, language string, line long, content string, size long"
SCRIPT_KINDS = {"import", "call"}  # what JavaScript has facts of
FACT = "path string, kind string, a string, b string, line long, detail string"


def block(lines: list[str], at: int) -> str:
    """The header line and what is blank or deeper below it, 50 lines at most."""
    depth = lambda s: len(s) - len(s.lstrip())
    end = at + 1
    while end < min(len(lines), at + BLOCK_LINES) and (not lines[end].strip() or depth(lines[end]) > depth(lines[at])):
        end += 1
    return "\n".join(lines[at:end])


def line_entities(content: str, language: str) -> Iterator[tuple[str, str, int, str]]:
    """(name, type, line, block) of the class and function lines of a Python or JavaScript text."""
    lines = content.splitlines()
    python = language == "python"
    for i, raw in enumerate(lines):
        s = raw.strip()
        found = None
        if s.startswith("class "):
            m = _CLASS.match(s)
            found = m and (m[1], "class")
        elif python and s.startswith("def "):
            m = _DEF.match(s)
            found = m and (m[1], "function")
        elif not python and ("function" in s or "=>" in s):
            m = _JS_NAME.search(s)
            found = m and (m[1] or m[2], "function")
        if found:
            yield *found, i + 1, block(lines, i)


def _name(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _parsed(content: str) -> ast.AST | None:
    """The tree of a text, or None if the parser does not take it: for its syntax, or as it nests too deep for the parser."""
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _walk(tree: ast.AST) -> Iterator[tuple[ast.AST, str | None, str | None]]:
    """Nodes in the order of the text with the innermost function and class around each. A stack of its own, so depth is no limit; what is
    imported has nothing below it."""
    todo: list[tuple[ast.AST, str | None, str | None]] = [(tree, None, None)]
    while todo:
        node, function, klass = todo.pop()
        yield node, function, klass
        if isinstance(node, ast.FunctionDef):
            function = node.name
        elif isinstance(node, ast.ClassDef):
            klass = node.name
        todo += [(x, function, klass) for x in reversed(list(ast.iter_child_nodes(node)))]


def python_facts(content: str) -> list[tuple[str, str, str, int, str]]:
    """(kind, a, b, line, detail) of imports, calls, bases, decorators and exceptions, with the innermost function or class as their place; none if the
    text does not parse."""
    tree, rows = _parsed(content), []
    for node, function, klass in _walk(tree) if tree is not None else ():
        if isinstance(node, ast.Import):
            rows += [("import", a.name, a.asname or "", node.lineno, "direct") for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            rows += [("import", a.name, a.asname or "", node.lineno, f"from {'.' * node.level}{node.module or ''}") for a in node.names]
        elif isinstance(node, ast.Call):
            kind = "function" if isinstance(node.func, ast.Name) else "method"
            if name := _name(node.func):
                rows.append(("call", function or klass or "module", name, node.lineno, kind))
        elif isinstance(node, ast.Try) and function:
            rows += [("exception", function, name, node.lineno, "catch") for h in node.handlers if h.type is not None and (name := _name(h.type))]
        elif isinstance(node, ast.Raise) and function and node.exc is not None:
            if name := _name(node.exc.func if isinstance(node.exc, ast.Call) else node.exc):
                rows.append(("exception", function, name, node.lineno, "raise"))
        if isinstance(node, ast.ClassDef):
            rows += [("inherit", node.name, name, node.lineno, "multiple" if len(node.bases) > 1 else "single") for b in node.bases if (name := _name(b))]
        if isinstance(node, ast.ClassDef | ast.FunctionDef):
            named = [_name(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
            rows += [("decorator", node.name, name, node.lineno, "") for name in named if name]
    return rows


def javascript_facts(content: str) -> list[tuple[str, str, str, int, str]]:
    """Imports pattern by pattern, then calls, whose caller is unknown."""
    ends = [m.start() for m in re.finditer("\n", content)]
    at = lambda m: bisect.bisect_left(ends, m.start()) + 1
    rows = [("import", m[1], "", at(m), "direct") for p in _JS_IMPORTS for m in p.finditer(content)]
    return rows + [("call", "", m[1], at(m), "function") for m in _JS_CALL.finditer(content)]


def inspect_python(content: str) -> dict:
    """Counts of a parsed text. A branch inside a function counts twice, as the function's own complexity and as a branch; ``with`` counts in functions only."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"classes": 0, "functions": 0, "complexity": 0, "line_count": 0, "dependencies": [], "issues": [f"syntax error: {e}"]}
    branches = (ast.If, ast.While, ast.For, ast.Try)
    complexity = classes = functions = 0
    needs: list[str] = []
    for node in ast.walk(tree):
        complexity += isinstance(node, branches)
        if isinstance(node, ast.FunctionDef):
            functions += 1
            complexity += sum(isinstance(x, (*branches, ast.With)) for x in ast.walk(node))
        elif isinstance(node, ast.ClassDef):
            classes += 1
        elif isinstance(node, ast.Import):
            needs += [a.name.split(".")[0] for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            needs.append(node.module.split(".")[0])
    return {"classes": classes, "functions": functions, "complexity": complexity, "line_count": 0, "dependencies": list(dict.fromkeys(needs)), "issues": []}


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
    """(path, content, language) of each file; of a batch only a few are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 16):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 16).columns), strict=True)


def _rows(files: DataFrame, of, schema: str) -> DataFrame:
    """The rows that ``of`` finds in each (path, content, language), in tables of ROWS rows at most, so that what a task holds does not grow with its files."""
    types = [x.split() for x in schema.split(", ")]
    fields = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for path, content, language in _files(batches) for row in of(path, content or "", language))
        while rows := list(itertools.islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return bounded(files.select("path", "content", "language")).mapInArrow(run, schema)


def entities(files: DataFrame) -> DataFrame:
    """(path, content, language) to class and function entities."""

    def of(path: str, content: str, language: str) -> Iterator[tuple]:
        if language in ("python", "javascript", "typescript"):
            kind = "python" if language == "python" else "javascript"
            for name, type_, line, text in line_entities(content, kind):
                yield path, name, type_, kind, line, text, len(text)

    return _rows(files, of, ENTITY)


def facts(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(path, content, language) to facts: kind, a, b, line, detail; of ``kinds`` only, if given."""

    def of(path: str, content: str, language: str) -> Iterator[tuple]:
        found = python_facts(content) if language == "python" else javascript_facts(content) if language in ("javascript", "typescript") else []
        return ((path, *r) for r in found if kinds is None or r[0] in kinds)

    if kinds is not None and not set(kinds) & SCRIPT_KINDS:
        files = files.where("language = 'python'")
    return _rows(files, of, FACT)


def inspections(files: DataFrame) -> DataFrame:
    """(path, content, language) to one report a file."""
    schema = "path string, classes long, functions long, complexity long, line_count long, dependencies array<string>, issues array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, language in zip(b["path"], b["content"], b["language"], strict=True):
                text = content or ""
                if language == "python":
                    rows.append({"path": path} | inspect_python(text))
                    continue
                own = list(line_entities(text, "javascript")) if language in ("javascript", "typescript") else []
                rows.append({"path": path, "classes": sum(e[1] == "class" for e in own), "functions": sum(e[1] == "function" for e in own), "complexity": 0, "line_count": len(text.splitlines()), "dependencies": [], "issues": []})
            yield pd.DataFrame(rows, columns=["path", "classes", "functions", "complexity", "line_count", "dependencies", "issues"])

    return bounded(files.select("path", "content", "language")).mapInPandas(run, schema)


ITEM = "path string, kind string, name string, line long, module string, alias string, args array<string>, bases array<string>, decorators array<string>"


def _shown(nodes: list) -> list[str]:
    """Names as they stand, other expressions as source, or ``...`` where that nests too deep."""
    out = []
    for n in nodes:
        try:
            out.append(n.id if isinstance(n, ast.Name) else ast.unparse(n))
        except RecursionError:
            out.append("...")
    return out


def python_items(content: str) -> list[dict]:
    """Classes, functions and imports of a module in the order of the text, outer ones first; none if the text does not parse."""
    tree = _parsed(content)
    rows: list[dict] = []
    todo: list[ast.AST] = [] if tree is None else [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.ClassDef):
            rows.append({"kind": "class", "line": node.lineno, "name": node.name, "bases": _shown(node.bases), "decorators": _shown(node.decorator_list)})
        elif isinstance(node, ast.FunctionDef):
            rows.append({"kind": "function", "line": node.lineno, "name": node.name, "args": [a.arg for a in node.args.args], "decorators": _shown(node.decorator_list)})
        elif isinstance(node, ast.Import):
            rows += [{"kind": "import", "line": node.lineno, "module": a.name, "alias": a.asname} for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            rows += [{"kind": "from_import", "line": node.lineno, "module": node.module, "name": a.name, "alias": a.asname} for a in node.names]
        todo += reversed(list(ast.iter_child_nodes(node)))
    return rows


def script_items(content: str) -> list[dict]:
    """Imports, classes and functions of JavaScript or TypeScript, line by line."""
    rows = []
    for i, raw in enumerate(content.splitlines(), 1):
        s = raw.strip()
        if s.startswith("import ") or "require(" in s:
            rows += [{"kind": kind, "line": i, "module": m[1]} for kind, m in (("es6_import", _FROM.search(s)), ("commonjs_require", _REQUIRE.search(s))) if m]
        if s.startswith("class ") and (m := _CLASS.match(s)):
            rows.append({"kind": "class", "line": i, "name": m[1]})
        if (s.startswith("function ") or "=>" in s) and (m := _JS_NAME.search(s)):
            rows.append({"kind": "function", "line": i, "name": m[1] or m[2]})
    return rows


def items(files: DataFrame) -> DataFrame:
    """(path, content, language) to what an inspection lists: classes, functions and imports, with their lines and details."""
    names = ["kind", "name", "line", "module", "alias", "args", "bases", "decorators"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, language in zip(b["path"], b["content"], b["language"], strict=True):
                found = python_items(content or "") if language == "python" else script_items(content or "") if language in ("javascript", "typescript") else []
                rows += [(path, *(r.get(n) for n in names)) for r in found]
            yield pd.DataFrame(rows, columns=["path", *names], dtype=object)

    return bounded(files.select("path", "content", "language")).mapInPandas(run, ITEM)
