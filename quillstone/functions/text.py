"""Column functions for paths, lines, names, ids and languages; built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by extension, for indexing.
INDEX_LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby"}
# The further ones known when a single file is analysed.
FILE_LANGUAGES = INDEX_LANGUAGES | {".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".html": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".sql": "sql", ".md": "markdown", ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "config", ".conf": "config"}
# Those that are inspected, and those that a session tells apart.
INSPECT_LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript"}
SESSION_LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".rs": "rust", ".go": "go", ".rb": "ruby", ".php": "php", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".xml": "xml", ".html": "html", ".css": "css"}
# Technology by extension.
TECHNOLOGIES = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "React", ".tsx": "React with TypeScript", ".java": "Java", ".cpp": "C++", ".c": "C", ".cs": "C#", ".go": "Go", ".rs": "Rust", ".php": "PHP", ".rb": "Ruby", ".swift": "Swift", ".kt": "Kotlin"}
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\u0085\\u2028\\u2029]"

# Unicode white space inside a line, for Java's and RE2's classes alike.
BLANK = "\\s\\x1f\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}"
IMPORT_LINE = f"^[{BLANK}]*(?:import|from) [{BLANK}]*[^{BLANK}]"
IMPORT_ROOT = f"^[{BLANK}]*(?:import|from) [{BLANK}]*([^.{BLANK}]*)"
SCRIPT_IMPORT = f"import[{BLANK}]+.*?from[{BLANK}]+['\"]([^'\"]+)['\"]"


def lookup(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    """Value of ``key`` in a small fixed table."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def any_of(col: Column, words: list[str]) -> Column:
    """Whether ``col`` contains one of ``words``."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col, F.lit(w))
    return out


def first_class(col: Column, classes: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first class of which ``col``, lower-cased, contains a word."""
    low, out = F.lower(col), F.when(F.lit(False), F.lit(""))
    for name, words in classes:
        out = out.when(any_of(low, words), F.lit(name))
    return out.otherwise(F.lit(default))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(base_name(path), "^.+(\\.[^.]+)$", 1)


def lines(text: Column) -> Column:
    """Lines without their ends; no line after the last end; none in an empty text."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, "^\\s+|\\s+$", "")


def count_lines(parts: Column, *starts: str) -> Column:
    """Lines that, stripped, begin with one of ``starts``. Lines aren't copied: one pattern looks at their heads; a start that ends in a space
    needs something after it, else it would be stripped."""
    plain = lambda w: "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in w)
    pattern = "|".join(plain(w) + ("\\s*\\S" if w.endswith(" ") else "") for w in starts)
    return F.size(F.filter(parts, lambda x: x.rlike(f"^\\s*(?:{pattern})"))).cast("bigint")


def imports(text: Column, language: Column) -> Column:
    """What the lines of a file import, in their order: for Python the first dotted part of the second word of lines that begin with
    import or from (empty for a leading dot), for JavaScript and TypeScript the last path segment after from; else nothing."""
    python = F.transform(F.filter(lines(text), lambda x: x.rlike(IMPORT_LINE)), lambda x: F.regexp_extract(x, IMPORT_ROOT, 1))
    script = F.transform(F.filter(lines(text), lambda x: x.rlike(SCRIPT_IMPORT)), lambda x: base_name(F.regexp_extract(x, SCRIPT_IMPORT, 1)))
    return F.when(language == "python", python).when(language.isin("javascript", "typescript"), script).otherwise(F.array().cast("array<string>"))


def language_of(path: Column, languages: dict[str, str]) -> Column:
    """Language of a path by its suffix, whatever the case, else unknown."""
    return lookup(languages, F.lower(suffix(path)), "unknown")


def entity_id(kind: Column | str, *parts: Column) -> Column:
    """Hex md5 of kind:part:..."""
    return F.md5(F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, *parts))


def glob_to_regex(glob: str) -> str:
    """Whole-path glob: ``*`` and ``?`` cross slashes, ``[...]`` is a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        else:
            out += "\\" + c if not c.isalnum() else c
        i += 1
    return f"(?s)^{out}$"


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, else 1 - edit distance / longer length of the lower-cased names."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((a == b) | (longest == 0), F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(x, y) / longest)
