"""Extraction from documentation by rules: commands, dependencies, examples, sections. Column functions.

The line separator of these rules is the two characters backslash and n, and several of their patterns ask for backslashes, as users of
the rules rely on; on ordinary files only the inline pattern finds something.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

# What is looked for.
COMMANDS = ["(?im)```(?:bash|shell|sh)\\\\n([^`]+)```", "(?im)`([^`]*(?:pip|python|pytest|npm|yarn)[^`]*)`", "(?im)^\\\\s*\\\\$\\\\s*(.+)$", "(?im)^\\\\s*([a-z-]+(?:\\\\s+[a-z0-9._-]+)+)\\\\s*$"]
FRAMEWORKS = ["pytest", "unittest", "fastapi", "django"]
EXAMPLE = "(?s)```(?:python|py)?\\\\n([^`]+)```"


def commands(content: Column) -> Column:
    """Distinct commands of 4 to 99 characters, sorted."""
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in COMMANDS])
    clean = F.transform(found, lambda x: strip(F.replace(strip(x), F.lit("\\n"), F.lit(" "))))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: F.length(x).between(4, 99))))


def dependencies(content: Column) -> Column:
    """Package names before a version operator."""
    lines = F.transform(F.split(content, "\\\\n"), strip)
    lines = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("-")))
    return F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, "(?s)[>=<~!].*$", ""))), lambda x: x != "")


def examples(content: Column) -> Column:
    """Fenced blocks of 21 to 499 characters."""
    return F.filter(F.transform(F.regexp_extract_all(content, F.lit(EXAMPLE), F.lit(1)), strip), lambda x: F.length(x).between(21, 499))


def toml_sections(content: Column) -> Column:
    lines = F.transform(F.split(content, "\\\\n"), strip)
    keep = F.filter(lines, lambda x: F.startswith(x, F.lit("[")) & F.endswith(x, F.lit("]")) & ~F.startswith(x, F.lit("[[")))
    return F.transform(keep, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def test_configuration(content: Column, name: Column) -> Column:
    toml = F.endswith(name, F.lit(".toml"))
    return F.array_compact(F.array(
        F.when(toml & F.contains(content, F.lit("[tool.pytest")), F.lit("Pytest configuration found in pyproject.toml")),
        F.when(toml & F.contains(content, F.lit("[tool.coverage")), F.lit("Coverage configuration found in pyproject.toml")),
    ))


def install_instructions(content: Column) -> Column:
    """Commands below a heading about installation, up to the next other heading."""
    about = lambda x, words: F.greatest(*[F.contains(F.lower(x), F.lit(w)) for w in words])
    lines = F.split(content, "\\\\n")
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        heading = F.startswith(x, F.lit("#"))
        enter = ~s["over"] & heading & about(x, ["install", "setup", "getting started"])
        leave = s["inside"] & heading & ~about(x, ["install", "setup"]) & ~enter
        own = strip(x)
        inline = F.regexp_extract(x, "`([^`]*(?:pip|python)[^`]*)`", 1)
        line = F.when(F.startswith(own, F.lit("pip ")) | F.startswith(own, F.lit("python ")), own).when((F.contains(x, F.lit("`pip ")) | F.contains(x, F.lit("`python "))) & (inline != ""), inline)
        take = s["inside"] & ~enter & ~leave & ~s["over"] & line.isNotNull()
        return F.struct((s["inside"] | enter).alias("inside"), (s["over"] | leave).alias("over"), F.when(take, F.concat(s["found"], F.array(line))).otherwise(s["found"]).alias("found"))

    return F.aggregate(lines, start, step, lambda s: s["found"])


def names_frameworks(content: Column, words: list[str] = FRAMEWORKS) -> list[tuple[str, Column]]:
    """Each framework and whether a text names it."""
    return [(w, F.contains(content, F.lit(w))) for w in words]
