"""What a repository is made of, from a listing of its files: technologies, structure, advice, and the patterns of single files.

Edge cases: names without a suffix have no technology; an empty listing gives no technology, unknown systems and no flag; null contents
count as empty; ties of the most frequent technology go by extension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FILE_LANGUAGES, TECHNOLOGIES, lines, lookup, strip, suffix

# What a marker file at the top says, later ones outweigh earlier ones; and files or folders at the top that set a flag.
MARKERS = [("package.json", "package_manager", "npm"), ("requirements.txt", "package_manager", "pip"), ("Pipfile", "package_manager", "pipenv"), ("poetry.lock", "package_manager", "poetry"), ("Cargo.toml", "package_manager", "cargo"), ("pom.xml", "build_system", "maven"), ("build.gradle", "build_system", "gradle"), ("Makefile", "build_system", "make"), ("CMakeLists.txt", "build_system", "cmake"), ("setup.py", "build_system", "setuptools"), ("pyproject.toml", "build_system", "modern_python")]
FLAGS = [("has_tests", ["tests", "test", "__tests__", "spec"]), ("has_docs", ["docs", "documentation", "doc"]), ("has_config", ["config.py", "settings.py", ".env", "config.json", "config.yaml"])]
# Advice by number of files (under), by main technology, by flag.
BY_SIZE = [(50, "Small project: Start with main entry points and core modules"), (500, "Medium project: Focus on directory structure and key components"), (None, "Large project: Begin with documentation and configuration files")]
BY_TECHNOLOGY = [(["Python"], "Look for __init__.py files, setup.py, and main modules"), (["JavaScript", "TypeScript"], "Check package.json, src/ directory, and main entry points"), (["Java"], "Examine package structure, pom.xml/build.gradle, and main classes")]
BY_FLAG = [("has_tests", "Review test files to understand expected behavior"), ("has_docs", "Start with documentation for high-level understanding"), ("has_config", "Examine configuration files for system architecture")]


def technologies(listing: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, technology, extension, file_count) of known extensions."""
    own = listing.select(*by, suffix(F.col("path")).alias("extension")).groupBy(*by, "extension").agg(F.count(F.lit(1)).alias("file_count"))
    return own.select(*by, lookup(TECHNOLOGIES, F.col("extension")).alias("technology"), "extension", "file_count").where("technology is not null")


def size_advice(n: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for under, text in BY_SIZE:
        out = out.otherwise(F.lit(text)) if under is None else out.when(n < under, F.lit(text))
    return out


def overview(listing: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row for each group of ``by``: files, primary_language, package_manager, build_system, has_tests, has_docs, has_config, suggestions."""
    by = list(by)
    top = F.substring_index("path", "/", 1)
    here = listing.select(*by, top.alias("top"))
    system = lambda kind: [F.max(F.when(F.col("top") == name, F.lit(i))).alias(f"{kind}_{i}") for i, (name, k, _) in enumerate(MARKERS) if k == kind]
    sums = here.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), *system("package_manager"), *system("build_system"), *[F.max(F.col("top").isin(names)).alias(flag) for flag, names in FLAGS])
    last = lambda kind: F.coalesce(*[F.when(F.col(f"{kind}_{i}").isNotNull(), F.lit(v)) for i, (_, k, v) in reversed([*enumerate(MARKERS)]) if k == kind], F.lit("unknown")).alias(kind)
    main = technologies(listing, by).groupBy(*by).agg(F.max_by("technology", F.struct("file_count", "extension")).alias("primary_language"))
    met = sums.join(main, by, "left") if by else sums.join(F.broadcast(main))
    flags = [F.coalesce(F.col(flag), F.lit(False)).alias(flag) for flag, _ in FLAGS]
    made = met.select(*by, "files", F.coalesce("primary_language", F.lit("Unknown")).alias("primary_language"), last("package_manager"), last("build_system"), *flags)
    says = [size_advice(F.col("files")), *[F.when(F.col("primary_language").isin(names), F.lit(text)) for names, text in BY_TECHNOLOGY], *[F.when(F.col(flag), F.lit(text)) for flag, text in BY_FLAG]]
    return made.withColumn("suggestions", F.array_compact(F.array(*says)))


def _after(line: Column, words: list[str], ends: str) -> Column:
    """A line up to the first of ``ends``, without ``words``."""
    head = F.regexp_replace(line, f"(?s)[{ends}].*$", "")
    for w in words:
        head = F.replace(head, F.lit(w), F.lit(""))
    return head


def file_patterns(content: Column, language: Column) -> Column:
    """A struct of what the lines of a Python, JavaScript or TypeScript file hold: imports, functions, classes, comment_lines; and blank_lines of any."""
    own = F.transform(lines(F.coalesce(content, F.lit(""))), strip)
    full = F.filter(own, lambda x: x != "")
    starts = lambda x, *words: F.greatest(*[F.startswith(x, F.lit(w)) for w in words], F.lit(False))
    python, script = language == "python", language.isin("javascript", "typescript")
    arrow = lambda x: starts(x, "function ", "const ", "let ", "var ") & F.contains(x, F.lit("=>"))
    comment = lambda x: F.when(python, starts(x, "#")).when(script, starts(x, "//", "/*")).otherwise(F.lit(False))
    imports = lambda x: F.when(python, starts(x, "import ", "from ")).when(script, F.contains(x, F.lit("import ")) | F.contains(x, F.lit("require("))).otherwise(F.lit(False))
    function = lambda x: F.when(python, starts(x, "def ")).when(script, arrow(x)).otherwise(F.lit(False))
    rest = F.filter(full, lambda x: ~comment(x))
    plain = F.filter(rest, lambda x: ~imports(x))
    named = lambda x: F.when(python, _after(x, ["def "], "(")).when(F.contains(x, F.lit("function")), strip(F.regexp_extract(x, "function([^(]*?)(?:\\(|function|$)", 1))).otherwise(strip(_after(x, ["const ", "let ", "var "], "=")))
    klass = lambda x: F.when(python, _after(x, ["class "], "(:")).otherwise(strip(_after(x, ["class "], "{")))
    return F.struct(
        F.filter(rest, imports).alias("imports"), F.transform(F.filter(plain, function), named).alias("functions"),
        F.transform(F.filter(plain, lambda x: ~function(x) & starts(x, "class ") & (python | script)), klass).alias("classes"),
        F.size(F.filter(full, comment)).cast("bigint").alias("comment_lines"), F.size(F.filter(own, lambda x: x == "")).cast("bigint").alias("blank_lines"),
    )


#: Languages whose files are looked through for patterns.
PATTERNED = ["python", "javascript", "typescript", "java", "cpp", "c"]


def file_analysis(listing: DataFrame) -> DataFrame:
    """One row for each file (path, content): size in bytes, extension, language, line_count, char_count, and its patterns (null for other languages)."""
    text = F.coalesce("content", F.lit(""))
    made = listing.select(
        "path", F.octet_length(text).cast("bigint").alias("size"), suffix(F.col("path")).alias("extension"), lookup(FILE_LANGUAGES, F.lower(suffix(F.col("path"))), "unknown").alias("language"),
        F.size(lines(text)).cast("bigint").alias("line_count"), F.length(text).cast("bigint").alias("char_count"), text.alias("content"),
    )
    return made.withColumn("patterns", F.when(F.col("language").isin(PATTERNED), file_patterns(F.col("content"), F.col("language")))).drop("content")
