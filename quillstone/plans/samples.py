"""The small corpus of the extractor queries, and indexing of any table of files."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import INDEX_LANGUAGES, base_name, lookup, suffix
from ..operators import extract, graph, inference

A = 'import os\nfrom b import Base, helper\n\nclass Child(Base):\n    def run(self):\n        try:\n            helper()\n        except ValueError:\n            raise Oops("x")\n\n@helper\ndef top():\n    return Child().run()\n\nasync def later():\n    top()\n'
B = "class Base:\n    pass\n\ndef helper(fn=None):\n    return fn\n\nclass Oops(Exception):\n    pass\n"
JS = "import x from './lib/util';\nconst y = require('fs');\nclass Widget {}\nconst go = () => go2();\nfunction stop() { return y(); }\n"
CORPUS = [("pkg/core/a.py", A), ("pkg/core/b.py", B), ("web/w.js", JS)]


def files(spark: SparkSession) -> DataFrame:
    """The corpus as (ord, path, content, language)."""
    rows = [(i, p, c) for i, (p, c) in enumerate(CORPUS)]
    made = spark.createDataFrame(rows, "ord long, path string, content string")
    return made.withColumn("language", lookup(INDEX_LANGUAGES, F.lower(suffix(F.col("path"))), "unknown"))


STRIDE = 1_000_000  # entities of a file follow it in line order


def file_id(path="path"):
    return F.md5(F.concat(F.lit("file:"), F.col(path)))


def extracted(source: DataFrame, prefix: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ord, path, content, language) to entities (ord, id, name, type, path, content, language, size, line), facts (path, kind, a, b, line) and the tokens that
    files import (path, token, nth). ``prefix``: facts and tokens come from so many first characters of a file only, as files keep no more than that in some
    knowledge bases; by default from the whole. Entities and facts are written, as several joins read them."""
    whole = source.select((F.col("ord") * STRIDE).alias("ord"), file_id().alias("id"), base_name(F.col("path")).alias("name"), F.lit("file").alias("type"), "path", F.substring("content", 1, 1000).alias("content"), "language", F.octet_length("content").cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("line"))
    parts = extract.entities(source).join(source.select("path", F.col("ord").alias("file_ord")), "path")
    parts = parts.select((F.col("file_ord") * STRIDE + F.col("line")).alias("ord"), F.md5(F.concat_ws(":", "type", "path", "name")).alias("id"), "name", "type", "path", "content", "language", "size", "line")
    first = parts.groupBy("id").agg(F.min("ord").alias("ord"), F.min("line").alias("line"), F.max_by(F.struct("name", "type", "path", "content", "language", "size"), "ord").alias("v"))
    entities = graph.cut(whole.unionByName(first.select("ord", "id", "v.*", "line")), "entities")
    read = source if prefix is None else source.withColumn("content", F.substring("content", 1, prefix))
    facts = graph.cut(extract.facts(read), "facts").select("path", "kind", "a", "b", "line")
    both = F.concat(F.regexp_extract_all("content", F.lit("import\\s+(\\w+)"), F.lit(1)), F.regexp_extract_all("content", F.lit("from\\s+(\\w+)"), F.lit(1)))
    return entities, facts, read.select("path", F.posexplode(both).alias("nth", "token"))


def related(entities: DataFrame, facts: DataFrame, uses: DataFrame) -> DataFrame:
    """Relationships between ``entities`` (ord, id, name, type, path), in which files have the type file."""
    of_file = facts.where("kind = 'import'").select(file_id().alias("source_id"), F.col("a").alias("symbol"))
    named = lambda kind: facts.where(F.col("kind") == kind).drop("kind")
    files = entities.where("type = 'file'").select("ord", "id", "path")
    tokens = uses.select("path", "token").join(files, "path").select("ord", "id", "token")
    return functools.reduce(DataFrame.unionByName, [
        inference.imports(of_file, entities),
        inference.by_name_pair(named("call"), entities, "calls", 0.8, "calls", True),
        inference.by_name_pair(named("inherit"), entities, "inherits", 1.0, "inherits", False),
        inference.by_name_pair(named("decorator"), entities, "decorates", 0.9, "decorates", False, turned=True),
        inference.by_name_pair(named("exception"), entities, "handles", 0.7, "handles", True),
        inference.same_package(files),
        inference.similar_names(entities),
        inference.shared_dependencies(tokens).drop("shared_import"),
    ])


def index(source: DataFrame, prefix: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(ord, path, content, language) to entities (ord, id, name, type, path, content, language, size) and relationships."""
    entities, facts, uses = extracted(source, prefix)
    return entities.drop("line"), related(entities, facts, uses)


def relationships(spark: SparkSession) -> DataFrame:
    return index(files(spark))[1]
