"""Queries of the extractors and of the edges between code, over source files that Spark writes from the documents.

Each line of a text gives two lines of code, which form depends on its number: names are its first two words. Texts of two languages become Python, the others
JavaScript. So every document is parsed whole, and SQL knows what must come out.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import INDEX_LANGUAGES, base_name, imports, lookup, suffix
from ..operators import extract, inference, project
from ..operators.scratch import cut
from .base import table
from .catalog import query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST_TWO = "^[^A-Za-z]*+([A-Za-z]++)[^A-Za-z]++([A-Za-z]++)"
STRIDE = 1_000_000  # entities of a file follow it in line order
PYTHON = ["import {a}\n{b}()", "from {a} import {b}\npass", "class {a}({b}):\n    def {b}(self): {a}()", "def {a}():\n    if {b}: {b}()", "@{b}\ndef {a}(): raise {b}()"]
SCRIPT = ["import x from '{a}'\n{b}();", "const {a} = require('{b}')\n;", "class {a} {{}}\n;", "function {a}() {{ {b}(); }}\n;", "const {a} = () => {b}()\n;"]


def _filled(form: str, a, b):
    """A form with columns for its names."""
    parts = form.replace("{{", "\x01").replace("}}", "\x02").replace("{a}", "\x00a\x00").replace("{b}", "\x00b\x00").split("\x00")
    return F.concat(*[a if p == "a" else b if p == "b" else F.lit(p.replace("\x01", "{").replace("\x02", "}")) for p in parts if p])


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """(ord, path, content, language) of all documents."""
    docs = table(spark, d, "documents")
    python = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))

    def pair(line):  # looked for once and no further, or else two empty words
        return F.array(*[F.translate(F.regexp_extract(line, FIRST_TWO, k), UPPER, LOWER) for k in (1, 2)])

    def code(words, i):
        a, b = (F.concat(F.lit("w_"), F.get(words, F.lit(k))) for k in (0, 1))
        made = F.when(F.get(words, F.lit(1)) == "", F.when(python, F.lit("pass\npass")).otherwise(F.lit(";\n;")))
        for k in range(5):
            made = made.when(i % 5 == k, F.when(python, _filled(PYTHON[k], a, b)).otherwise(_filled(SCRIPT[k], a, b)))
        return made

    lines = F.transform(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), pair), code)
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit("/"), F.col("doc_id").cast("string"), F.when(python, ".py").otherwise(".js"))
    made = docs.select(F.col("doc_id").alias("ord"), path.alias("path"), F.array_join(lines, "\n").alias("content"))
    return made.withColumn("language", lookup(INDEX_LANGUAGES, F.lower(suffix(F.col("path"))), "unknown"))


# the lines of code by form: python, number i of the text's line, k, names a and b
CODE = f"""
 raw as (select doc_id, coalesce(lang in ('en', 'de'), false) as python, coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/' || doc_id || case when coalesce(lang in ('en', 'de'), false) then '.py' else '.js' end as path,
  string_split(coalesce(text, ''), chr(10)) as ls from documents),
 each as (select doc_id, python, path, generate_subscripts(ls, 1) - 1 as i, regexp_extract_all(translate(unnest(ls), '{UPPER}', '{LOWER}'), '[a-z]+') as ws from raw),
 code as (select doc_id, python, path, i, cast(2 * i + 1 as bigint) as one, cast(2 * i + 2 as bigint) as two, i % 5 as k, 'w_' || ws[1] as a, 'w_' || ws[2] as b from each where len(ws) > 1),
 py as (select * from code where python), js as (select * from code where not python),
 parts as (select path, doc_id, a as name, 'class' as type, 'python' as language, one as line, 'class ' || a || '(' || b || '):' || chr(10) || '    def ' || b || '(self): ' || a || '()' as content from py where k = 2
  union all select path, doc_id, b, 'function', 'python', two, '    def ' || b || '(self): ' || a || '()' from py where k = 2
  union all select path, doc_id, a, 'function', 'python', one, 'def ' || a || '():' || chr(10) || '    if ' || b || ': ' || b || '()' from py where k = 3
  union all select path, doc_id, a, 'function', 'python', two, 'def ' || a || '(): raise ' || b || '()' from py where k = 4
  union all select path, doc_id, a, 'class', 'javascript', one, 'class ' || a || ' {{}}' from js where k = 2
  union all select path, doc_id, a, 'function', 'javascript', one, case k when 3 then 'function ' || a || '() {{ ' || b || '(); }}' else 'const ' || a || ' = () => ' || b || '()' end from js where k in (3, 4)),
 facts as (select path, 'import' as kind, a, '' as b, one as line, 'direct' as detail from py where k = 0
  union all select path, 'call', 'module', b, two, 'function' from py where k = 0
  union all select path, 'import', b, '', one, 'from ' || a from py where k = 1
  union all select path, 'inherit', a, b, one, 'single' from py where k = 2
  union all select path, 'call', b, a, two, 'function' from py where k = 2
  union all select path, 'call', a, b, two, 'function' from py where k in (3, 4)
  union all select path, 'decorator', a, b, two, '' from py where k = 4
  union all select path, 'exception', a, b, two, 'raise' from py where k = 4
  union all select path, 'import', a, '', one, 'direct' from js where k = 0
  union all select path, 'import', b, '', one, 'direct' from js where k = 1
  union all select path, 'call', '', case k when 1 then 'require' else b end, case k when 0 then two else one end, 'function' from js where k in (0, 1, 3, 4)
  union all select path, 'call', '', a, one, 'function' from js where k = 3),
 ents as (select doc_id * {STRIDE} as ord, md5('file:' || path) as id, string_split(path, '/')[-1] as name, path from raw
  union all select min(doc_id * {STRIDE} + line), md5(type || ':' || path || ':' || name), name, path from parts group by type, path, name),
 here as (select path, name, arg_min(id, ord) as id from ents group by path, name), there as (select name, arg_min(id, ord) as id from ents group by name)
"""
_COLUMNS = "id, source_id, target_id, relationship_type, cast(strength as double) as strength"


def _pairs(kind: str, fact: str, strength: float, line: bool, turned: bool = False) -> str:
    s, t = ("y.id", "x.id") if turned else ("x.id", "y.id")
    number = " || '_' || f.line" if line else ""
    return f"select distinct '{kind}_' || {s} || '_' || {t}{number} as id, {s} as source_id, {t} as target_id, '{kind}' as relationship_type, {strength} as strength from facts f join here x on f.path = x.path and f.a = x.name join there y on f.b = y.name where kind = '{fact}'"


EDGES = {
    "imports": "select distinct 'import_' || s || '_' || id as id, s as source_id, id as target_id, 'imports' as relationship_type, 1.0 as strength from (select md5('file:' || path) as s, a from facts where kind = 'import') join there on a = name",
    "calls": _pairs("calls", "call", 0.8, True),
    "inherits": _pairs("inherits", "inherit", 1.0, False),
    "decorates": _pairs("decorates", "decorator", 0.9, False, True),
    "handles": _pairs("handles", "exception", 0.7, True),
}


@query(f"with {CODE} select path, name, type, language, line, content, cast(length(content) as bigint) as size from parts where language = 'python'")
def python_entities(spark, d):
    return extract.entities(code_files(spark, d).where("language = 'python'"))


@query(f"with {CODE} select path, name, type, language, line, content, cast(length(content) as bigint) as size from parts where language = 'javascript'")
def js_entities(spark, d):
    return extract.entities(code_files(spark, d).where("language = 'javascript'"))


@query(f"with {CODE} select path, kind, a, b, line, detail from facts where kind = 'import' and ends_with(path, '.js')")
def js_imports(spark, d):
    return extract.facts(code_files(spark, d).where("language = 'javascript'")).where("kind = 'import'")


@query(f"with {CODE} select path, kind, a, b, line, detail from facts")
def code_facts(spark, d):
    return extract.facts(code_files(spark, d))


@query(f"""with {CODE} select path, row_number() over (partition by path order by i) as nth, a as name from code where k = 0 or (k = 1 and python)""")
def code_imports(spark, d):
    """What the lines of each file import."""
    made = code_files(spark, d).select("path", F.posexplode(imports(F.col("content"), F.col("language"))).alias("at", "name"))
    return made.select("path", (F.col("at") + 1).cast("long").alias("nth"), "name")


_INSPECTED = f"""with {CODE}, sums as (select path, count(*) filter (k = 2) as c, count(*) filter (k in (3, 4) or (k = 2 and python)) as f, count(*) filter (k = 3 and python) as branches from code group by path),
  roots as (select path, string_agg(a, ',' order by i) as needs from (select path, a, min(i) as i from py where k in (0, 1) group by path, a) group by path)
  select path, coalesce(c, 0) as classes, coalesce(f, 0) as functions, cast(2 * coalesce(branches, 0) as bigint) as complexity, cast(case when python then 0 else 2 * len(ls) end as bigint) as line_count,
  coalesce(needs, '') as dependencies, cast(0 as integer) as issues from raw left join sums using (path) left join roots using (path)"""


@query(_INSPECTED)
def inspect_file(spark, d):
    made = extract.inspections(code_files(spark, d))
    return made.withColumns({"dependencies": F.array_join("dependencies", ","), "issues": F.size("issues")})


@query(f"select path, complexity from ({_INSPECTED})")
def complexity(spark, d):
    return extract.inspections(code_files(spark, d)).select("path", "complexity")


@query(f"""with {CODE} select path, 'import' as kind, null as name, one as line, a as module, null as args, null as bases, null as decorators from py where k = 0
  union all select path, 'from_import', b, one, a, null, null, null from py where k = 1
  union all select path, 'class', a, one, null, null, b, '' from py where k = 2 union all select path, 'function', b, two, null, 'self', null, '' from py where k = 2
  union all select path, 'function', a, one, null, '', null, '' from py where k = 3 union all select path, 'function', a, two, null, '', null, b from py where k = 4
  union all select path, 'es6_import', null, one, a, null, null, null from js where k = 0 union all select path, 'commonjs_require', null, one, b, null, null, null from js where k = 1
  union all select path, case k when 2 then 'class' else 'function' end, a, one, null, null, null, null from js where k > 1""")
def inspect_items(spark, d):
    made = extract.items(code_files(spark, d)).drop("alias")
    return made.withColumns({c: F.array_join(c, ",") for c in ("args", "bases", "decorators")})


FACTS_OF = {"imports": "import", "calls": "call", "inherits": "inherit", "decorates": "decorator", "handles": "exception"}


def code_edges(spark: SparkSession, d: str, kinds: list[str]) -> DataFrame:
    """Edges of ``kinds`` between the files, classes and functions of all documents' code."""
    files = cut(code_files(spark, d), "code")
    whole = files.select((F.col("ord") * STRIDE).alias("ord"), F.md5(F.concat(F.lit("file:"), "path")).alias("id"), base_name(F.col("path")).alias("name"), "path")
    parts = extract.entities(files).join(files.select("path", F.col("ord").alias("file_ord")), "path")
    parts = parts.groupBy(F.md5(F.concat_ws(":", "type", "path", "name")).alias("id"), "name", "path").agg(F.min(F.col("file_ord") * STRIDE + F.col("line")).alias("ord"))
    entities = cut(whole.unionByName(parts), "entities")
    facts = cut(extract.facts(files, [FACTS_OF[k] for k in kinds]), "facts")
    named = (cut(inference.first_in_file(entities), "here"), cut(inference.first_by_name(entities), "there")) if kinds != ["imports"] else None
    own = lambda kind: facts.where(F.col("kind") == kind).select("path", "a", "b", "line")
    made = {
        "imports": lambda: inference.imports(own("import").select(F.md5(F.concat(F.lit("file:"), "path")).alias("source_id"), F.col("a").alias("symbol")), entities),
        "calls": lambda: inference.by_name_pair(own("call"), entities, "calls", 0.8, "calls", True, named=named),
        "inherits": lambda: inference.by_name_pair(own("inherit"), entities, "inherits", 1.0, "inherits", False, named=named),
        "decorates": lambda: inference.by_name_pair(own("decorator"), entities, "decorates", 0.9, "decorates", False, turned=True, named=named),
        "handles": lambda: inference.by_name_pair(own("exception"), entities, "handles", 0.7, "handles", True, named=named),
    }
    return functools.reduce(DataFrame.unionByName, [made[k]() for k in kinds])


@query(f"with {CODE} select {_COLUMNS} from ({' union all '.join(EDGES.values())})")
def edges_all(spark, d):
    """Edges that come from facts; those of packages, names and shared imports have queries of their own."""
    return code_edges(spark, d, list(EDGES))


def _of(kind: str):
    def run(spark, d):
        return code_edges(spark, d, [kind])

    run.__name__ = f"edges_{kind}" if kind != "imports" else "edges_code_imports"
    return query(f"with {CODE} select {_COLUMNS} from ({EDGES[kind]})")(run)


for _kind in EDGES:
    _of(_kind)


@query(f"""with {CODE}, c as (select type, lower(name) as low, count(*) as members from parts group by 1, 2)
  select a.type, a.low as a, b.low as b, 1.0 - levenshtein(a.low, b.low) / cast(greatest(length(a.low), length(b.low)) as double) as strength, a.members * b.members as pairs
  from c a join c b on a.type = b.type and (length(a.low) < length(b.low) or (length(a.low) = length(b.low) and a.low < b.low)) and length(a.low) >= 0.69 * length(b.low)
  where 1.0 - levenshtein(a.low, b.low) / cast(greatest(length(a.low), length(b.low)) as double) > 0.7""")
def code_similar_names(spark, d):
    """Names of classes and functions that are alike, with how many pairs of them there are."""
    return inference.similar_classes(extract.entities(code_files(spark, d)))[1]


@query(f"""with {CODE}, s as (select path, count(*) filter (k in (0, 1)) as imports, string_agg(case when k = 2 then b else a end, ',' order by i) filter ((python and k in (2, 3, 4)) or (not python and k = 4)) as functions,
  string_agg(a, ',' order by i) filter (k = 2) as classes from code group by path)
  select path, case when python then 'python' else 'javascript' end as language, cast(2 * len(ls) as bigint) as line_count, coalesce(imports, 0) as imports, coalesce(functions, '') as functions, coalesce(classes, '') as classes,
  cast(0 as bigint) as comment_lines, cast(0 as bigint) as blank_lines from raw left join s using (path)""")
def code_analysis(spark, d):
    """What the analysis of a file finds in each file's code."""
    made = project.file_analysis(code_files(spark, d).drop("language"))
    joined = lambda c: F.array_join(F.col(f"patterns.{c}"), ",").alias(c)
    return made.select("path", "language", "line_count", F.size("patterns.imports").cast("long").alias("imports"), joined("functions"), joined("classes"), "patterns.comment_lines", "patterns.blank_lines")
