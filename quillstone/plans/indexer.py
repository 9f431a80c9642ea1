"""Index a repository: read it, rank its files, extract entities, infer relationships, keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph
from ..operators.scratch import scope
from ..sources import repo
from ..sources.knowledge import KnowledgeBase, SourceKnowledgeBase, create
from .config import Config
from .repository import CONFIG, EXTENSIONS, IMPORTANT
from .samples import STRIDE, extracted, index, related

STUBS = {"plan_act", "sense_act"}


def ranked(files: DataFrame) -> DataFrame:
    """Files that are important, configure something, or hold code, by rank and path; the 20 first important ones rank 0."""
    low = F.lower("path")
    important = files.where(T.any_of(low, IMPORTANT)).orderBy("path").limit(20).select("path", F.lit(0).alias("r0"))
    rank = F.when(T.any_of(low, CONFIG), 1)
    for i, e in enumerate(EXTENSIONS):
        rank = rank.when(F.col("extension") == e, i + 2)
    return files.join(F.broadcast(important), "path", "left").withColumn("rank", F.coalesce("r0", rank)).where("rank is not null").drop("r0")


def repository_list(spark: SparkSession, path: str) -> DataFrame:
    """(repository): the lines of a text file that aren't blank or comments."""
    lines = spark.read.text(path).select("value", T.strip(F.col("value")).alias("repository"))
    return lines.where((F.col("repository") != "") & ~F.startswith("value", F.lit("#"))).select("repository")


def index_batch(spark: SparkSession, paths: list[str], root: str, config: Config | None = None, kind: str = "text") -> DataFrame:
    """Index repositories one after the other, each by all tasks, into a knowledge base below ``root``: (repository, status, files, entities,
    relationships, error). One that fails is a row and doesn't stop the others."""
    done = []
    for i, path in enumerate(paths):
        try:
            made = index_repository(spark, path, create(spark, kind, f"{root.rstrip('/')}/{i}"), config)
            done.append((path, "ok", made["files"], made["entities"], made["relationships"], "; ".join(made["errors"]) or None))
        except Exception as e:  # noqa: BLE001  whatever it is, it is said
            done.append((path, "failed", 0, 0, 0, str(e)))
    return spark.createDataFrame(done, "repository string, status string, files long, entities long, relationships long, error string")


def batch_totals(done: DataFrame) -> DataFrame:
    """One row: total_repos, successful, failed."""
    return done.agg(F.count(F.lit(1)).alias("total_repos"), F.count_if(F.col("status") == "ok").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"))


def _chosen(spark: SparkSession, path: str, config: Config) -> tuple[DataFrame, list[str]]:
    """(path, ord, extension, size, modified_time) of the files to index, of which none is opened, and how many files the limits of ``config`` left out."""
    repo.register(spark)
    listed = (
        spark.read.format("repository").option("path", path).option("content", "false").option("excludedDirs", ",".join(config.excluded_dirs))
        .option("excludedExtensions", ",".join(config.excluded_extensions)).load().where("not is_directory")
    )
    listed, errors = listed.select("path", "size", "extension", "modified_time"), []
    if config.max_file_size is not None:
        large = F.col("size") > config.max_file_size
        over, listed = listed.where(large).count(), listed.where(~large)
        if over:
            errors.append(f"{over} files over max_file_size ({config.max_file_size} bytes) left out")
    # numbers go by one task, over paths and not texts
    chosen = ranked(listed).select("path", (F.row_number().over(Window.orderBy("rank", "path")) - 1).cast("bigint").alias("ord"), "extension", "size", "modified_time")
    if config.max_exploration_depth is not None:
        most = config.max_exploration_depth * 10
        over = chosen.count() - most
        if over > 0:
            errors.append(f"{over} files beyond the first {most} (max_exploration_depth) left out")
        chosen = chosen.where(F.col("ord") < most)
    return graph.cut(chosen, "chosen"), errors


def index_changes(spark: SparkSession, path: str, kb: SourceKnowledgeBase, config: Config | None = None) -> dict:
    """Index what has changed in a repository since the last run on ``kb``: files that are new or differ in size or time are opened, others are not; what was found in
    files that changed or are gone goes. Relationships are joined anew from the facts of all files, and their differences are kept, so the base ends as one that was
    made at once, but for the places (ord) of what came first. Counts of files opened and gone, of entities and relationships, and errors."""
    config = config or Config()
    config.validate()
    with scope():
        chosen, errors = _chosen(spark, path, config)
        known = graph.cut(kb.files.select(F.col("id").alias("path"), F.col("size").alias("was_size"), F.col("modified").alias("was_modified")), "known")
        same = (F.col("was_size") == F.col("size")) & (F.col("was_modified") == F.col("modified_time"))
        changed = graph.cut(chosen.join(known, "path", "left").where(F.coalesce(~same, F.lit(True))).drop("was_size", "was_modified"), "changed")
        gone = graph.cut(known.join(chosen, "path", "left_anti").select("path"), "gone")
        stale = graph.cut(gone.unionByName(changed.select("path")), "stale")
        texts = repo.contents(changed, path).withColumn("language", T.lookup(T.INDEX_LANGUAGES, F.lower("extension"), "unknown"))
        entities, facts, uses = extracted(graph.cut(texts.select("ord", "path", "content", "language"), "texts"), config.prefix)
        tokens = uses.select("path", F.lit("uses").alias("kind"), F.col("token").alias("a"), F.lit("").alias("b"), F.col("nth").cast("bigint").alias("line"))
        nth = Window.partitionBy("path").orderBy("kind", "line", "a", "b")
        new = facts.unionByName(tokens).withColumn("n", F.row_number().over(nth))
        none = F.create_map().cast("map<string,string>")
        ids = lambda table, column: table.join(stale.withColumnRenamed("path", "at"), F.col(column) == F.col("at"), "left_semi").select("id")
        for name, column in (("entities", "path"), ("spots", "path"), ("facts", "path"), ("files", "id")):
            kb.take(name, graph.cut(ids(kb._table(name), column), "old"))
        kb.put("entities", entities.drop("line").withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("metadata", none))
        kb.put("spots", entities.select("ord", "id", "path", "line"))
        kb.put("facts", new.select(F.col("n").cast("bigint").alias("ord"), F.md5(F.concat_ws(":", "path", "n")).alias("id"), "path", "kind", "a", "b", "line"))
        kb.put("files", changed.select("ord", F.col("path").alias("id"), "size", F.col("modified_time").alias("modified")))
        kb.save()
        placed = kb.spots.join(chosen.select("path", F.col("ord").alias("file")), "path").select("id", (F.col("file") * STRIDE + F.col("line")).alias("ord"))
        all_ = graph.cut(kb.entities.drop("ord").join(placed, "id").select("ord", "id", "name", "type", "path"), "all")
        said = graph.cut(kb.facts, "said")
        plain = said.where("kind <> 'uses'").select("path", "kind", "a", "b", "line")
        edges = graph.cut(related(all_, plain, said.where("kind = 'uses'").select("path", F.col("a").alias("token"))).dropDuplicates(["id"]), "edges")
        before = graph.cut(kb.relationships.select("id", "strength"), "before")
        kb.take("relationships", graph.cut(before.join(edges.select("id"), "id", "left_anti").select("id"), "lost"))
        kb.put("relationships", edges.join(before, ["id", "strength"], "left_anti").withColumn("ord", F.xxhash64("id")).withColumn("metadata", none))
        kb.save()
        return {"files": changed.count(), "gone": gone.count(), "entities": kb.entities.count(), "relationships": kb.relationships.count(), "errors": errors}


def index_repository(spark: SparkSession, path: str, kb: KnowledgeBase, config: Config | None = None) -> dict:
    """Counts of what was indexed, and as errors how many files the limits of ``config`` left out; the strategies that plan are not implemented and say so."""
    config = config or Config()
    config.validate()
    if config.exploration_strategy in STUBS:
        return {"files": 0, "entities": 0, "relationships": 0, "errors": [f"{config.exploration_strategy} is not implemented for indexing"]}
    with scope():
        chosen, errors = _chosen(spark, path, config)
        chosen = repo.contents(chosen, path).withColumn("language", T.lookup(T.INDEX_LANGUAGES, F.lower("extension"), "unknown"))
        source = graph.cut(chosen.select("ord", "path", "content", "language"))  # the tree is read once
        entities, edges = index(source, config.prefix)
        none = F.create_map().cast("map<string,string>")
        kb.add(entities.withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn("metadata", none), edges.withColumn("ord", F.xxhash64("id")).withColumn("metadata", none))
        kb.save()
    return {"files": kb.entities.where("type = 'file'").count(), "entities": kb.entities.count(), "relationships": kb.relationships.count(), "errors": errors}
