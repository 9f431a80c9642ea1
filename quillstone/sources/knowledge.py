"""The knowledge base: tables of entities and relationships, kept as Parquet, with JSON for exchange; with vectors where asked for.

A save writes a delta: what was added or removed since, by buckets of the id, with the index of its texts. A version is a file that lists the deltas that count; versions are
numbered, and a number is given once, so of two writers one must try again on top of the other. A save that fails midway leaves the version before it.
Reads merge the deltas by id; a base with a single delta is read as it is. compact() writes such a one, and so does a save once there are more than DELTAS.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding
from ..operators import vectors
from ..operators.scratch import cut, small
from . import grams

ENTITIES = "ord bigint, id string, name string, type string, path string, content string, language string, size bigint, created_at timestamp_ntz, metadata map<string,string>"
RELATIONSHIPS = "ord bigint, id string, source_id string, target_id string, relationship_type string, strength double, metadata map<string,string>"
EMBEDDINGS = "ord bigint, id string, type string, language string, vector array<double>"
FILES = "ord bigint, id string, size bigint, modified double"
FACTS = "ord bigint, id string, path string, kind string, a string, b string, line bigint"
SPOTS = "ord bigint, id string, path string, line bigint"
KINDS = {"text", "graph", "neo4j", "vector", "source"}


BUCKETS, DELTAS, TRIES = 16, 64, 20
TEXTS = ["name", "path", "content"]


class Conflict(RuntimeError):
    """Another writer has taken the number of a version."""


class KnowledgeBase:
    """Entities and relationships at a path. Additions replace earlier rows of the same id but keep their place; what is removed and added again
    gets a new one. In one save removals come first."""

    TABLES = {"entities": ENTITIES, "relationships": RELATIONSHIPS}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.load()

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def load(self) -> None:
        """Take the last version; what was added but not saved is forgotten."""
        names = [x for x in self._names(f"{self.path}/versions") if x.endswith(".json")]
        self.version, self.mark, self.deltas = None, None, []
        if names:
            text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{names[-1]}").collect())
            now = json.loads(text)
            self.version, self.mark, self.deltas = int(names[-1][:-5]), now["mark"], now["deltas"]
        self._added: dict[str, list[DataFrame]] = {}
        self._removed: dict[str, list[DataFrame]] = {}

    def _kept(self, name: str, deltas: list[str] | None = None) -> DataFrame | None:
        """Rows of the deltas with number, bucket, and whether the id was removed (gone) or removed before it was added (fresh)."""
        deltas = self.deltas if deltas is None else deltas
        if not deltas:
            return None
        schema = f"{self.TABLES[name]}, gone boolean, fresh boolean, delta int, run string, bucket int"
        base = f"{self.path}/{name}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{d}" for d in deltas])

    def _fresh_rows(self, name: str, number: int) -> DataFrame | None:
        """What one save would write: the last row of each id that was added, at the place of its first; and the ids removed."""
        value = [c.split()[0] for c in self.TABLES[name].split(", ") if c.split()[0] not in ("ord", "id")]
        added, removed = self._added.get(name, []), self._removed.get(name, [])
        out = None
        if added:
            rows = None
            for i, df in enumerate(added):
                own = df.select("ord", "id", *value).withColumn("step", F.lit(i))
                rows = own if rows is None else rows.unionByName(own)
            order = F.struct("step", "ord")
            out = rows.groupBy("id").agg(F.max_by(F.struct(*value), order).alias("v"), F.min(order).alias("f")).select(F.col("f.ord").alias("ord"), "id", *[F.col(f"v.{c}") for c in value], F.lit(False).alias("gone"))
        if removed:
            ids = removed[0].select("id")
            for df in removed[1:]:
                ids = ids.unionByName(df.select("id"))
            ids = ids.distinct().withColumn("fresh", F.lit(True))
            if out is None:
                out = ids.limit(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) if c.split()[0] != "id" else F.col("id") for c in self.TABLES[name].split(", ")], F.lit(False).alias("gone"))
            met = out.join(ids, "id", "full")
            out = met.select("ord", "id", *value, F.col("gone").isNull().alias("gone"), F.coalesce("fresh", F.lit(False)).alias("fresh"))
        elif out is not None:
            out = out.withColumn("fresh", F.lit(False))
        return None if out is None else out.withColumn("delta", F.lit(number))

    def _merged(self, name: str, rows: DataFrame) -> DataFrame:
        value = [c.split()[0] for c in self.TABLES[name].split(", ") if c.split()[0] not in ("ord", "id")]
        reset = F.max(F.when(F.col("gone") | F.col("fresh"), F.col("delta"))).alias("reset")
        places = F.collect_list(F.when(~F.col("gone"), F.struct("delta", "fresh", "ord"))).alias("places")  # one for each delta at most
        out = rows.groupBy("id").agg(F.max_by(F.struct(*value, "gone"), "delta").alias("v"), reset, places).where("not v.gone")
        own = F.filter("places", lambda p: F.col("reset").isNull() | (p["delta"] > F.col("reset")) | ((p["delta"] == F.col("reset")) & p["fresh"]))
        return out.select(F.array_min(own)["ord"].alias("ord"), "id", *[F.col(f"v.{c}") for c in value])

    def _table(self, name: str, keep=None) -> DataFrame:
        """The rows that count. ``keep``: a condition on id and bucket, which reaches the files."""
        names = [c.split()[0] for c in self.TABLES[name].split(", ")]
        kept, new = self._kept(name), self._fresh_rows(name, (self.version or 0) + 1)
        if keep is not None:
            kept = kept.where(keep) if kept is not None else None
            new = new.withColumn("bucket", self._bucket()).where(keep).drop("bucket") if new is not None else None
        if kept is None and new is None:
            return self.spark.createDataFrame([], self.TABLES[name])
        if new is None and len(self.deltas) == 1:
            return kept.where("not gone").select(*names)
        rows = [x.select(*names, "gone", "fresh", "delta") for x in (kept, new) if x is not None]
        return self._merged(name, rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])).select(*names)

    @staticmethod
    def _bucket():
        return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")

    def put(self, name: str, rows: DataFrame) -> None:
        """Add rows to any of the tables."""
        self._added.setdefault(name, []).append(rows)

    def take(self, name: str, ids: DataFrame) -> None:
        """Remove ids (id) from any of the tables."""
        self._removed.setdefault(name, []).append(ids)

    @property
    def entities(self) -> DataFrame:
        return self._table("entities")

    @property
    def relationships(self) -> DataFrame:
        return self._table("relationships")

    def get(self, entity_id: str) -> DataFrame:
        """The entity of that id; only its bucket is read."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(entity_id)), F.lit(BUCKETS)).alias("b")).first().b
        return self._table("entities", (F.col("bucket") == bucket) & (F.col("id") == entity_id))

    def add(self, entities: DataFrame | None = None, relationships: DataFrame | None = None) -> None:
        for name, df in (("entities", entities), ("relationships", relationships)):
            if df is not None:
                self._added.setdefault(name, []).append(df)

    def remove(self, entities: DataFrame | None = None, relationships: DataFrame | None = None) -> None:
        """Remove the ids of either table; relationships of removed entities stay unless they are named."""
        if self._added:
            self.save()
        for name, df in (("entities", entities), ("relationships", relationships)):
            if df is not None:
                self._removed.setdefault(name, []).append(df)

    def _write(self, name: str, rows: DataFrame, delta: str) -> None:
        rows.drop("delta").withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{self.path}/{name}/{delta}")

    def _publish(self, number: int, deltas: list[str], mark: str | None) -> None:
        """Make a version; the rename fails if its number is taken."""
        new, fs = self._at(f"{self.path}/versions/.{uuid.uuid4().hex}")
        fs.mkdirs(new.getParent())
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"deltas": deltas, "mark": mark}), "utf-8"))
        out.close()
        to, _ = self._at(f"{self.path}/versions/{number:09d}.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(to), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(to):
                raise Conflict(f"version {number} is another writer's") from e
            raise

    def save(self, mark: str | None = None) -> None:
        """Write what was added and removed as a delta, and make it count. ``mark`` goes with it, for callers that must not do a thing twice. If another
        writer was first, the same delta goes on top of theirs."""
        rows = {name: self._fresh_rows(name, 0) for name in self.TABLES}
        run = uuid.uuid4().hex
        for _ in range(TRIES):
            number = (self.version or 0) + 1
            delta = f"delta={number}/run={run}"
            for name, own in rows.items():
                self._write(name, own if own is not None else self._none(name), delta)
            if rows["entities"] is not None:
                texts = self.spark.read.schema(f"{ENTITIES}, bucket int").parquet(f"{self.path}/entities/{delta}")
                grams.write(grams.postings(texts, "id", TEXTS), f"{self.path}/grams/{delta}")
            try:
                self._publish(number, [*self.deltas, delta], mark or self.mark)
                break
            except Conflict:
                self.load()  # their deltas come before this one
        else:
            raise Conflict(f"no version after {TRIES} tries")
        self.load()
        if len(self.deltas) > DELTAS:
            self.compact()

    def _none(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], f"{self.TABLES[name]}, gone boolean, fresh boolean, delta int")

    def compact(self) -> None:
        """Write the rows that count as one delta. The deltas before stay until the next compaction, as others may still read them."""
        number, run, before = (self.version or 0) + 1, uuid.uuid4().hex, list(self.deltas)
        delta = f"delta={number}/run={run}"
        for name in self.TABLES:
            self._write(name, self._table(name).withColumns({"gone": F.lit(False), "fresh": F.lit(False), "delta": F.lit(number)}), delta)
        texts = self.spark.read.schema(f"{ENTITIES}, bucket int").parquet(f"{self.path}/entities/{delta}")
        grams.write(grams.postings(texts, "id", TEXTS), f"{self.path}/grams/{delta}")
        self._publish(number, [delta], self.mark)
        keep = {delta, *before}
        for name in [*self.TABLES, "grams"]:
            for d in self._names(f"{self.path}/{name}"):
                for r in self._names(f"{self.path}/{name}/{d}"):
                    if f"{d}/{r}" not in keep and d.startswith("delta=") and int(d[6:]) < number:
                        p, fs = self._at(f"{self.path}/{name}/{d}/{r}")
                        fs.delete(p, True)
        self.load()

    def clear(self) -> None:
        for name in [*self.TABLES, "grams", "versions"]:
            p, fs = self._at(f"{self.path}/{name}")
            fs.delete(p, True)
        self.load()

    def export_json(self, path: str) -> None:
        self.entities.write.mode("overwrite").json(f"{path}/entities")
        self.relationships.write.mode("overwrite").json(f"{path}/relationships")

    def search(self, text: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
        """Entities whose name, path or content contains ``text``, whatever the case, in order; by the index of what is saved."""
        out = self._matching(text)
        out = (out.where(F.col("type") == kind) if kind else out).orderBy("ord", "id")
        return out.limit(limit) if limit else out

    def _matching(self, text: str) -> DataFrame:
        near = None if self._added or self._removed or not text or not self.deltas else self._near(text.lower())
        return matching(self.entities if near is None else near, text)

    def _near(self, low: str) -> DataFrame | None:
        """Entities that may contain ``low``, from the buckets that hold one."""
        paths = [f"{self.path}/grams/{d}" for d in self.deltas if self._names(f"{self.path}/grams/{d}")]
        if not paths:
            return None
        index = self.spark.read.schema(f"{grams.POSTINGS}, delta int, run string, bucket int").option("basePath", f"{self.path}/grams").parquet(*paths)
        rows = cut(grams.candidates(index, low).withColumn("b", F.pmod("row", F.lit(BUCKETS)).cast("int")), "candidates")
        buckets = [r.b for r in rows.select("b").distinct().collect()]  # BUCKETS at most
        names = [c.split()[0] for c in ENTITIES.split(", ")]
        kept = self._kept("entities").where(F.col("bucket").isin(buckets))
        kept = kept.join(small(rows).select("row"), F.xxhash64("id") == F.col("row"), "left_semi")
        return kept.where("not gone").select(*names) if len(self.deltas) == 1 else self._merged("entities", kept.select(*names, "gone", "fresh", "delta")).select(*names)

    def statistics(self) -> DataFrame:
        """(kind, name, n): totals, entities by type, relationships by type."""
        return statistics(self.entities, self.relationships)


class GraphKnowledgeBase(KnowledgeBase):
    """The same tables; search is limited and a type holds for matches of the content only, as graph stores of this kind answer."""

    def search(self, text: str, kind: str | None = None, limit: int | None = 50) -> DataFrame:
        low, own = F.lit(text.lower()), F.col("type") == kind if kind else F.lit(True)
        hit = F.contains(F.lower("name"), low) | F.contains(F.lower("path"), low) | (F.contains(F.lower("content"), low) & own)
        out = self._matching(text).where(hit).orderBy("ord", "id")
        return out.limit(limit) if limit else out


class VectorKnowledgeBase(KnowledgeBase):
    """Entities get a vector when they are added; search is by meaning, as far as the embedding has one."""

    TABLES = KnowledgeBase.TABLES | {"embeddings": EMBEDDINGS}

    @property
    def embeddings(self) -> DataFrame:
        return self._table("embeddings")

    def add(self, entities: DataFrame | None = None, relationships: DataFrame | None = None) -> None:
        super().add(entities, relationships)
        if entities is not None:
            self._added.setdefault("embeddings", []).append(embedded(entities))

    def remove(self, entities: DataFrame | None = None, relationships: DataFrame | None = None) -> None:
        super().remove(entities, relationships)
        if entities is not None:
            self._removed.setdefault("embeddings", []).append(entities.select("id"))

    def search(self, text: str, kind: str | None = None, limit: int | None = 10) -> DataFrame:
        """The entities nearest to ``text`` with their score; for a blank text the first of the type, if one is given, else none."""
        limit = limit or 10
        if not text.strip():
            return self.entities.where(F.col("type") == kind if kind else F.lit(False)).orderBy("ord", "id").limit(limit)
        near = vectors.nearest(self.embeddings, vectors.query_vector(self.spark, text), limit, keep=F.col("type") == kind if kind else None)
        return self.entities.join(F.broadcast(near.select("id", "score")), "id").orderBy(F.desc("score"), "id")

    def similar(self, entity_id: str, limit: int = 5) -> DataFrame:
        """(id, score) of the entities nearest to one of them; nothing if it has no vector."""
        own = self.embeddings.where(F.col("id") == entity_id).select(F.col("vector").alias("q"))
        return vectors.nearest(self.embeddings, own, limit, keep=F.col("id") != entity_id).select("id", "score")


class SourceKnowledgeBase(KnowledgeBase):
    """With what a repository was indexed from: its files as they were seen, and the facts and tokens of each, so that a later run reads changed files only."""

    TABLES = KnowledgeBase.TABLES | {"files": FILES, "facts": FACTS, "spots": SPOTS}

    @property
    def files(self) -> DataFrame:
        return self._table("files")

    @property
    def facts(self) -> DataFrame:
        return self._table("facts")

    @property
    def spots(self) -> DataFrame:
        return self._table("spots")


def matching(entities: DataFrame, text: str) -> DataFrame:
    """Entities whose name, path or content contains ``text``, whatever the case."""
    low = F.lit(text.lower())
    return entities.where(F.contains(F.lower("name"), low) | F.contains(F.lower("path"), low) | F.contains(F.lower("content"), low))


def embedded(entities: DataFrame) -> DataFrame:
    """(ord, id, type, language, vector) of entities."""
    text = embedding.entity_text(*[F.coalesce(F.col(c), F.lit("")) for c in ("type", "name", "language", "path", "content")], F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return entities.select("ord", "id", "type", "language", embedding.hash_embedding(text).alias("vector"))


def statistics(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    one = entities.groupBy("type").count().select(F.lit("entity_type").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n"))
    two = relationships.groupBy("relationship_type").count().select(F.lit("relationship_type").alias("kind"), F.col("relationship_type").alias("name"), F.col("count").alias("n"))
    all_ = one.unionByName(two)
    totals = all_.groupBy("kind").agg(F.sum("n").alias("n")).select(F.lit("total").alias("kind"), F.col("kind").alias("name"), "n")
    return all_.unionByName(totals)


def create(spark: SparkSession, kind: str, path: str) -> KnowledgeBase:
    """The graph store is kept in the same tables as the others; an unknown kind is an error."""
    if kind not in KINDS:
        raise ValueError(f"unsupported knowledge base: {kind}")
    return {"vector": VectorKnowledgeBase, "source": SourceKnowledgeBase, "graph": GraphKnowledgeBase, "neo4j": GraphKnowledgeBase}.get(kind, KnowledgeBase)(spark, path)
