"""Exact deduplication by a stateful stream; DataFrame operations only.

Documents are appended to a content table in the shared folder: SHA-256 of the text, its length in bytes, stable id, the text, and where the row is kept, its locator: the batch it came in,
the task that wrote it (a folder of its own) and its place there. A streaming aggregation without watermark reads the fingerprints, not the texts: its keyed
state, one row per distinct (digest, length), never expires, lives in RocksDB on the executors' disks and is checkpointed to the shared folder. A state row holds the count, the
largest stable id with its locator, and the locator of the first row that came. Counts, maxima and minima are combined before the shuffle, so a digest on a
third of all rows costs one row a task. Further batches can be appended and are processed by the same state.

On hits (digests with several rows) process() fetches the content of the first row by its locator, from the folders that hold one, and compares its full bytes with those of
each row of the new batches; earlier rows have been compared before. Digests of which bytes differ are kept, and their rows are told apart by their texts.

Edge cases: null text counts as empty; of equal texts the row with the largest id stays, null ids last; rows that
repeat an id and a text are told apart by their locator, one of them stays (last_stay: the one whose other columns are
greatest as JSON); ids are whole numbers; very long texts are compared whole; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, cut, packed, place, small, unpacked

MARKS = "digest string, n_bytes long, id long, locator long, batch int, task int"
CHUNK = 256  # copies that are compared with one copy of the first text
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # an open store holds preallocated files and buffers
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class ExactDedup:
    """Deduplicates documents that arrive in batches. One content table and one state in the shared folder; one writer at a time."""

    def __init__(self, spark, root: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.root = root or place(spark, "exact")

    def _names(self, folder: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _batches(self) -> int:
        return sum(x.startswith("batch=") for x in self._names("content"))

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add ``docs`` as a batch."""
        rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("locator"))
        rows = rows.select(self.digest(F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"), "id", "locator", "text", F.shiftright("locator", 33).cast("int").alias("task"))
        before = self.spark.conf.get(WRITERS, None)
        self.spark.conf.set(WRITERS, "2")  # a task has one folder, so its rows needn't be sorted
        try:
            rows.write.partitionBy("task").parquet(f"{self.root}/content/batch={self._batches()}")
        finally:
            self.spark.conf.unset(WRITERS) if before is None else self.spark.conf.set(WRITERS, before)

    def content(self) -> DataFrame:
        return self.spark.read.schema(f"{MARKS}, text string").parquet(f"{self.root}/content")

    def process(self) -> None:
        """Take what is new into the state, and compare bytes on hits."""
        upto, done = self._batches(), max([0, *(int(x[5:]) for x in self._names("odd") if x.startswith("upto="))])
        before = {k: self.spark.conf.get(k, None) for k in CONF}
        try:
            for k, v in CONF.items():
                self.spark.conf.set(k, v)
            marks = self.spark.readStream.schema(MARKS).parquet(f"{self.root}/content")
            first, stays = F.min(F.struct("batch", "locator")).alias("first"), F.max(F.struct("id", "batch", "locator")).alias("stays")
            keyed = marks.groupBy("digest", "n_bytes").agg(stays, first, F.count(F.lit(1)).alias("group_size"))
            query = keyed.writeStream.outputMode("update").foreachBatch(lambda df, _: self._compare(df, done, upto)).option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _compare(self, updated: DataFrame, done: int, upto: int) -> None:
        """Write the digests of ``updated`` of which a new row's bytes are not those of the first row."""
        hits = updated.where("group_size > 1").select("digest", "n_bytes", F.col("first.batch").alias("at_batch"), F.col("first.locator").alias("at"), F.shiftright("first.locator", 33).cast("int").alias("at_task"), "group_size")
        hits = cut(hits.withColumn("chunks", F.ceil(F.col("group_size") / CHUNK).cast("int")).drop("group_size"), "hits")
        near = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
        is_first = (F.col("batch") == F.col("at_batch")) & (F.col("locator") == F.col("at"))
        new = self.content().where(F.col("batch") >= done).join(near, ["digest", "n_bytes"]).where(~is_first)
        new = new.select("digest", "n_bytes", "text", F.pmod("locator", F.col("chunks")).cast("int").alias("chunk"))
        place_ = near.select(F.col("digest").alias("d"), F.col("at_batch").alias("batch"), F.col("at_task").alias("task"), F.col("at").alias("locator"), "chunks")
        firsts = self.content().join(place_, ["batch", "task", "locator"]).where("digest = d")
        firsts = firsts.select("digest", "n_bytes", F.col("text").alias("first_text"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        odd = new.join(firsts, ["digest", "n_bytes", "chunk"]).where(F.col("text") != F.col("first_text")).select("digest", "n_bytes").distinct()
        odd.write.mode("overwrite").parquet(f"{self.root}/odd/upto={upto}")

    def state(self) -> DataFrame:
        """digest, n_bytes, stay_id, stay_batch, stay_locator, first_batch, first_locator, group_size, as the state holds them."""
        rows = self.spark.read.format("statestore").load(f"{self.root}/state")
        value = [f.name for f in rows.schema["value"].dataType.fields]
        part = lambda i, x: F.col(f"value.{value[i]}.{x}")
        return rows.select(
            "key.digest", "key.n_bytes", part(0, "id").alias("stay_id"), part(0, "batch").alias("stay_batch"), part(0, "locator").alias("stay_locator"),
            part(1, "batch").alias("first_batch"), part(1, "locator").alias("first_locator"), F.col(f"value.{value[2]}").alias("group_size"),
        )

    def decisions(self) -> DataFrame:
        """A row for each row appended: id, batch, locator, digest, n_bytes, keep_id, group_size, kept."""
        marks, key = self.spark.read.schema(MARKS).parquet(f"{self.root}/content"), ["digest", "n_bytes"]
        if not self._names("state/state"):  # nothing has come yet
            return marks.limit(0).select("id", "batch", "locator", *key, F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        odd = cut(self.spark.read.schema("digest string, n_bytes long").option("recursiveFileLookup", "true").parquet(f"{self.root}/odd").distinct(), "odd")
        some = odd.limit(1).count() > 0
        kept = (F.col("batch") == F.col("stay_batch")) & (F.col("locator") == F.col("stay_locator"))
        met = (marks.join(small(odd), key, "left_anti") if some else marks).join(self.state(), key)
        out = met.select("id", "batch", "locator", *key, F.col("stay_id").alias("keep_id"), "group_size", kept.alias("kept"))
        if not some:
            return out
        rows = self.content().join(small(odd), key, "left_semi")
        by_text = rows.groupBy(*key, F.col("text").alias("own")).agg(F.max(F.struct("id", "batch", "locator")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        mine = rows.join(by_text, key).where(F.col("text") == F.col("own"))
        kept = (F.col("batch") == F.col("stays.batch")) & (F.col("locator") == F.col("stays.locator"))
        return out.unionByName(mine.select("id", "batch", "locator", *key, F.col("stays.id").alias("keep_id"), "group_size", kept.alias("kept")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_bytes."""
    one = ExactDedup(docs.sparkSession)
    one.append(docs, id_col, text_col)
    one.process()
    return one.decisions().select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.col("digest").alias("text_sha256"), "n_bytes")


def last_stay(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that deduplicate() drops; of rows alike in id and text the one whose columns are greatest as JSON stays."""
    made = deduplicate(docs, id_col, text_col)
    gone = made.groupBy(id_col, "text_sha256").agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("n")).where("not any_kept or n > 1")
    gone = small(cut(gone.select(F.col(id_col).alias("gone_id"), F.col("text_sha256").alias("gone_sha"), F.col("any_kept").alias("one")), "gone"))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), sha.alias("sha"), packed(docs).alias("row"))
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left")
    repeated = met.where("one").groupBy("gone_id", "gone_sha").agg(F.max_by("row", F.to_json("row")).alias("row"))
    return unpacked(met.where("one is null").select("row").unionByName(repeated.select("row")), docs.columns)
