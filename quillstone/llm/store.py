"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side is broadcast only when it is known to have at most so many rows of a few bytes each.
BROADCAST_ROWS = 500_000
#: ... or, for rows of any width, at most so many bytes as written.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch where the session sets none; a batch is held several times over on its way, in each task.
BATCH_BYTES = 4 << 20
#: Shuffle files go once the table that was made from them is written: nothing reads them again.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder of this process if all tasks run in it, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillstone"


def place(spark: SparkSession, name: str) -> str:
    """A path nobody else uses."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def packed(df: DataFrame):
    """All columns of ``df`` in one struct, whatever their names."""
    return F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.lit(0).alias("one"))


def unpacked(df: DataFrame, names: list[str], row: str = "row") -> DataFrame:
    """The columns of a packed() row again."""
    return df.select(*[F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(names)])


def named(name: str):
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from what was written."""
    conf, path = df.sparkSession.conf, place(df.sparkSession, name)
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def mapped(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches bounded by bytes, so that long texts don't widen what a task holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def drop(df: DataFrame) -> None:
    """Delete the files of a cut() that nothing reads any more."""
    p, fs = _at(df.sparkSession, df._cut_path)
    fs.delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a cut()."""
    p, fs = _at(df.sparkSession, df._cut_path)
    return fs.getContentSummary(p).getLength()


def small(df: DataFrame) -> DataFrame:
    """Mark a cut() table for broadcast if its measured size allows; else leave the join to a shuffle."""
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES else df


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(id, text) as columns ``uid``, ``text`` and, if ids repeat or are null, ``id``; True if the ids serve as they are.

    Ids that are null or on several rows can't tell rows apart. Then rows are numbered in the order of (id, text),
    nulls first, and the numbering is written so that every later read agrees. Null texts become empty.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ids = docs.select(F.col(id_col).cast("bigint").alias("uid"), text)
    rows, distinct = ids.agg(F.count(F.lit(1)), F.count_distinct("uid")).first()
    if rows == distinct:
        return ids, True
    numbered = ids.orderBy("uid", "text").withColumnRenamed("uid", "id").withColumn("uid", F.monotonically_increasing_id())
    return cut(numbered.select("uid", "id", "text"), "numbered"), False
