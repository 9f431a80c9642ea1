"""Tables written on the way, in the folder that driver and executors share, and what bounds the batches of Python tasks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is known to have at most so many bytes as written.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch where the session sets none.
BATCH_BYTES = 4 << 20
_open: list[list[DataFrame]] = []


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a folder of this process if all tasks run in it, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillstone"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and go on from what was written, which ends its lineage."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for held in _open:
        held.append(out)
    return out


def _at(df: DataFrame):
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Delete the files of a cut() that nothing reads any more."""
    p, fs = _at(df)
    fs.delete(p, True)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """What cut() writes inside goes at the end: for work whose result has been written or collected by then."""
    held: list[DataFrame] = []
    _open.append(held)
    try:
        yield
    finally:
        _open.remove(held)
        for df in held:
            drop(df)


def small(df: DataFrame) -> DataFrame:
    """Mark a cut() table for broadcast if its measured size allows; else leave the join to a shuffle."""
    p, fs = _at(df)
    return F.broadcast(df) if fs.getContentSummary(p).getLength() <= BROADCAST_BYTES else df


def bounded(df: DataFrame) -> DataFrame:
    """``df``, of which batches that go to Python are bounded by bytes from now on, so that large files don't add up in a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def compact(df: DataFrame) -> DataFrame:
    """``df``, of whose many rows much repeats: tables that the session writes from now on are compressed by zstd, where it sets no codec."""
    key = "spark.sql.parquet.compression.codec"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, "zstd")
    return df
