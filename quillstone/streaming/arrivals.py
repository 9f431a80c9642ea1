"""Beyond batch: files that arrive are upserted into a knowledge base, and trace statistics by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.knowledge import KnowledgeBase


def index_arrivals(spark: SparkSession, folder: str, schema: str, kb: KnowledgeBase, checkpoint: str):
    """Take entity rows (Parquet, of ``schema``) that arrive in ``folder`` into ``kb``, all that is there now. Returns the ended query."""

    def take(batch: DataFrame, number: int) -> None:
        kb.load()
        mark = f"{checkpoint}#{number}"
        if kb.mark != mark:  # else it was saved before the run broke off
            kb.add(batch)
            kb.save(mark)

    query = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_traces(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and failures by window of event time; the state of a window goes once it is ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("failures"))
