"""Nearest vectors by inner product, exact. Rows have an id, any further columns, and a vector as an array of numbers.

One query vector is a one-row side that travels to the vectors. A set of queries meets the vectors by cells.

Edge cases: scores are rounded to 5 digits and ties go by id; null vectors are no result and no query; a query never finds itself by id;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import embedding
from .cells import DIGITS, Cells


def scored(rows: DataFrame, query: DataFrame, vector: str = "vector") -> DataFrame:
    """``rows`` with their score against the one row of ``query`` (q)."""
    return rows.where(F.col(vector).isNotNull()).join(F.broadcast(query.limit(1))).withColumn("score", F.round(embedding.dot(F.col(vector), F.col("q")), DIGITS)).drop("q")


def query_vector(spark, text: str) -> DataFrame:
    """(q): the embedding of a search text."""
    return spark.range(1).select(embedding.hash_embedding(F.lit(text)).alias("q"))


def nearest(rows: DataFrame, query: DataFrame, k: int, id_col: str = "id", vector: str = "vector", keep: Column | None = None) -> DataFrame:
    """The ``k`` rows of highest score; ``keep``: a condition that comes first."""
    return scored(rows if keep is None else rows.where(keep), query, vector).orderBy(F.desc("score"), id_col).limit(k)


def nearest_of_each(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best of ``rows`` for each of ``queries``, whole-number ids, exact, by cells. With all rows as queries the work may grow to
    the square of their number; what moves is k rows a query and share of a cell."""
    return Cells(rows, id_col, vector).search(queries, k, id_col, vector)
