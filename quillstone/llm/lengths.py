"""Token counts by an exact length histogram.

Documents are encoded and only their lengths leave the encoder; lengths are counted with a partial count before the shuffle.
The histogram has one row per distinct length, so its size follows the longest document and not their number; suffix
sums over it, longest first, answer totals, quantiles and truncated totals for every context limit without another look at
the documents.

Edge cases: null and empty texts have length 0; a very long text is encoded whole, but for runs of RUN white-space characters or more, which the
encoder's pattern would overflow on: they are cut out where the pattern ends a piece, and encoded as the one piece that they are; repeated rows
and ids count each; an empty table gives an empty histogram; other columns aren't read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .store import mapped

RUN = 1_000
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)  # Unicode's White_Space


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(encoding, text: str) -> int:
    """Tokens of a text. A run of white space before other text leaves its last character to what follows; the rest is one piece."""
    n = at = 0
    for run in _BLANK.finditer(text) if len(text) >= RUN else ():
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for b in batches:
            n = np.array([count(encoding, t) if t else 0 for t in flat.column(b, "text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([flat.column(b, "id"), pa.array(n)], ["id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of each row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return mapped(rows, _lengths(path), "id long, n_tokens long").withColumnRenamed("id", id_col)


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs)."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram: documents and tokens of at least and beyond L, all documents and tokens, tokens that remain
    when every document is cut to L, and the share of documents of at most L."""
    longest_first = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = hist.select(
        "n_tokens", "n_docs",
        F.sum("n_docs").over(longest_first).alias("docs_from"), F.sum(tokens).over(longest_first).alias("tokens_from"),
        F.sum("n_docs").over(everything).alias("docs_total"), F.sum(tokens).over(everything).alias("tokens_total"),
    )
    beyond = F.col("docs_from") - F.col("n_docs")
    return out.withColumns({
        "docs_cut": beyond,
        "tokens_kept": F.col("tokens_total") - F.col("tokens_from") + tokens + beyond * F.col("n_tokens"),
        "share_within": 1 - beyond / F.col("docs_total"),
    })


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Documents cut and tokens kept at each of ``limits``: with the least length of at least the limit, or no cut beyond the longest."""
    spark = sums.sparkSession
    ask = spark.createDataFrame([(x,) for x in limits], "context_limit long")
    near = ask.join(sums, F.col("n_tokens") >= F.col("context_limit"), "left").groupBy("context_limit").agg(F.min_by(F.struct("docs_from", "docs_cut", "tokens_from", "n_tokens"), "n_tokens").alias("x"))
    total = sums.agg(F.max("tokens_total").alias("all"))
    over = F.coalesce(F.col("x.docs_from"), F.lit(0))
    return near.join(F.broadcast(total)).select(
        "context_limit", F.when(F.col("x.n_tokens") == F.col("context_limit"), F.col("x.docs_cut")).otherwise(over).alias("docs_cut"),
        (F.coalesce(F.col("all"), F.lit(0)) - F.coalesce(F.col("x.tokens_from"), F.lit(0)) + over * F.col("context_limit")).alias("tokens_kept"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least so large a share of the documents stays within."""
    ask = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return ask.join(sums, F.col("share_within") >= F.col("share"), "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
