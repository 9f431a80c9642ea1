"""Exact search of many phrases in many texts.

Of each distinct phrase KEY characters from its middle are looked for, and the whole phrase where they stand. Phrases go in blocks, of BLOCK_BYTES of such keys and PHRASE_BYTES of text at
most, each an automaton (Aho-Corasick) of its keys that runs once over every text, so the time of a block is that of reading the texts and does not grow with its phrases; only hits leave a task.

Edge cases: case is ignored; null texts and null or empty phrases match nothing; phrases that repeat are searched once and meet all their
owners; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BLOCK_BYTES, PHRASE_BYTES = 4 << 20, 32 << 20
KEY = 12


def _key(phrase: str) -> str:
    at = max(0, (len(phrase) - KEY) // 2)
    return phrase[at : at + KEY]


def _found(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        owners: dict[str, list[str]] = {}
        for p in shipped.value:
            owners.setdefault(_key(p), []).append(p)
        keys = ahocorasick.Automaton()
        for k, own in owners.items():
            keys.add_word(k, own)
        keys.make_automaton()
        for b in batches:
            rows, hits = [], []
            for i, text in enumerate(b.column(0).to_pylist()):
                near = {id(x): x for _, x in keys.iter(text)} if text else {}
                own = {p for x in near.values() for p in x if p in text}
                rows += [i] * len(own)
                hits += sorted(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[1:]), pa.array(hits, pa.string())], [*b.schema.names[1:], "phrase"])

    return run


def matches(questions: DataFrame, texts: DataFrame, text_col: str, keep: list[str], id_col: str = "conv_id", phrase_col: str = "question") -> DataFrame:
    """(id, ``keep``): the rows of ``texts`` that hold each whole phrase."""
    spark = texts.sparkSession
    low = F.lower(phrase_col)
    asked = questions.where(F.length(phrase_col) > 0).select(id_col, low.alias("phrase"))
    own = asked.select("phrase").distinct()
    size = own.agg(F.sum(F.octet_length("phrase")), F.sum(F.least(F.octet_length("phrase"), F.lit(4 * KEY)))).first()
    blocks = max(1, -(-(size[0] or 0) // PHRASE_BYTES), -(-(size[1] or 0) // (4 * BLOCK_BYTES)))
    rows = texts.select(F.lower(text_col).alias("text"), *keep)
    schema = StructType([*rows.schema.fields[1:], StructField("phrase", StringType())])
    found = None
    for part in range(blocks):
        block = [r.phrase for r in own.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == part).collect()]  # some PHRASE_BYTES at most
        if block:
            hit = rows.mapInArrow(_found(spark.sparkContext.broadcast(block)), schema)
            found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.join(asked, "phrase").select(id_col, *keep)
