"""The deterministic text embedding and vector arithmetic, on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASHED, DIM = 96, 384


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """96 values from md5 digests of text_0, text_1, ..., of unit length, then zeros up to ``dim``."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(HASHED - 1)), lambda i: F.conv(F.substring(F.md5(F.concat(text, F.lit("_"), i.cast("string"))), 1, 8), 16, 10).cast("double"))
    return F.concat(unit(raw), F.array_repeat(F.lit(0.0), dim - HASHED))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """Scaled to length 1; the array and its length are bound once by one-element arrays."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scaled = lambda v: F.transform(F.array(length(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))[0]
    return F.transform(F.array(a), scaled)[0]


def entity_text(kind: Column, name: Column, language: Column, path: Column, content: Column, metadata: Column) -> Column:
    """What of an entity is embedded; metadata in key order."""
    pairs = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    head = [F.concat(F.lit(label), col) for label, col in (("Type: ", kind), ("Name: ", name), ("Language: ", language), ("Path: ", path), ("Content: ", F.substring(content, 1, 500)))]
    return F.concat_ws(" ", *head, F.concat_ws(" ", pairs))
