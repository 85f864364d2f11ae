"""Embedding of texts by hashed words, for stores without a model; other embedders have the same form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_embedder(dims: int = 256):
    """A column function: text to a unit vector of ``dims`` numbers; null for a null or wordless text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, tuple[int, float]] = {}
        for texts in batches:
            words = [(text or "").lower().split() for text in texts]
            places = []
            for word in (w for own in words for w in own):
                at = seen.get(word)
                if at is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    h = xxhash.xxh3_64_intdigest(word)
                    at = seen[word] = (h % dims, 1.0 if h >> 63 else -1.0)
                places.append(at)
            row = np.repeat(np.arange(len(words)), [len(own) for own in words])
            slot = np.array([p[0] for p in places], np.int64)
            v = np.bincount(row * dims + slot, [p[1] for p in places], minlength=len(words) * dims).reshape(len(words), dims).astype(np.float32)
            norm = np.linalg.norm(v, axis=1)
            yield pd.Series([x / n if n else None for x, n in zip(v, norm)], dtype=object)

    return embed


def backfill(memories, embeddings, embedder, model: str):
    """Rows of embeddings (memory_id, vector, model) for the memories that have none."""
    pending = memories.join(embeddings.select(F.col("memory_id").alias("id")), "id", "left_anti")
    return pending.select(F.col("id").alias("memory_id"), embedder(_text(F.col("content"))).alias("vector"), F.lit(model).alias("model")).filter("vector is not null")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
