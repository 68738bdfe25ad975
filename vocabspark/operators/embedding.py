"""Batch text embedding through a pluggable model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ModelFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]


def hashing_model(dim: int = 64, seed: int = 0) -> ModelFactory:
    """A stand-in text model for tests: seeded character-trigram hashing by MD5, unit vectors."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        import hashlib
        from functools import lru_cache

        @lru_cache(maxsize=100_000)
        def place(trigram: str) -> tuple[int, float]:
            h = int(hashlib.md5(f"{seed}|{trigram}".encode()).hexdigest()[:15], 16)
            return h % dim, 1.0 if h // dim % 2 else -1.0

        def embed(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                padded = f"  {text} "
                for i in range(len(padded) - 2):
                    at, sign = place(padded[i : i + 3])
                    out[row, at] += sign
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return embed

    return make


def embed_texts(df: DataFrame, model: ModelFactory, text: str = "text", batch_size: int = 512) -> DataFrame:
    """Rows with the `embedding` of their text. Each distinct text is embedded once, then joined back."""
    udf = predict_batch_udf(model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    distinct = df.select(text).distinct().withColumn("embedding", udf(F.col(text)))
    return df.join(distinct, text)
