"""Embedding job: chunk texts to vectors through a pluggable model, resumable."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import fit_to_budget, tokens

BATCH = 32
MAX_WORDS = 480


def hashed_vectors(chunks: DataFrame, width: int = 64) -> DataFrame:
    """Deterministic stand-in for a model: hashed word counts scaled to length 1.

    Words are hashed in the JVM; only slot numbers reach Python.
    """
    words = tokens(fit_to_budget(F.col("text"), MAX_WORDS))
    slots = F.transform(words, lambda w: F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(width)))

    @F.pandas_udf("array<float>")
    def counted(found: pd.Series) -> pd.Series:
        return found.map(lambda s: _unit(np.bincount(np.asarray(s, dtype=int), minlength=width)))

    return chunks.withColumn("embedding", counted(slots))


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt(float(v @ v))
    return (v / length if length else v).astype("float32")


def model_vectors(
    chunks: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int
) -> DataFrame:
    """Vectors by a model that each Python worker loads once and calls on 32 texts.

    A vector of another width becomes NULL, so its chunk stays and counts as not embedded.
    """
    predict = predict_batch_udf(
        make_model, return_type=T.ArrayType(T.FloatType()), batch_size=BATCH
    )
    fitted = fit_to_budget(F.col("text"), MAX_WORDS)
    found = chunks.withColumn("embedding", predict(fitted))
    return found.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")))


def missing_vectors(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks without a stored vector, so an interrupted job resumes where it stopped."""
    return chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")
