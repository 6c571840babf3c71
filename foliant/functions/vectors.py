"""Vector expressions; a vector is ``array<float>`` or ``array<double>``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, unequal lengths or a zero norm."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.coalesce(F.when(usable, dot(a, b) / scale), F.lit(0.0))


def normalized(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    length = norm(v)
    return F.when(
        length > 0, F.transform(_doubles(v), lambda x: x / length)
    ).otherwise(_doubles(v))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(data: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector."""
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
