"""Dense vectors as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from intentlake.functions.text import as_col


def dot(a: Column | str, b: Column | str) -> Column:
    """The dot product of two arrays of equal length; null if one is null."""
    products = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column | str) -> Column:
    """The vector over its length; a zero vector as it is."""
    n = norm(v)
    return F.when(n == 0, as_col(v).cast("array<double>")).otherwise(F.transform(as_col(v), lambda x: x.cast("double") / n))


def unit_vectors(vectors: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors with exactly ``dim`` components, all finite and not all 0, and these over their lengths."""
    row = np.flatnonzero(np.asarray(vectors.value_lengths().fill_null(-1)) == dim)
    v = vectors.take(pa.array(row)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.sqrt((v * v).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return row[good], v[good] / norm[good][:, None]


def pool_tokens(tokens: np.ndarray, mask: np.ndarray, pooling: str = "last", unit: bool = True) -> np.ndarray:
    """(texts, dimensions): one vector of each text from its token vectors, for embedding functions on Arrow batches.

    ``tokens`` is (texts, places, dimensions), ``mask`` (texts, places) 1 for tokens and 0 for padding on
    the right. ``last`` or ``eos``: the last token; ``mean``, ``avg`` or ``average``: the mean of the tokens;
    ``cls``: the first place. ``unit`` divides by the length; a zero vector stays as it is.
    """
    if pooling in ("mean", "avg", "average"):
        weight = mask[:, :, None].astype(tokens.dtype)
        pooled = (tokens * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    elif pooling == "cls":
        pooled = tokens[:, 0]
    elif pooling in ("last", "eos"):
        pooled = tokens[np.arange(len(tokens)), mask.astype(np.int64).sum(axis=1) - 1]
    else:
        raise ValueError(f"pooling {pooling!r} is none of last, mean and cls")
    return pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12) if unit else pooled
