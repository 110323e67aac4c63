"""Embedding columns and vector arithmetic."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from echoledger.config import DEFAULTS
from echoledger.functions.binding import let
from echoledger.functions.words import Known, words_of

#: Texts that are read at a time.
_TEXTS = 64


def dot(a: Column, b: Column) -> Column:
    """Double-precision dot product; NULL where lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def unit(v: Column) -> Column:
    """Vector scaled to unit norm; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def hashed_terms(text: Column, dims: int = DEFAULTS.embedding_dims) -> Column:
    """Default embedder: unit vector of hashed word counts.

    A word falls into the bucket given by the first 32 bits of its MD5. Rows are
    independent, so this runs as one Arrow pass with no shuffle.
    """

    def bucket(word: str) -> int:
        return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dims

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        # texts are read a few at a time and vectors written into one buffer: a batch takes its own bytes and those of its vectors
        of, out = Known(bucket).__getitem__, np.zeros((len(texts) - texts.null_count, dims))
        row = 0
        for start in range(0, len(texts), _TEXTS):
            for t in texts.slice(start, _TEXTS).to_pylist():
                if t is None:
                    continue
                v = np.bincount(np.fromiter(map(of, words_of(t)), np.int64), minlength=dims).astype(np.float64)
                norm = np.sqrt(v @ v)
                out[row] = v / norm if norm > 0 else v
                row += 1
        missing = texts.is_null()
        ends = np.cumsum(~missing.to_numpy(zero_copy_only=False)) * dims
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=missing)

    return embed(F.lower(text))


def model_embedder(make_predict, dims: int = DEFAULTS.embedding_dims, batch_size: int = 64):
    """Embedder around a real model: make_predict() loads it once per Python worker and
    returns texts -> matrix; the result is scaled to unit norm."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    predict = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return lambda text: unit(predict(text))


def contradiction_probability(logits: Column, index: int) -> Column:
    """Largest softmax probability of one class over the rows of a logit matrix."""

    def share(exps: Column) -> Column:
        return F.element_at(exps, index + 1) / F.aggregate(exps, F.lit(0.0), lambda s, v: s + v)

    def softmax(row: Column) -> Column:
        top = F.array_max(row)
        return let(F.transform(row, lambda x: F.exp(x - top)), share)

    return F.array_max(F.transform(logits, softmax))
