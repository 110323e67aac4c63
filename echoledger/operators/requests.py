"""Canonical requests out of a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from echoledger.functions import canonical as C


def parse_bodies(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds the parsed body and, where it cannot be keyed, the reason."""
    parsed = requests.withColumn("parsed", C.parse_whole(F.col(body)))
    return parsed.withColumn("reject_reason", C.reject_reason(F.col(body), F.col("parsed")))


def canonicalize(requests: DataFrame, body: str = "body") -> DataFrame:
    """Adds prompt_text (canonical JSON), prompt_hash, model and embed_text; drops rejects."""
    kept = parse_bodies(requests, body).where(F.col("reject_reason").isNull())
    keyed = kept.withColumn("prompt_text", C.canonical_text(F.col("parsed"))).drop("parsed", "reject_reason")
    return (
        keyed.withColumn("prompt_hash", C.prompt_key(F.col("prompt_text")))
        .withColumn("model", C.extract_model(F.col("prompt_text")))
        .withColumn("embed_text", C.embedding_text(F.col("prompt_text")))
    )


def rejects(requests: DataFrame, body: str = "body") -> DataFrame:
    return parse_bodies(requests, body).where(F.col("reject_reason").isNotNull()).drop("parsed")
