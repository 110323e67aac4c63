"""Set-at-a-time jobs over response buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from echoledger.functions import responses as R


def with_tokens(buffers: DataFrame, raw: str = "raw") -> DataFrame:
    return buffers.withColumn("tok", R.tokens(F.col(raw))).select("*", "tok.input_tokens", "tok.output_tokens").drop("tok")


def complete_only(buffers: DataFrame, raw: str = "raw", status: str = "status") -> DataFrame:
    return buffers.where(R.is_complete(F.col(raw), F.col(status)))


def assembled(buffers: DataFrame, raw: str = "raw") -> DataFrame:
    return buffers.withColumn("message", R.assemble(F.col(raw)))


def event_rows(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per replay event, ordered by (block, step)."""
    return messages.select("*", F.inline(R.message_events(F.col(raw)))).drop(raw)


def round_trip_report(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Per message: does replaying and assembling again keep what callers see."""
    back = messages.withColumn("back", R.assemble(R.expand(F.col(raw))))
    a, b = F.try_parse_json(F.col(raw)), F.try_parse_json("back")

    def same(path: str):
        return F.to_json(F.try_variant_get(a, path, "variant")).eqNullSafe(F.to_json(F.try_variant_get(b, path, "variant")))

    return back.select(
        "response_id",
        same("$.content").alias("same_content"),
        same("$.stop_reason").alias("same_stop"),
        same("$.usage.output_tokens").alias("same_output_tokens"),
    )
