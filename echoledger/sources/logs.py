"""Scans of request logs, labelled pairs and response buffers, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoledger import schemas
from echoledger.functions.canonical import parse_whole


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REQUEST_LOG).json(path)


def stream_request_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.REQUEST_LOG).json(path)


def eligible(requests: DataFrame) -> DataFrame:
    """Only message posts take part in reuse; everything else passes by."""
    return requests.where((F.col("method") == "POST") & F.endswith(F.col("path"), F.lit("/messages")))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs kept one JSON object per line, with blank and // comment lines."""
    return parse_pairs(spark.read.text(path))


def parse_pairs(lines: DataFrame) -> DataFrame:
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    kept = lines.select(text.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("//")))
    obj = F.from_json("line", "a string, b string, expect string")
    keys = F.array_sort(F.json_object_keys("line"))
    return kept.select(obj.alias("p"), keys.alias("keys")).select("p.a", "p.b", "p.expect", "keys")


def data_events(raw: Column, indented: bool = True) -> Column:
    """array<variant>: decoded payloads of the `data: ` lines of one buffer, in order.

    Assembly tolerates indented lines; token counting takes lines from column one only.
    """
    lines = F.split(raw, "\n")
    if indented:
        lines = F.transform(lines, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    payload = F.transform(
        F.filter(lines, lambda s: F.startswith(s, F.lit("data: "))),
        lambda s: parse_whole(F.substring(s, F.lit(7), F.length(s))),
    )
    return F.filter(payload, lambda v: v.isNotNull())


def event_rows(buffers: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per decoded event with its position in the buffer."""
    return buffers.select("*", F.posexplode(data_events(F.col(raw))).alias("pos", "event"))
