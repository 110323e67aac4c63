"""Parquet inputs and the request-log views derived from them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by a key before costly work on their wide columns, whatever files and row groups they come in."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _props_number() -> Column:
    return F.regexp_extract("props", r"([0-9]+)", 1)


def usage_columns(events: DataFrame) -> DataFrame:
    """Usage facts out of the event table; works on a batch or a stream."""
    model = (
        F.when(F.col("user_id") % 5 == 0, "claude-opus-4-5-20251101")
        .when(F.col("user_id") % 5 == 1, "claude-opus-4-20250514")
        .when(F.col("user_id") % 5 == 2, "claude-sonnet-4-6")
        .when(F.col("user_id") % 5 == 3, "claude-3.5-haiku-20241022")
        .otherwise("other-model")
    )
    score = F.when(F.col("event_type") == "view", F.lit(1.0)).when(
        F.col("event_type") == "click", F.lit(0.9) + _props_number().cast("double") / 1000
    )
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").isin("view", "click").alias("cache_hit"),
        model.alias("model"),
        F.floor(F.col("value") * 10).cast("int").alias("input_tokens"),
        _props_number().cast("int").alias("output_tokens"),
        F.floor("value").cast("int").alias("latency_ms"),
        score.alias("similarity_score"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_columns(table(spark, sf_dir, "events"))


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single-turn request per document, in document order."""
    model = (
        F.when(F.col("doc_id") % 4 == 0, "claude-opus-4-5-20251101")
        .when(F.col("doc_id") % 4 == 1, " Claude-Opus-4-5")
        .when(F.col("doc_id") % 4 == 2, "claude-3-5-haiku-20241022")
    )
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("request_id"),
        F.col("source").alias("session_id"),
        model.alias("model"),
        F.col("text").alias("prompt_text"),
    )


def document_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies in every shape the canonical form has to fold together or turn away."""
    docs = document_requests(spark, sf_dir).withColumn("q", F.to_json(F.col("prompt_text").cast("variant")))
    body = F.expr(
        """
        CASE
          WHEN request_id % 23 = 7 THEN concat('{"messages":[', q)
          WHEN request_id % 23 = 8 THEN concat('[', q, ']')
          WHEN request_id % 23 = 9 THEN concat('{"model":"m","messages":null,"note":', q, '}')
          WHEN request_id % 23 = 10 THEN concat('{"model":"m","messages":[', q, ']}')
          WHEN request_id % 23 = 11 THEN concat('{"model":"m","model":"n","messages":[{"role":"user","content":', q, '}]}')
          WHEN request_id % 23 = 12 THEN concat('{"messages":[]} ', q)
          WHEN request_id % 23 = 13 THEN '{"messages":[]}{"a":1}'
          ELSE concat('{', concat_ws(',',
            CASE WHEN request_id % 2 = 0 THEN '"temperature":0.5,"stream":true,"max_tokens":64' END,
            CASE WHEN request_id % 3 = 0 THEN '"tools":[{"name":"f","input_schema":{"type":"object","a":[1,2]}}]' END,
            CASE WHEN request_id % 6 = 0 THEN '"tool_choice":{"type":"auto"}' END,
            CASE WHEN request_id % 6 = 1 THEN '"tool_choice":{"type":"auto"}' END,
            CASE WHEN request_id % 5 = 1 THEN '"system":""'
                 WHEN request_id % 5 = 2 THEN '"system":"be brief"'
                 WHEN request_id % 5 = 3 THEN '"system":[{"type":"text","cache_control":{"type":"ephemeral"},"text":"be brief"}]' END,
            CASE WHEN request_id % 2 = 0
                 THEN concat('"messages":[{"role":"user","content":', q, '}]')
                 ELSE concat('"messages":[{"content":[{"text":', q, ',"type":"text","cache_control":{"type":"ephemeral"}}],"role":"user"}]') END,
            CASE WHEN model IS NOT NULL THEN concat('"model":"', model, '"') END), '}')
        END
        """
    )
    return docs.select(
        "request_id",
        "session_id",
        F.when(F.col("request_id") % 29 == 3, "GET").otherwise("POST").alias("method"),
        F.when(F.col("request_id") % 29 == 4, "/v1/models").otherwise("/v1/messages").alias("path"),
        body.alias("body"),
    )


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per conversation, carrying all its turns."""
    users = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"))
    system = F.filter("ms", lambda m: m["role"] == "system")
    spoken = F.filter("ms", lambda m: m["role"] != "system")
    body = F.to_json(
        F.struct(
            F.lit("claude-sonnet-4-6").alias("model"),
            F.when(F.size(system) > 0, F.transform(system, lambda m: F.struct(F.lit("text").alias("type"), m["text"].alias("text")))).alias("system"),
            F.transform(spoken, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"),
        )
    )
    return users.select("conv_id", body.alias("body"))


def response_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-stream buffers made from assistant turns, with the faults real streams have."""
    said = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    rid = F.concat_ws("-", F.col("conv_id"), F.col("turn"))
    base = said.select(
        rid.alias("response_id"),
        "conv_id",
        "turn",
        "text",
        F.length("text").cast("long").alias("in_tok"),
        F.size(F.split("text", " ")).cast("long").alias("out_tok"),
    )
    js = "to_json(CAST({0} AS VARIANT))"
    eol = "CASE WHEN turn % 4 = 3 THEN '\\r\\n' ELSE '\\n' END"
    half = "cast(length(text) / 2 AS int)"
    raw = f"""
      concat_ws({eol},
        'event: message_start',
        concat('data: {{"type":"message_start","message":{{"id":"m', response_id, '","type":"message","role":"assistant","content":[],"usage":{{"input_tokens":', in_tok, ',"output_tokens":1}}}}}}'),
        '',
        'data: {{"type":"content_block_start","index":0,"content_block":{{"type":"text","text":""}}}}',
        concat('data: {{"type":"content_block_delta","index":0,"delta":{{"type":"text_delta","text":', {js.format(f"substring(text, 1, {half})")}, '}}}}'),
        CASE WHEN conv_id % 5 = 0 THEN 'data: {{not json' END,
        concat('data: {{"type":"content_block_delta","index":0,"delta":{{"type":"text_delta","text":', {js.format(f"substring(text, {half} + 1)")}, '}}}}'),
        'data: {{"type":"content_block_stop","index":0}}',
        CASE WHEN conv_id % 3 = 0 THEN concat_ws({eol},
          'data: {{"type":"content_block_start","index":1,"content_block":{{"type":"tool_use","id":"t1","name":"look","input":{{}}}}}}',
          concat('data: {{"type":"content_block_delta","index":1,"delta":{{"type":"input_json_delta","partial_json":', {js.format("concat('{\"n\": ', turn)")}, '}}}}'),
          concat('data: {{"type":"content_block_delta","index":1,"delta":{{"type":"input_json_delta","partial_json":', CASE WHEN conv_id % 2 = 0 THEN '"}}"' ELSE '"]"' END, '}}}}'),
          'data: {{"type":"content_block_delta","index":7,"delta":{{"type":"text_delta","text":"lost"}}}}') END,
        concat('data: {{"type":"message_delta","delta":{{"stop_reason":"end_turn","stop_sequence":null}},"usage":{{"output_tokens":', out_tok, '}}}}'),
        '',
        CASE WHEN conv_id % 7 <> 6 THEN 'event: message_stop' END,
        CASE WHEN conv_id % 7 <> 6 THEN 'data: {{"type":"message_stop"}}' END,
        '')
    """
    return base.select("response_id", "conv_id", "turn", "text", "in_tok", "out_tok", F.expr(raw).alias("raw"))


def response_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same buffers cut into chunks of 61 characters, which part lines and markers; some arrive twice, some answers never end."""
    buffers = response_buffers(spark, sf_dir)
    chunks = buffers.select("response_id", "conv_id", F.posexplode(F.regexp_extract_all("raw", F.lit("(?s).{1,61}"), F.lit(0))).alias("seq", "data"))
    last = F.row_number().over(Window.partitionBy("response_id").orderBy(F.desc("seq"))) == 1
    times = F.when(F.pmod(F.xxhash64("response_id", "seq"), F.lit(5)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return chunks.select(
        "response_id", F.col("seq").cast("long").alias("seq"), "data", (last & (F.col("conv_id") % 11 != 3)).alias("last"), F.explode(times).alias("time")
    ).drop("time")


def response_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain JSON message bodies made from the same turns."""
    said = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    message = F.to_json(
        F.struct(
            F.concat(F.lit("m"), F.concat_ws("-", "conv_id", "turn")).alias("id"),
            F.lit("message").alias("type"),
            F.lit("assistant").alias("role"),
            F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"),
            F.lit("end_turn").alias("stop_reason"),
            F.struct(
                F.length("text").alias("input_tokens"),
                F.size(F.split("text", " ")).alias("output_tokens"),
            ).alias("usage"),
        )
    )
    return said.select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"), "conv_id", "turn", "text", message.alias("raw")
    )


def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled text pairs: every document with the next one; alike when they share a language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    left = docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("a"), F.col("lang").alias("la"), F.col("source").alias("sa"))
    right = docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("b"), F.col("lang").alias("lb"))
    return left.join(right, "pair_id").select(
        "pair_id",
        "a",
        "b",
        F.when(F.col("la") == F.col("lb"), "hit").otherwise("miss").alias("expect"),
        F.col("sa").alias("eval_set"),
        F.when(F.col("pair_id") % 3 == 0, "held-out").otherwise("dev").alias("role"),
    )
