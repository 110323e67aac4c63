"""Keyed tables on Parquet: upserts, conditional inserts, projection and seeding.

A keyed table is a base plus per-batch deltas; readers see the latest row of each
key. A batch writes only its own rows, and writing it twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoledger import schemas
from echoledger.config import DEFAULTS
from echoledger.functions import canonical as C, responses as R, vectors as V
from echoledger.operators import requests as Q, winners


def latest_by_key(rows: DataFrame, key: str, order: list[str], again: bool = False) -> DataFrame:
    """Last write wins per key, folded before the shuffle so a hot key stays cheap.

    again: the rows can be read again at little cost, so that those whose key stands once stay where they are.
    """
    if (narrow := winners.latest_rows(rows, key, order, again)) is not None:
        return narrow
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return last.select(key, "r.*").select(*rows.columns)


def upsert(store: DataFrame, updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    return latest_by_key(store.unionByName(updates), key, order)


def insert_if_absent(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return store.unionByName(rows.join(store.select(key), key, "left_anti").select(*store.columns))


def warmup_row(spark: SparkSession, dims: int = DEFAULTS.embedding_dims) -> DataFrame:
    """The row a new store starts with (fixed values)."""
    return spark.range(1).select(
        F.lit("warmup-0001").alias("id"),
        F.lit("warmup").alias("prompt_hash"),
        F.lit("hello world").alias("prompt_text"),
        F.array_repeat(F.lit(0.0).cast("float"), dims).alias("embedding"),
        F.lit("{}").alias("response_json"),
        F.lit("warmup").alias("model"),
        F.lit(None).cast("int").alias("input_tokens"),
        F.lit(None).cast("int").alias("output_tokens"),
        F.lit(0.0).alias("cost_usd"),
        F.lit(0).alias("hit_count"),
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_hit_at"),
    )


def index_projection(store: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The seven searchable columns, with a model and a price in every row."""
    filled = store.withColumn("model", F.coalesce("model", F.lit("unknown"))).withColumn(
        "cost_usd", F.coalesce("cost_usd", F.lit(0.0))
    )
    return filled.select(*schemas.INDEX_COLUMNS, *keep)


def store_rows(requests: DataFrame, embed=V.hashed_terms, response: str = "response_json") -> DataFrame:
    """Store rows of canonical requests with finished answers: ts becomes created_at."""
    tok = R.tokens(F.col(response))
    return (
        requests.withColumn("tok", tok)
        .withColumn("embedding", embed(F.col("embed_text")).cast("array<float>"))
        .select(
            F.col("prompt_hash").alias("id"),
            "prompt_hash",
            "prompt_text",
            "embedding",
            F.col(response).alias("response_json"),
            "model",
            F.col("tok.input_tokens").cast("int").alias("input_tokens"),
            F.col("tok.output_tokens").cast("int").alias("output_tokens"),
            F.lit(0.0).alias("cost_usd"),
            F.lit(0).alias("hit_count"),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("last_hit_at"),
        )
    )


def seed(prompts: DataFrame, model: str, embed=V.hashed_terms) -> DataFrame:
    """Store rows out of plain prompts (prompt, response_json, ts) in one pipeline."""
    body = F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"),
        )
    )
    keyed = Q.canonicalize(prompts.withColumn("body", body)).drop("body", "prompt")
    # one row per key before embedding, so that no text is embedded twice
    return store_rows(latest_by_key(keyed, "prompt_hash", ["ts"]), embed)


def decode_pending(queue: DataFrame) -> DataFrame:
    """Queue rows as store rows, oldest first within a key left to the caller's order."""
    return queue.select(
        "id", "prompt_hash", "prompt_text",
        F.from_json("embedding_json", "array<float>").alias("embedding"),
        "response_json", "model",
        F.lit(None).cast("int").alias("input_tokens"),
        F.lit(None).cast("int").alias("output_tokens"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.lit(0).alias("hit_count"),
        F.col("enqueued_at").alias("created_at"),
        F.col("enqueued_at").alias("last_hit_at"),
    )


def encode_pending(store: DataFrame) -> DataFrame:
    return store.select(
        "id", "prompt_hash", "prompt_text", F.to_json("embedding").alias("embedding_json"),
        "response_json", "model", "cost_usd", F.col("created_at").alias("enqueued_at"),
    )


# ---------------------------------------------------------------- keyed table on files


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _finished_bases(spark: SparkSession, path: str) -> list[int]:
    """Batches up to which a finished base exists, from the folder names alone."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if "=" in n and _exists(spark, f"{path}/base/{n}/_SUCCESS"))


def write_batch(rows: DataFrame, path: str, batch_id: int, key: str, order: list[str], unique: bool = False, again: bool = False) -> None:
    """unique: no two rows share a key, so that none is looked for. again: as for latest_by_key."""
    kept = rows if unique else latest_by_key(rows, key, order, again)
    kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/delta/batch={batch_id}")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last base and of the batches after it, with their batch; several of a key if batches share keys."""
    bases = _finished_bases(spark, path)
    upto = bases[-1] if bases else -1
    parts = []
    if bases:
        parts.append(spark.read.parquet(f"{path}/base/upto={upto}").withColumn("batch", F.lit(upto).cast("long")))
    if _exists(spark, f"{path}/delta"):
        delta = spark.read.option("basePath", f"{path}/delta").parquet(f"{path}/delta")
        parts.append(delta.withColumn("batch", F.col("batch").cast("long")).where(F.col("batch") > upto))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_keyed(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame:
    """Latest row of each key; among equal orders the later batch wins."""
    return latest_by_key(read_parts(spark, path), key, [*order, "batch"], again=True).drop("batch")


def compact(spark: SparkSession, path: str, key: str, order: list[str], upto: int) -> None:
    """Fold deltas into a new base; readers switch once it is complete. Run with no writer active."""
    write_base(read_keyed(spark, path, key, order), path, upto)


def write_base(rows: DataFrame, path: str, upto: int) -> None:
    """A base that stands for the batches up to one."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/base/upto={upto}")
