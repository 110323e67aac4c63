"""Structured Streaming jobs over usage events, queues and request logs.

Sinks are keyed tables written per micro-batch, so a batch that runs twice after a
lost executor or driver leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoledger.config import DEFAULTS, ReuseConfig
from echoledger.operators import analytics as A, resolve, store as K
from echoledger.session import cut_lineage, scratch_path


def stream_parquet(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = None,
                   schema=None) -> DataFrame:
    schema = schema or spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
        every: str | None = None):
    """Start a stream into a batch sink: drain what is there and stop, or keep going every interval."""
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    if every is None:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    return writer.trigger(processingTime=every).start()


def keyed_sink(path: str, key: str, order: list[str], again: bool = False) -> Callable[[DataFrame, int], None]:
    """again: for wide rows that come from their source without a shuffle; those whose key stands once in a batch do not move."""
    return lambda rows, batch_id: K.write_batch(rows, path, batch_id, key, order, again=again)


# ---------------------------------------------------------------- session metrics


def counts_sink(path: str, count: Callable[[DataFrame], DataFrame], *keys: str) -> Callable[[DataFrame, int], None]:
    """Counts of each micro-batch, kept under its number: a repeated batch replaces its own, and no state is held."""

    def sink(rows: DataFrame, batch_id: int) -> None:
        part = count(rows).withColumn("batch", F.lit(batch_id)).withColumn("cell", F.concat_ws("|", F.lit(batch_id), *keys))
        K.write_batch(cut_lineage(part), path, batch_id, "cell", ["batch"])  # read twice: counted once

    return sink


def session_histogram(usage: DataFrame) -> DataFrame:
    """Counts per session and latency value: enough for every session metric, p95 included."""
    return usage.groupBy("session_id", "latency_ms").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if("cache_hit").alias("n_hits"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def folded_histogram(parts: DataFrame) -> DataFrame:
    """The histogram of all batches."""
    return parts.groupBy("session_id", "latency_ms").agg(*[F.sum(c).alias(c) for c in ("n_calls", "n_hits", "cost_usd")])


def metrics_of_histogram(parts: DataFrame) -> DataFrame:
    """Session metrics out of the batches' histograms."""
    cells = folded_histogram(parts)
    totals = cells.groupBy("session_id").agg(
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.round(F.sum("n_hits") / F.sum("n_calls"), 6).alias("hit_rate"),
        F.sum("n_calls").alias("total_calls"),
    )
    repeated = cells.select("session_id", "latency_ms", F.col("n_calls").alias("n_at"))
    p95 = A.p95_of_counts(repeated, ["session_id"], "latency_ms")
    return totals.join(p95, "session_id", "left").select(
        "session_id", "cost_usd", "hit_rate", F.coalesce("p95", F.lit(0.0)).alias("latency_p95"), "total_calls"
    )


def run_session_metrics(usage: DataFrame, path: str, checkpoint: str, every: str | None = None):
    return run(usage, counts_sink(path, session_histogram, "session_id", "latency_ms"), checkpoint, every=every)


def run_metric_rows(usage: DataFrame, path: str, checkpoint: str, cfg: ReuseConfig = DEFAULTS, every: str | None = None, timed: bool = False,
                    compact_every: int = 16):
    """Metric rows (run, metric, value) of the sessions that each micro-batch touches, written when it ends.

    The counts of different batches have different cells, so they are summed as they lie; a base holds one row for each session and latency.

    timed: one batch every flush_interval_s; the last one is written before the query stops, so that nothing waits for a flush.
    The batches' counts are folded into one base every compact_every batches.
    """
    spark, counts_path = usage.sparkSession, f"{path}/counts"
    counts = counts_sink(counts_path, session_histogram, "session_id", "latency_ms")

    def sink(rows: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(rows.select("session_id", "latency_ms", "cache_hit", "cost_usd"))
        counts(rows, batch_id)
        touched = K.read_parts(spark, counts_path).join(rows.select("session_id").distinct(), "session_id", "left_semi")
        made = A.metric_rows(metrics_of_histogram(touched)).withColumn("batch", F.lit(batch_id))
        K.write_batch(made.withColumn("cell", F.concat_ws("|", "run", "metric")), f"{path}/rows", batch_id, "cell", ["batch"], unique=True)
        if batch_id % compact_every == compact_every - 1:
            folded = folded_histogram(K.read_parts(spark, counts_path)).withColumn("cell", F.concat_ws("|", "session_id", "latency_ms"))
            K.write_base(folded, counts_path, batch_id)
            K.compact(spark, f"{path}/rows", "cell", ["batch"], batch_id)

    return run(usage, sink, checkpoint, every=every or (f"{cfg.flush_interval_s} seconds" if timed else None))


def read_metric_rows(spark: SparkSession, path: str) -> DataFrame:
    return K.read_keyed(spark, f"{path}/rows", "cell", ["batch"]).select("run", "metric", "value")


def read_session_metrics(spark: SparkSession, path: str) -> DataFrame:
    return metrics_of_histogram(K.read_parts(spark, path))


# ---------------------------------------------------------------- ingest, daily series, tail


def run_ingest(usage: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Events into the table keyed by id: one that is sent again, however late, replaces itself and none is lost."""
    return run(usage, keyed_sink(path, "id", ["created_at"]), checkpoint, every=every)


def _day_counts(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"))


def run_daily(usage: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Daily counts of each micro-batch; days may arrive in any order and at any delay."""
    return run(usage, counts_sink(path, _day_counts, "date"), checkpoint, every=every)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    parts = K.read_keyed(spark, path, "cell", ["batch"])
    return parts.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("n_calls", "hits", "misses")])


def tail(usage: DataFrame) -> DataFrame:
    return A.tail_lines(usage)


# ---------------------------------------------------------------- queue and propagation


def run_drain(queue: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Queued rows into the keyed store; a key queued again replaces its earlier row."""
    return run(K.decode_pending(queue), keyed_sink(path, "id", ["created_at"], again=True), checkpoint, every=every)


def run_propagation(store_appends: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Store appends into the searchable projection, latest row per key."""
    rows = K.index_projection(store_appends, keep=("created_at",)).withColumnRenamed("created_at", "changed_at")
    return run(rows, keyed_sink(path, "id", ["changed_at"], again=True), checkpoint, every=every)


# ---------------------------------------------------------------- lookup


def exact_lookup_stream(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Stateless stream-static join of canonical requests with the stored keys."""
    return resolve.exact_lookup(requests, store)


def run_resolution(requests: DataFrame, store: DataFrame, path: str, checkpoint: str,
                   cfg: ReuseConfig = DEFAULTS, every: str | None = None, **options):
    """All tiers per micro-batch against the store snapshot, which is prepared once for all batches."""
    held = resolve.searchable(store)

    def sink(rows: DataFrame, batch_id: int) -> None:
        # several passes follow: the batch is read from its source once
        out = resolve.resolve_snapshot(cut_lineage(rows), store, cfg, held=held, **options)
        K.write_batch(
            out.select("request_id", "ts", "prompt_hash", "tier", "matched_hash", "similarity_score"),
            path, batch_id, "request_id", ["ts"],
        )

    return run(requests, sink, checkpoint, every=every)


# ---------------------------------------------------------------- failure alerts


def rolling_failures(calls: DataFrame, window_s: int = DEFAULTS.failure_window_s,
                     threshold: int = DEFAULTS.failure_threshold) -> DataFrame:
    """Failures with the count of the trailing window and whether that would trip.

    Each failure goes to its own time bucket and the next one, so a window never
    crosses a bucket edge and a busy service is split by time.
    """
    from pyspark.sql import Window as W

    span = window_s * 1_000_000
    failures = calls.where("failed").withColumn("us", F.unix_micros("created_at"))
    placed = failures.withColumn("own", F.floor(F.col("us") / span)).withColumn(
        "bucket", F.explode(F.array(F.col("own"), F.col("own") + 1))
    )
    trailing = W.partitionBy("service", "bucket").orderBy("us").rangeBetween(-(span - 1), 0)
    counted = placed.withColumn("n_recent", F.count(F.lit(1)).over(trailing)).where(F.col("bucket") == F.col("own"))
    return counted.select("id", "service", "created_at", "n_recent", (F.col("n_recent") >= threshold).alias("trips"))


def fresh(spark: SparkSession, label: str) -> tuple[str, str]:
    """(output, checkpoint) folders of one run, next to the session's checkpoints."""
    root = scratch_path(spark, label)
    return f"{root}/out", f"{root}/ckpt"
