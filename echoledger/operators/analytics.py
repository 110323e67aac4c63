"""Usage analytics over the usage log.

Percentiles work on per-value counts and running totals on time segments, so a
session that holds a third of the log never lands in one task row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from echoledger.config import DEFAULTS
from echoledger.functions.stats import money, percent, percent_half_even


def _hits() -> Column:
    return F.coalesce(F.count_if(F.col("cache_hit")), F.lit(0))


def _misses() -> Column:
    return F.coalesce(F.count_if(~F.col("cache_hit")), F.lit(0))


def all_time_stats(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.count(F.lit(1)).alias("total_calls"),
        _hits().alias("cache_hits"),
        _misses().alias("cache_misses"),
        F.coalesce(F.sum("cost_saved_usd"), F.lit(0.0)).alias("saved"),
    ).select(
        "total_calls",
        "cache_hits",
        "cache_misses",
        percent(F.col("cache_hits"), F.col("total_calls"), 1).alias("hit_rate_pct"),
        F.round("saved", 6).alias("cost_saved_usd"),
    )


def session_stats(usage: DataFrame) -> DataFrame:
    """Per session as the live endpoint shows it: whatever is no hit is a miss."""
    return usage.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_calls"), _hits().alias("cache_hits"), F.sum("cost_saved_usd").alias("saved")
    ).select(
        "session_id",
        "total_calls",
        "cache_hits",
        (F.col("total_calls") - F.col("cache_hits")).alias("cache_misses"),
        percent_half_even(F.col("cache_hits"), F.col("total_calls")).alias("hit_rate_pct"),
        F.round("saved", 6).alias("cost_saved_usd"),
    )


def daily_hits(usage: DataFrame) -> DataFrame:
    return (
        usage.groupBy(F.to_date("created_at").alias("date"))
        .agg(_hits().alias("hits"), _misses().alias("misses"))
        .orderBy("date")
    )


def hit_rate(usage: DataFrame) -> DataFrame:
    return usage.agg(_hits().alias("h"), F.count(F.lit(1)).alias("n")).select(
        percent(F.col("h"), F.col("n"), 2).alias("hit_rate_pct")
    )


def total_saved(usage: DataFrame) -> DataFrame:
    return usage.agg(money(F.sum("cost_saved_usd"), 4).alias("total_saved_usd"))


def daily_summary(usage: DataFrame) -> DataFrame:
    """Calls, hits, rate, list price, saving and mean latency per day, latest first."""
    return (
        usage.groupBy(F.to_date("created_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_calls"),
            _hits().alias("cache_hits"),
            money(F.sum("cost_usd"), 4).alias("gross_cost_usd"),
            money(F.sum("cost_saved_usd"), 4).alias("saved_usd"),
            F.sum("latency_ms").alias("lat_sum"),
            F.count("latency_ms").alias("lat_n"),
        )
        .select(
            "date",
            "total_calls",
            "cache_hits",
            percent(F.col("cache_hits"), F.col("total_calls"), 1).alias("hit_rate_pct"),
            "gross_cost_usd",
            "saved_usd",
            F.round(F.col("lat_sum").cast("decimal(24,6)") / F.col("lat_n"), 0).cast("double").alias("avg_latency_ms"),
        )
        .orderBy(F.desc("date"))
    )


def newest(df: DataFrame, keys: list[str], order: list[str], limit: int, spread: int = 64) -> DataFrame:
    """The `limit` newest rows of each group, found per slice first so no task sees a whole group."""
    desc = [F.desc(c) for c in order]
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(spread)))
    per_slice = sliced.withColumn("_rk", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*desc)))
    kept = per_slice.where(F.col("_rk") <= limit).drop("_rk", "_slice")
    ranked = kept.withColumn("_rk", F.row_number().over(W.partitionBy(*keys).orderBy(*desc)))
    return ranked.where(F.col("_rk") <= limit).drop("_rk")


def value_counts(df: DataFrame, keys: list[str], value: str, span: int = 1024) -> DataFrame:
    """Distinct values of an integer measure per group with running counts up to each.

    Counting happens before the shuffle; the running count is taken within value
    ranges and carried over from range totals, so its windows stay short.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_at"))
    return running_counts(counts, keys, value, span)


def running_counts(counts: DataFrame, keys: list[str], value: str, span: int = 1024) -> DataFrame:
    """Running counts over (keys, value, n_at) rows."""
    ranged = counts.withColumn("_range", F.floor(F.col(value) / span))
    group = [F.col(k) for k in keys] or [F.lit(0)]
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("n_at").alias("_in_range"))
        .withColumn("_carried", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
        .withColumn("n_all", F.sum("_in_range").over(W.partitionBy(*group)))
        .drop("_in_range")
    )
    inner = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        ranged.join(totals, [*keys, "_range"])
        .withColumn("n_upto", F.sum("n_at").over(inner) + F.col("_carried"))
        .select(*keys, value, "n_at", "n_upto", "n_all")
    )


def _at_rank(value: Column, rank: Column) -> Column:
    """The value that a sorted list holds at a 1-based rank."""
    holds = (rank > F.col("n_upto") - F.col("n_at")) & (rank <= F.col("n_upto"))
    return F.max(F.when(holds, value))


def p95_exclusive(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nineteenth of twenty exclusive quantiles: it may lie beyond the largest value."""
    return _p95(value_counts(df, keys, value), keys, value)


def p95_of_counts(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same quantile where counts per value (n_at) are kept already."""
    return _p95(running_counts(counts, keys, value), keys, value)


def _p95(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    n = F.col("n_all")
    j = F.least(F.greatest(F.floor(19 * (n + 1) / 20), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    picked = counts.withColumn("j", j).withColumn("d", 19 * (n + 1) - 20 * F.col("j"))
    agg = picked.groupBy(*keys).agg(
        F.max("n_all").alias("n"),
        F.max("d").alias("d"),
        _at_rank(F.col(value), F.col("j")).alias("lo"),
        _at_rank(F.col(value), F.col("j") + 1).alias("hi"),
    )
    p95 = F.when(F.col("n") == 1, F.col("lo").cast("double")).otherwise(
        (F.col("lo") * (20 - F.col("d")) + F.col("hi") * F.col("d")) / F.lit(20.0)
    )
    return agg.select(*keys, p95.alias("p95"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Sorted value at round-half-even(q·n), counted from one and kept inside the list."""
    rank = F.least(F.greatest(F.bround(F.lit(q) * F.col("n_all"), 0).cast("long"), F.lit(1)), F.col("n_all"))
    return _picked(df, keys, value, rank)


def floor_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Sorted value at floor(q·n), counted from one; below one it wraps to the largest."""
    raw = F.floor(F.lit(q) * F.col("n_all"))
    return _picked(df, keys, value, F.when(raw < 1, F.col("n_all")).otherwise(raw))


def _picked(df: DataFrame, keys: list[str], value: str, rank: Column) -> DataFrame:
    counts = value_counts(df, keys, value).withColumn("_rank", rank)
    return counts.groupBy(*keys).agg(F.max("n_all").alias("n"), _at_rank(F.col(value), F.col("_rank")).alias("value"))


def session_metrics(usage: DataFrame, window_rows: int | None = DEFAULTS.latency_window_rows) -> DataFrame:
    """cost_usd, hit_rate, latency_p95 and total_calls per session.

    The p95 covers all latencies of a session, or its newest `window_rows`: sessions within
    the window go straight to counts, and only the longer ones need rows picked out first.
    """
    totals = usage.groupBy("session_id").agg(
        F.sum("cost_usd").alias("cost"), _hits().alias("hits"), F.count(F.lit(1)).alias("total_calls")
    )
    if window_rows is None:
        return _session_rows(totals, p95_exclusive(usage, ["session_id"], "latency_ms"))
    lengths = totals.select("session_id", (F.col("total_calls") > window_rows).alias("long_session"))
    marked = usage.join(lengths, "session_id")
    short = marked.where(~F.col("long_session")).select("session_id", "latency_ms")
    long = newest(marked.where("long_session"), ["session_id"], ["created_at", "id"], window_rows)
    return _session_rows(totals, p95_exclusive(short.unionByName(long.select("session_id", "latency_ms")), ["session_id"], "latency_ms"))


def _session_rows(totals: DataFrame, p95: DataFrame) -> DataFrame:
    return totals.join(p95, "session_id", "left").select(
        "session_id",
        F.round("cost", 6).alias("cost_usd"),
        F.round(F.when(F.col("total_calls") > 0, F.col("hits") / F.col("total_calls")).otherwise(0.0), 6).alias("hit_rate"),
        F.coalesce("p95", F.lit(0.0)).alias("latency_p95"),
        "total_calls",
    )


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Long form (run, metric, value) of the session metrics."""
    wide = metrics.withColumn("total_calls", F.col("total_calls").cast("double"))
    return wide.unpivot(
        ["session_id"], ["cost_usd", "hit_rate", "latency_p95", "total_calls"], "metric", "value"
    ).withColumnRenamed("session_id", "run")


def running_totals(usage: DataFrame, segment: str = "1 hour") -> DataFrame:
    """Calls, hits, cost and saving so far in each session.

    Each session is cut into time segments: totals of earlier segments are carried
    in, and only the rows of one segment are sorted together.
    """
    rows = usage.select(
        "id", "session_id", "created_at", F.col("cache_hit"), "cost_usd", "cost_saved_usd",
        F.window("created_at", segment)["start"].alias("_seg"),
    ).withColumn("_hit", F.coalesce(F.col("cache_hit").cast("long"), F.lit(0)))
    measures = {"calls": F.lit(1), "hits": F.col("_hit"), "cost": F.col("cost_usd"), "saved": F.col("cost_saved_usd")}
    before = W.partitionBy("session_id").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("session_id", "_seg").agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    carried = totals.select(
        "session_id", "_seg", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_c_{m}") for m in measures]
    )
    within = W.partitionBy("session_id", "_seg").orderBy("created_at", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.join(carried, ["session_id", "_seg"]).select(
        "id",
        "session_id",
        *[
            (F.round(F.sum(c).over(within) + F.col(f"_c_{m}"), 6) if m in ("cost", "saved") else F.sum(c).over(within) + F.col(f"_c_{m}")).alias(f"{m}_so_far")
            for m, c in measures.items()
        ],
    )


def fact_violations(usage: DataFrame, tier: str | None = None) -> DataFrame:
    """Counts of rows that break what every usage fact must satisfy."""
    hit, saved = F.col("cache_hit"), F.col("cost_saved_usd")
    checks = [
        F.count_if(hit & (saved != F.col("cost_usd"))).alias("hit_without_full_saving"),
        F.count_if(~hit & (saved != 0)).alias("miss_with_saving"),
        F.count_if(hit & F.col("similarity_score").isNull()).alias("hit_without_score"),
        F.count_if(~hit & F.col("similarity_score").isNotNull()).alias("miss_with_score"),
    ]
    if tier:
        checks.append(F.count_if((F.col(tier) == "L1") & (F.col("similarity_score") != 1.0)).alias("exact_hit_score_not_one"))
    return usage.agg(*checks)


def _counted(attribution: DataFrame) -> DataFrame:
    return attribution.where(F.col("matched_hash").isNotNull()).groupBy("matched_hash").agg(
        F.count(F.lit(1)).alias("hit_count"), F.max("ts").alias("last_hit_at")
    )


def _described(counted: DataFrame, store: DataFrame) -> DataFrame:
    return store.join(counted, F.col("prompt_hash") == F.col("matched_hash")).select(
        "prompt_hash", "prompt_text", "hit_count", "created_at", "last_hit_at"
    )


def reuse_counts(attribution: DataFrame, store: DataFrame) -> DataFrame:
    """hit_count and last_hit_at of every reused prompt, derived from the attribution."""
    return _described(_counted(attribution), store)


def top_prompts(attribution: DataFrame, store: DataFrame, n: int = 20) -> DataFrame:
    """Most reused stored prompts: hits are counted first, then n rows look up their text."""
    top = _counted(attribution).orderBy(F.desc("hit_count"), "matched_hash").limit(n)
    return _described(F.broadcast(top), store).orderBy(F.desc("hit_count"), "prompt_hash")


def tail_lines(usage: DataFrame) -> DataFrame:
    """One printable line per call, as a live tail shows it."""
    score = F.format_string("%.3f", "similarity_score")
    line = F.concat(
        F.when(F.col("cache_hit"), "[HIT ] ").otherwise("[MISS] "),
        F.when(F.col("latency_ms").isNotNull(), F.format_string("latency=%dms  ", "latency_ms")).otherwise(""),
        F.lit("sim="),
        F.when(F.col("similarity_score").isNotNull(), score).otherwise("—"),
        F.format_string("  cost=$%.6f  saved=$%.6f", F.coalesce("cost_usd", F.lit(0.0)), F.coalesce("cost_saved_usd", F.lit(0.0))),
        F.when(F.coalesce("model", F.lit("")) != "", F.concat(F.lit("  "), F.col("model"))).otherwise(""),
    )
    return usage.select("id", "created_at", line.alias("line"))
