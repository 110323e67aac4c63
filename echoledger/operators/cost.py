"""Rate card, prefix pricing and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# USD per million input and output tokens by model-family prefix.
RATE_CARD: tuple[tuple[str, float, float], ...] = (
    ("claude-fable-5", 10.0, 50.0),
    ("claude-opus-4-8", 5.0, 25.0),
    ("claude-opus-4-7", 5.0, 25.0),
    ("claude-opus-4-6", 5.0, 25.0),
    ("claude-opus-4-5", 5.0, 25.0),
    ("claude-opus-4-1", 15.0, 75.0),
    ("claude-opus-4", 15.0, 75.0),
    ("claude-sonnet-4", 3.0, 15.0),
    ("claude-haiku-4", 1.0, 5.0),
    ("claude-3-7-sonnet", 3.0, 15.0),
    ("claude-3-5-sonnet", 3.0, 15.0),
    ("claude-3-5-haiku", 0.80, 4.0),
    ("claude-3-sonnet", 3.0, 15.0),
    ("claude-3-haiku", 0.25, 1.25),
    ("claude-3-opus", 15.0, 75.0),
)
DEFAULT_RATE = (3.0, 15.0)


def rate_of(model: Column, card=RATE_CARD, default=DEFAULT_RATE) -> Column:
    """struct(in_rate, out_rate) of the longest prefix that fits.

    The card is a setting, so it compiles into one CASE over the model column:
    no join, no shuffle, whatever the size of the log.
    """
    name = F.replace(F.lower(F.coalesce(model, F.lit(""))), F.lit("."), F.lit("-"))

    def rate(i: float, o: float) -> Column:
        return F.struct(F.lit(float(i)).alias("in_rate"), F.lit(float(o)).alias("out_rate"))

    chosen: Column | None = None
    for prefix, i, o in sorted(card, key=lambda r: -len(r[0])):
        fits = F.startswith(name, F.lit(prefix))
        chosen = F.when(fits, rate(i, o)) if chosen is None else chosen.when(fits, rate(i, o))
    return rate(*default) if chosen is None else chosen.otherwise(rate(*default))


def rate_table(spark, card=RATE_CARD) -> DataFrame:
    return spark.createDataFrame(list(card), "prefix string, in_rate double, out_rate double")


def rates_by_join(models: DataFrame, card: DataFrame, default=DEFAULT_RATE) -> DataFrame:
    """Rates for a card kept as a table: each model is cut into its own prefixes,
    so the lookup is an equi-join on the prefix text and the longest match wins."""
    name = F.replace(F.lower(F.coalesce("model", F.lit(""))), F.lit("."), F.lit("-"))
    distinct = models.select("model").distinct().withColumn("name", name)
    cut = distinct.select(
        "model",
        F.explode_outer(F.expr("transform(sequence(1, greatest(length(name), 1)), i -> substring(name, 1, i))")).alias("prefix"),
    )
    best = (
        cut.join(card, "prefix", "left")
        .groupBy("model")
        .agg(F.max_by(F.struct("in_rate", "out_rate"), F.when(F.col("in_rate").isNotNull(), F.length("prefix"))).alias("r"))
    )
    return best.select(
        "model",
        F.coalesce("r.in_rate", F.lit(default[0])).alias("in_rate"),
        F.coalesce("r.out_rate", F.lit(default[1])).alias("out_rate"),
    )


def call_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    r = rate_of(model)
    return (input_tokens * r["in_rate"] + output_tokens * r["out_rate"]) / F.lit(1_000_000.0)


def with_costs(usage: DataFrame) -> DataFrame:
    """cost_usd is the list price; spend_usd is what a reused answer leaves to pay."""
    priced = usage.withColumn("rate", rate_of(F.col("model")))
    cost = (F.col("input_tokens") * F.col("rate.in_rate") + F.col("output_tokens") * F.col("rate.out_rate")) / F.lit(1_000_000.0)
    return (
        priced.withColumn("cost_usd", cost)
        .withColumn("cost_saved_usd", F.when(F.col("cache_hit"), F.col("cost_usd")).otherwise(F.lit(0.0)))
        .withColumn("spend_usd", F.col("cost_usd") - F.col("cost_saved_usd"))
        .drop("rate")
    )


def cost_by_model(usage: DataFrame) -> DataFrame:
    return (
        with_costs(usage)
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n_calls"),
            F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
            F.round(F.sum("cost_saved_usd"), 6).alias("cost_saved_usd"),
            F.round(F.sum("spend_usd"), 6).alias("spend_usd"),
        )
    )


def savings_model(outcomes: DataFrame, model: str, input_tokens: int, output_tokens: int) -> DataFrame:
    """Spend avoided when every call has the same assumed size; needs a cache_hit column."""
    per_call = call_cost(F.lit(model), F.lit(input_tokens), F.lit(output_tokens))
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.coalesce(F.count_if("cache_hit"), F.lit(0)).alias("n_hits"),
    ).withColumn("cost_per_call", per_call)
    saved = F.col("n_hits") * F.col("cost_per_call")
    total = F.col("n_calls") * F.col("cost_per_call")
    return counts.select(
        "n_calls",
        "n_hits",
        "cost_per_call",
        F.round(saved, 6).alias("saved_usd"),
        F.round(total - saved, 6).alias("spent_usd"),
        F.round(F.when(total > 0, 100.0 * saved / total), 4).alias("saved_pct"),
    )
