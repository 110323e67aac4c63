"""Best match that a pair scorer does not refuse.

The join gives each query its nearest compatible and safe rows, a few at a time. A batch model scores those pairs outside the
join's kernel, where Spark deals them evenly, and the first one that is not refused is the match. Queries whose rows were
all refused go on to the next ones; their number falls from round to round, and the list of a query ends when it is
shorter than was asked for.
"""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from echoledger.config import DEFAULTS, ReuseConfig
from echoledger.operators import similarity as S
from echoledger.session import cut_lineage


def contradiction_udf(make_predict: Callable, index: int, batch_size: int = 64):
    """Column function of two texts: the larger softmax probability of class `index` over both directions, NaN where the model fails.

    make_predict() loads the model once per Python worker and maps two text lists to logits.
    """

    def load():
        predict = make_predict()

        def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            try:
                both = np.asarray(predict([*a, *b], [*b, *a]), np.float64)
                e = np.exp(both - both.max(axis=1, keepdims=True))
                return (e / e.sum(axis=1, keepdims=True))[:, index].reshape(2, -1).max(axis=0)
            except (ValueError, RuntimeError, ArithmeticError, LookupError):  # what models raise on inputs; the failure is counted
                return np.full(len(a), np.nan)

        return run

    return predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size)


def score_pairs(pairs: DataFrame, probe: DataFrame, store: DataFrame, scorer) -> DataFrame:
    """Pairs (pid, sid, ...) with their probability; texts are fetched for these pairs alone."""
    asked = probe.select(F.col("id").alias("pid"), F.col("text").alias("asked_text"))
    held = store.select(F.col("id").alias("sid"), F.col("text").alias("held_text"))
    both = pairs.join(asked, "pid").join(held, "sid")
    return both.withColumn("probability", scorer(F.col("asked_text"), F.col("held_text"))).drop("asked_text", "held_text")


def best_unrefused(probe: DataFrame, store: DataFrame, scorer, cfg: ReuseConfig = DEFAULTS, earlier: bool = False, first: int = 4,
                   **options) -> DataFrame:
    """pid, sid, s_ord, score, n_scored, n_failed: the nearest row that the scorer does not refuse.

    Both sides are prepared with their texts. A pair whose scoring failed is not refused; n_failed tells of those of a match's query.
    """
    left, skip, k, rounds = probe, 0, first, []
    while True:
        spec = S.Spec("top", cfg.similarity_threshold, earlier, k=k, filtered=True)
        near = S.similarity_join(left, store, spec, cfg, **options).where(F.col("rank") > skip).drop("compatible", "safe")
        scored = cut_lineage(score_pairs(near, probe, store, scorer))
        refused = ~F.isnan("probability") & (F.col("probability") >= cfg.contradiction_threshold)
        each = cut_lineage(scored.groupBy("pid").agg(
            F.min_by(F.struct("sid", "s_ord", "score"), F.when(~refused, F.col("rank"))).alias("b"), F.max("rank").alias("seen"),
            F.count(F.lit(1)).alias("n_scored"), F.count_if(F.isnan("probability")).alias("n_failed")))
        rounds.append(each.select("pid", "b", "n_scored", "n_failed"))
        again = each.where(F.col("b").isNull() & (F.col("seen") == k)).select(F.col("pid").alias("id"))
        if again.isEmpty():
            break
        left = cut_lineage(left.join(again, "id", "left_semi"))
        skip, k = k, 4 * k
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    # a query has a match in one round at most, and no row is scored twice
    total = every.groupBy("pid").agg(F.max("b").alias("b"), F.sum("n_scored").alias("n_scored"), F.sum("n_failed").alias("n_failed"))
    return total.where("b IS NOT NULL").select("pid", "b.sid", "b.s_ord", "b.score", "n_scored", "n_failed")
