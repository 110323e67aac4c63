"""Percentiles, rounding, pricing and invariants."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from echoledger.functions import stats
from echoledger.operators import analytics as A, cost, quality as Q


def latencies(spark, groups):
    return spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v int")


GROUPS = {"one": [7], "two": [100, 200], "ties": [5] * 40, "wide": [3 * i * i for i in range(500)], "mixed": [random.Random(1).randrange(9000) for _ in range(77)]}


def test_exclusive_p95(spark):
    got = {r.k: r.p95 for r in A.p95_exclusive(latencies(spark, GROUPS), ["k"], "v").collect()}
    want = {k: float(v[0]) if len(v) == 1 else statistics.quantiles(v, n=20)[18] for k, v in GROUPS.items()}
    assert got == pytest.approx(want)
    assert got["two"] == 285.0


def test_ranks(spark):
    df = latencies(spark, GROUPS)
    for q in (0.5, 0.95):
        near = {r.k: r.value for r in A.nearest_rank(df, ["k"], "v", q).collect()}
        floor = {r.k: r.value for r in A.floor_rank(df, ["k"], "v", q).collect()}
        for k, v in GROUPS.items():
            s = sorted(v)
            assert near[k] == s[min(len(s) - 1, max(0, int(round(q * len(s))) - 1))]
            assert floor[k] == s[int(q * len(s)) - 1]


def usage(spark, n=300, sessions=4):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        hit = rnd.random() < 0.4
        rows.append((i, "hot" if i % 3 == 0 else f"s{rnd.randrange(sessions)}", hit, "claude-sonnet-4-6", rnd.randrange(900), rnd.randrange(90), rnd.randrange(400), 1.0 if hit else None, 1_700_000_000 + rnd.randrange(50_000)))
    df = spark.createDataFrame(rows, "id long, session_id string, cache_hit boolean, model string, input_tokens int, output_tokens int, latency_ms int, similarity_score double, t long")
    return rows, cost.with_costs(df.withColumn("created_at", F.timestamp_seconds("t")).drop("t"))


def test_session_metrics_use_the_newest_latencies(spark):
    rows, df = usage(spark)
    got = {r.session_id: r for r in A.session_metrics(df, window_rows=20).collect()}
    for s in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[8], r[0]))
        newest = [r[6] for r in mine][-20:]
        assert got[s].latency_p95 == pytest.approx(statistics.quantiles(newest, n=20)[18])
        assert got[s].total_calls == len(mine)
        assert got[s].hit_rate == pytest.approx(sum(r[2] for r in mine) / len(mine), abs=1e-6)


def test_running_totals_cross_segments(spark):
    rows, df = usage(spark)
    got = {r.id: r for r in A.running_totals(df, "30 minutes").collect()}
    price = lambda r: (r[4] * 3.0 + r[5] * 15.0) / 1e6
    for s in {r[1] for r in rows}:
        cost_so_far = hits = 0
        for n, r in enumerate(sorted((r for r in rows if r[1] == s), key=lambda r: (r[8], r[0])), 1):
            cost_so_far += price(r)
            hits += r[2]
            assert (got[r[0]].calls_so_far, got[r[0]].hits_so_far) == (n, hits)
            assert got[r[0]].cost_so_far == pytest.approx(cost_so_far, abs=1e-6)


def test_invariants_and_empty_log(spark):
    _, df = usage(spark)
    assert set(A.fact_violations(df).first()) == {0}
    broken = df.withColumn("cost_saved_usd", F.lit(9.0))
    assert A.fact_violations(broken).first().miss_with_saving > 0
    empty = df.limit(0)
    r = A.all_time_stats(empty).first()
    assert (r.total_calls, r.cache_hits, r.cache_misses, r.hit_rate_pct, r.cost_saved_usd) == (0, 0, 0, None, 0.0)
    assert A.hit_rate(empty).first()[0] is None


def test_null_hits_count_nowhere_in_the_log_but_as_misses_live(spark):
    df = spark.createDataFrame([("s", None), ("s", True), ("s", False)], "session_id string, cache_hit boolean").withColumn("cost_saved_usd", F.lit(0.0))
    r = A.all_time_stats(df).first()
    assert (r.total_calls, r.cache_hits, r.cache_misses) == (3, 1, 1)
    assert A.session_stats(df).first().cache_misses == 2


def test_half_even_percentages(spark):
    """As the language's own rounding of the double: ties only where the binary value is one."""
    rows = [(h, 2000) for h in range(0, 2001, 1)] + [(2, 3), (1, 7), (49, 400), (51, 400), (1, 10**9), (1, 16), (3, 16), (1, 1)]
    df = spark.createDataFrame(rows, "h bigint, n bigint").select("h", "n", stats.percent_half_even(F.col("h"), F.col("n")).alias("p"))
    bad = [r for r in df.collect() if r.p != round(r.h / r.n * 100, 1)]
    assert not bad
    pinned = {r.h: r.p for r in df.where("n = 2000 AND h IN (1, 3, 669)").collect()}
    assert pinned == {1: 0.1, 3: 0.1, 669: 33.5}
    assert spark.range(1).select(stats.percent_half_even(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_half_up_percentage(spark):
    assert spark.range(1).select(stats.percent(F.lit(49), F.lit(400), 1)).first()[0] == 12.3


PRICES = {
    "claude-opus-4-5-20251101": (5.0, 25.0), "claude-opus-4-20250514": (15.0, 75.0), "Claude-3.5-Haiku-20241022": (0.8, 4.0),
    "claude-haiku-4-5": (1.0, 5.0), "claude-3-haiku": (0.25, 1.25), "gpt": (3.0, 15.0), "": (3.0, 15.0), None: (3.0, 15.0),
}


def test_longest_prefix_prices_either_way(spark):
    models = spark.createDataFrame([(m,) for m in PRICES], "model string")
    direct = {r.model: (r.r.in_rate, r.r.out_rate) for r in models.select("model", cost.rate_of(F.col("model")).alias("r")).collect()}
    joined = {r.model: (r.in_rate, r.out_rate) for r in cost.rates_by_join(models, cost.rate_table(spark)).collect()}
    assert direct == joined == PRICES


def test_savings_model(spark):
    df = spark.createDataFrame([(i < 44,) for i in range(107)], "cache_hit boolean")
    r = cost.savings_model(df, "claude-sonnet-4-6", 1500, 350).first()
    assert (r.n_calls, r.n_hits, r.cost_per_call) == (107, 44, 0.00975)
    assert r.saved_usd == pytest.approx(0.429) and r.saved_usd + r.spent_usd == pytest.approx(1.04325)


def test_tail_line(spark):
    df = spark.createDataFrame([(1, None, True, 12, 0.91234, 0.5, 0.5, "m"), (2, None, False, None, None, None, None, None)], "id int, created_at timestamp, cache_hit boolean, latency_ms int, similarity_score double, cost_usd double, cost_saved_usd double, model string")
    lines = [r.line for r in A.tail_lines(df).orderBy("id").collect()]
    assert lines == ["[HIT ] latency=12ms  sim=0.912  cost=$0.500000  saved=$0.500000  m", "[MISS] sim=—  cost=$0.000000  saved=$0.000000"]


def test_confusion_edges_and_best_threshold(spark):
    rows = [("hit", 0.99, True), ("hit", 0.93, False), ("miss", 0.95, False), ("miss", 0.70, True), ("hit", 0.85, True)]
    df = spark.createDataFrame(rows, "expect string, score double, safe boolean")
    sweep = {(r.pipeline, r.thr): r for r in Q.confusion_sweep(df).collect()}
    assert len(sweep) == 40
    for (pipeline, thr), r in sweep.items():
        fires = [s >= thr and (pipeline == "cosine" or safe) for _, s, safe in rows]
        tp = sum(f and e == "hit" for f, (e, _, _) in zip(fires, rows))
        fp = sum(f and e == "miss" for f, (e, _, _) in zip(fires, rows))
        assert (r.tp, r.fp, r.fn, r.n_hit, r.n_miss) == (tp, fp, 3 - tp, 3, 2)
        assert r.precision == pytest.approx(tp / (tp + fp) if tp + fp else 1.0)
    best = {r.pipeline: r.thr for r in Q.best_thresholds(Q.confusion_sweep(df)).collect()}
    assert best == {"cosine": 0.96, "guarded": 0.80}
    none = spark.createDataFrame([("miss", 0.99, True)], "expect string, score double, safe boolean")
    assert {r.thr for r in Q.best_thresholds(Q.confusion_sweep(none)).collect()} == {None}
    r = next(r for r in Q.confusion_sweep(none).collect() if r.thr == 0.8)
    assert (r.recall, r.precision, r.f1) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("k, n", [(0, 0), (0, 10), (10, 10), (2, 32), (17, 32)])
def test_wilson(spark, k, n):
    r = spark.range(1).select(stats.wilson(F.lit(k), F.lit(n)).alias("w")).first().w
    if n == 0:
        assert (r.low, r.high) == (0.0, 0.0)
        return
    z, p = 1.96, k / n
    mid, half = p + z * z / (2 * n), z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5
    d = 1 + z * z / n
    assert r.low == pytest.approx(max(0, (mid - half) / d), abs=1e-12) and r.high == pytest.approx(min(1, (mid + half) / d), abs=1e-12)


def test_pair_integrity(spark):
    rows = [("a", "b", "hit"), ("a", "b", "hit"), (" ", "b", "miss"), ("c", "d", "maybe")]
    r = Q.pair_integrity(spark.createDataFrame(rows, "a string, b string, expect string")).first()
    assert (r.n_pairs, r.too_small, r.bad_labels, r.blank_texts, r.repeated_pairs) == (4, True, 1, 1, 1)


def test_pairs_are_scored_where_they_lie(spark):
    """Neither texts nor vectors nor features move; pairs without one of their texts are left out, equal pairs all count."""
    rows = [(1, "open the file", "open the file"), (2, "open the file", "close the file"), (3, None, "x"), (4, "x", None), (2, "open the file", "close the file"), (5, "", "a")]
    found = Q.score_pairs(spark.createDataFrame(rows, "pair_id long, a string, b string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") <= 2
    got = sorted((r.pair_id, round(r.score, 6), r.safe) for r in found.collect())
    assert got == [(1, 1.0, True), (2, 0.666667, False), (2, 0.666667, False), (5, 0.0, True)]
    assert found.columns == ["pair_id", "a", "b", "score", "safe"]
