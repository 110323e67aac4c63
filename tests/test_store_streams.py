"""Keyed tables and streams: batch and stream agree, retries change nothing."""

import random
import time

import pytest
from pyspark.sql import functions as F

from echoledger import schemas
from echoledger.config import ReuseConfig
from echoledger.functions import vectors as V
from echoledger.operators import analytics as A, buckets as B, cost, feed as D, resolve, store as K, winners as W
from echoledger.streaming import chunks as CH, jobs as J


def updates(spark, n=90, seed=2):
    rnd = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randrange(9)}", i, f"v{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, seq long, payload string")


def last(rows):
    return {k: v for k, _, v in sorted(rows, key=lambda r: r[1])}


def as_dict(df):
    return {r.id: r.payload for r in df.collect()}


def test_upsert_and_insert_if_absent(spark):
    rows, df = updates(spark)
    old, new = df.where("seq < 50"), df.where("seq >= 50")
    once = K.upsert(old, new, "id", ["seq"])
    assert as_dict(once) == last(rows)
    assert as_dict(K.upsert(once, new, "id", ["seq"])) == last(rows)
    base = K.latest_by_key(old, "id", ["seq"])
    both = K.insert_if_absent(base, spark.createDataFrame([("hot", 99, "no"), ("fresh", 99, "yes")], df.schema), "id")
    assert as_dict(both) == {**last([r for r in rows if r[1] < 50]), "fresh": "yes"}


def test_keyed_table_batches_retries_and_compaction(spark, tmp_path):
    rows, df = updates(spark)
    path = str(tmp_path / "t")
    for b in range(3):
        part = df.where((F.col("seq") % 3) == b)
        K.write_batch(part, path, b, "id", ["seq"])
        K.write_batch(part, path, b, "id", ["seq"])
    assert as_dict(K.read_keyed(spark, path, "id", ["seq"])) == last(rows)
    K.compact(spark, path, "id", ["seq"], upto=2)
    assert as_dict(K.read_keyed(spark, path, "id", ["seq"])) == last(rows)
    K.write_batch(spark.createDataFrame([("hot", 500, "later")], df.schema), path, 3, "id", ["seq"])
    assert as_dict(K.read_keyed(spark, path, "id", ["seq"])) == {**last(rows), "hot": "later"}
    assert K._finished_bases(spark, path) == [2]


def test_tables_and_schema_checks(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS store_t")
    for _ in range(2):
        schemas.create_table(spark, "store_t", schemas.CACHE_STORE, str(tmp_path / "store_t"))
    row = K.warmup_row(spark)
    K.insert_if_absent(spark.table("store_t"), row, "id").write.mode("append").insertInto("store_t")
    assert spark.table("store_t").select("id", F.size("embedding").alias("n")).first() == ("warmup-0001", 384)
    assert K.insert_if_absent(spark.table("store_t"), row, "id").count() == 1
    assert schemas.schema_report(spark.table("store_t"), schemas.CACHE_STORE).where("not ok").count() == 0
    bad = spark.table("store_t").drop("model").withColumn("cost_usd", F.col("cost_usd").cast("float"))
    report = {r.column_name: (r.got, r.ok) for r in schemas.schema_report(bad, schemas.CACHE_STORE).collect()}
    assert report["model"] == (None, False) and report["cost_usd"] == ("float", False) and report["id"] == ("string", True)
    missing = schemas.missing_tables(spark, ["store_t", "usage_t"])
    assert [r.table_name for r in missing.collect()] == ["usage_t"]
    spark.sql("DROP TABLE store_t")


def test_seeding_and_projection(spark):
    prompts = spark.createDataFrame([("say hi", '{"usage":{"input_tokens":3,"output_tokens":4}}', 1), ("say hi", "{}", 2), ("bye", "{}", 3)], "prompt string, response_json string, t long")
    rows = K.seed(prompts.withColumn("ts", F.timestamp_seconds("t")).drop("t"), "claude-sonnet-4-20250514")
    got = {r.prompt_text: r for r in rows.collect()}
    assert len(got) == 2 and {r.model for r in got.values()} == {"claude-sonnet-4"}
    assert schemas.schema_report(rows, schemas.CACHE_STORE).where("not ok").count() == 0
    flat = K.index_projection(rows.withColumn("model", F.lit(None).cast("string")))
    assert tuple(flat.columns) == schemas.INDEX_COLUMNS and {r.model for r in flat.collect()} == {"unknown"}
    back = K.decode_pending(K.encode_pending(rows))
    assert back.select("id", "embedding").exceptAll(rows.select("id", "embedding")).count() == 0


def usage_folder(spark, tmp_path, files=4):
    rnd = random.Random(4)
    path = str(tmp_path / "usage")
    rows = [(i, f"s{rnd.randrange(5)}", rnd.random() < 0.5, rnd.random() < 0.4, rnd.randrange(300), 1_700_000_000 + i * 7) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, session_id string, cache_hit boolean, failed boolean, latency_ms int, t long")
    df = df.withColumn("created_at", F.timestamp_seconds("t")).drop("t").withColumn("model", F.lit("claude-opus-4-5")).withColumn("input_tokens", F.col("latency_ms")).withColumn("output_tokens", F.lit(3)).withColumn("similarity_score", F.lit(None).cast("double"))
    for f in range(files):
        df.where((F.col("id") >= f * 100) & (F.col("id") < (f + 1) * 100)).coalesce(1).write.mode("append").parquet(path)
    return rows, cost.with_costs(spark.read.parquet(path)), path


def test_streams_equal_batches(spark, tmp_path):
    rows, batch, path = usage_folder(spark, tmp_path)
    stream = lambda: cost.with_costs(J.stream_parquet(spark, path, files_per_batch=1))
    out = str(tmp_path / "metrics")
    q = J.run_session_metrics(stream(), out, str(tmp_path / "c1"))
    assert len(q.recentProgress) >= 4
    assert sorted(J.read_session_metrics(spark, out).collect()) == sorted(A.session_metrics(batch).collect())

    J.run_daily(stream(), str(tmp_path / "daily"), str(tmp_path / "c2"))
    daily = J.read_daily(spark, str(tmp_path / "daily")).select("date", "hits", "misses")
    assert sorted(daily.collect()) == sorted(A.daily_hits(batch).collect())


def test_late_and_repeated_events_are_all_kept_once(spark, tmp_path):
    """Four files, newest first, one in a batch, every event twice: none is lost for being late."""
    rows, batch, _ = usage_folder(spark, tmp_path)
    path = str(tmp_path / "late")
    for f in (3, 2, 1, 0):
        part = batch.where((F.col("id") >= f * 100) & (F.col("id") < (f + 1) * 100))
        part.unionByName(part).coalesce(1).write.mode("append").parquet(path)
    out = str(tmp_path / "out")
    J.run_ingest(J.stream_parquet(spark, path, files_per_batch=1), out, str(tmp_path / "c"))
    got = K.read_keyed(spark, out, "id", ["created_at"])
    assert got.count() == got.select("id").distinct().count() == len(rows)
    J.run_daily(J.stream_parquet(spark, path, files_per_batch=1), str(tmp_path / "days"), str(tmp_path / "c2"))
    assert J.read_daily(spark, str(tmp_path / "days")).agg(F.sum("n_calls")).first()[0] == 2 * len(rows)


def test_rolling_failures(spark, tmp_path):
    rows, batch, _ = usage_folder(spark, tmp_path)
    got = {r.id: (r.n_recent, r.trips) for r in J.rolling_failures(batch.withColumn("service", F.col("model"))).collect()}
    fails = [(r[0], r[5]) for r in rows if r[3]]
    want = {i: sum(t - 30 < u <= t for _, u in fails) for i, t in fails}
    assert got == {i: (n, n >= 3) for i, n in want.items()}


def test_stream_resolution_against_a_snapshot(spark, tmp_path):
    texts = ["open the file", "open the file now please", "close the file", "plant a tree", "open the file"]
    rows = [(i, f"h{t}", "m", t) for i, t in enumerate(texts)]
    log = spark.createDataFrame(rows, "request_id long, prompt_hash string, model string, embed_text string").withColumn("ts", F.timestamp_seconds(F.col("request_id") + 1_700_000_000))
    store = log.where("request_id = 0").withColumnRenamed("ts", "created_at").withColumn("embedding", V.hashed_terms(F.col("embed_text")))
    path = str(tmp_path / "log")
    for i in range(5):
        log.where(F.col("request_id") == i).write.mode("append").parquet(path)
    cfg = ReuseConfig(similarity_threshold=0.6, top_k=None)
    out = str(tmp_path / "out")
    J.run_resolution(J.stream_parquet(spark, path, files_per_batch=2), store, out, str(tmp_path / "c"), cfg)
    got = {r.request_id: r.tier for r in K.read_keyed(spark, out, "request_id", ["ts"]).collect()}
    assert got == {0: "L1", 1: "L2", 2: "miss", 3: "miss", 4: "L1"}
    once = {r.request_id: r.tier for r in resolve.resolve_snapshot(log, store, cfg).collect()}
    assert once == got


def test_usage_batches_are_replaced_not_added(spark, tmp_path):
    _, batch, _ = usage_folder(spark, tmp_path)
    path = str(tmp_path / "log")
    first, second = batch.where("id < 250"), batch.where("id >= 250")
    assert B.append_usage(first, path, 0) and not B.append_usage(first, path, 0)
    assert B.append_usage(second, path, 1) and B.append_usage(second.where("id < 300"), path, 1, again=True) and B.append_usage(second, path, 1, again=True)
    rows = B.read_usage(spark, path)
    assert rows.count() == rows.select("id").distinct().count() == 400
    (tmp_path / "log" / "batch=2" / "date=2024-01-01").mkdir(parents=True)  # a batch that was interrupted
    assert B.read_usage(spark, path).count() == 400 and B.read_usage(spark, path, [1]).count() == 150
    day = rows.agg(F.min("date")).first()[0]
    plan = rows.where(F.col("date") == day)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    with pytest.raises(FileNotFoundError):
        B.read_usage(spark, str(tmp_path / "none"))


def test_bucketed_store(spark, tmp_path):
    rows, df = updates(spark)
    table = B.BucketedTable(spark, str(tmp_path / "b"), "id", ("seq",), 8)
    with pytest.raises(FileNotFoundError):
        table.read()
    for b in range(3):
        part = df.where((F.col("seq") % 3) == b)
        table.append(part, b)
        table.append(part, b)
        if b == 1:
            assert table.fold(1) == table.buckets_of({r[0] for r in rows if r[1] % 3 < 2})
    assert as_dict(table.read()) == last(rows) and table.fold(1) == []
    (tmp_path / "b" / "delta" / "batch=9" / "bucket=0").mkdir(parents=True)  # interrupted
    touched = table.fold(2)
    assert as_dict(table.read()) == last(rows) and 0 < len(touched) <= 8
    table.append(spark.createDataFrame([("hot", 500, "later"), (None, 1, "no key")], df.schema), 3)
    assert table.fold(3) == sorted({*table.buckets_of(["hot"]), *table.buckets_of([None])})
    assert as_dict(table.read()) == {**last(rows), "hot": "later", None: "no key"}
    found = table.lookup(["hot", "k1", "absent"])
    assert as_dict(found) == {k: v for k, v in as_dict(table.read()).items() if k in ("hot", "k1")}
    scans = [line for line in found._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line]
    assert scans and all("bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_narrow_winners(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(("a", "b", None, f"k{rnd.randrange(5)}")), rnd.choice((None, *range(-3, 4))), rnd.choice((None, 1, 2)), f"v{i % 40}", [float(i % 7)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, t long, n long, v string, e array<double>").withColumn("ts", F.timestamp_micros("t"))
    low = lambda x: -(10**9) if x is None else x
    for order, rank in ((["t"], lambda r: low(r[1])), (["ts", "n"], lambda r: (low(r[1]), low(r[2]))), (["n", "t"], lambda r: (low(r[2]), low(r[1])))):
        got = W.latest_rows(df, "id", order)
        best = {}
        for r in rows:
            best[r[0]] = max(best.get(r[0], rank(r)), rank(r))
        found = got.collect()
        assert {r.id for r in found} == set(best) and len(found) == len(best)
        assert all(rank((r.id, r.t, r.n)) == best[r.id] for r in found)
        assert sorted(map(str, found)) == sorted(map(str, W.latest_rows(df.repartition(7), "id", order).collect()))
        assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert W.latest_rows(df, "id", ["v"]) is None
    firsts = W.first_of(df.where("t IS NOT NULL AND n IS NOT NULL"), "id", "ts", "n")
    want = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            want.setdefault(r[0], []).append((r[1], r[2]))
    got = {r.id: (r.us, r.first_id, r.n_requests) for r in firsts.withColumn("us", F.unix_micros("first_ts")).collect()}
    assert got == {k: (*min(v), len(v)) for k, v in want.items()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_whose_key_stands_once_do_not_move(spark, tmp_path, monkeypatch):
    """A keyed table without repeated keys is written and read without a shuffle of its rows; repeated ones are folded as ever."""
    rows = spark.createDataFrame([(f"k{i}", i, "wide " * 50) for i in range(40)], "id string, seq long, payload string")
    K.write_batch(rows, str(tmp_path), 0, "id", ["seq"])
    assert "Exchange" not in plan(K.read_keyed(spark, str(tmp_path), "id", ["seq"]))
    more = [("k1", 90, "new"), ("k1", 80, "old"), (None, None, "a"), (None, 3, "b"), (None, 3, "b"), ("k2", -1, "late"), ("lone", None, None)]
    K.write_batch(spark.createDataFrame(more, rows.schema), str(tmp_path), 1, "id", ["seq"], again=True)
    want = {(r.id, r.seq, r.payload) for r in rows.collect()} - {("k1", 1, "wide " * 50)} | {("k1", 90, "new"), (None, 3, "b"), ("lone", None, None)}
    found = [tuple(r) for r in K.read_keyed(spark, str(tmp_path), "id", ["seq"]).collect()]
    assert len(found) == len(want) and set(found) == want
    monkeypatch.setattr(W, "_REPEATED", 0)  # more repeated keys than may be sent: all rows go by the key
    assert set(map(tuple, K.read_keyed(spark, str(tmp_path), "id", ["seq"]).collect())) == want
    assert W.apart(rows.unionByName(rows), "id") is None


def test_change_feed_and_its_application(spark):
    kind = "id string, a string, b long"
    old = spark.createDataFrame([("x", "1", 1), ("y", "1", None), ("z", None, 3), (None, "n", 1), ("same", None, None)], kind)
    new = spark.createDataFrame([("x", "1", 2), ("y", "1", None), ("w", "5", 5), (None, "m", 1), ("same", None, None)], kind)
    changes = D.change_feed(old, new, "id")
    assert {tuple(r) for r in changes.collect()} == {("update", "x", "1", 2), ("delete", "z", None, None), ("insert", "w", "5", 5), ("update", None, "m", 1)}
    once = D.apply_changes(old, changes, "id")
    assert sorted(map(str, once.collect())) == sorted(map(str, new.collect())) == sorted(map(str, D.apply_changes(once, changes, "id").collect()))
    assert D.change_feed(old, old, "id").count() == 0
    assert {r.change for r in D.change_feed(old, new, "id", ["a"]).collect() if r.id == "x"} == set()


def test_chunks_in_any_order_and_responses_that_never_end(spark, tmp_path):
    rnd = random.Random(3)
    whole = {f"r{k}": "".join(rnd.choice("abc\nevent: message_stop") for _ in range(rnd.randrange(1, 60))) for k in range(12)}
    rows = []
    for r, text in whole.items():
        parts = [text[i : i + 7] for i in range(0, len(text), 7)]
        rows += [(r, k, p, k == len(parts) - 1 and r != "r3") for k, p in enumerate(parts)]
    rows += rows[::4]
    rows = [r for r in rows if r[:2] != ("r5", 0)] + [("r6", 0, None, False)]  # one lacks its first chunk
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "response_id string, seq long, data string, last boolean")
    merged = {r.response_id: r for r in CH.merge_chunks(df).collect()}
    assert {r for r, m in merged.items() if not m.ended} == {"r3", "r5"}
    assert all(merged[r].raw == text for r, text in whole.items() if r != "r5")
    path = str(tmp_path / "chunks")
    for i in range(3):
        spark.createDataFrame(rows[i::3], df.schema).coalesce(1).write.mode("append").parquet(path)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "c")
    CH.run_assembly(J.stream_parquet(spark, path, files_per_batch=1), out, ckpt, patience_ms=1)
    time.sleep(1.2)
    spark.createDataFrame([("late", 0, "z", True)], df.schema).write.mode("append").parquet(path)
    CH.run_assembly(J.stream_parquet(spark, path, files_per_batch=1), out, ckpt, patience_ms=1)
    got = {r.response_id: (r.raw, r.ended) for r in CH.read_assembled(spark, out).collect()}
    assert got["late"] == ("z", True) and got["r3"][1] is False
    assert all(got[r] == (text, True) for r, text in whole.items() if r not in ("r3", "r5") and got[r][1])


def test_a_base_of_counts_holds_a_session_and_latency_once(spark, tmp_path):
    """Batches are summed as they lie, and what they are folded into does not grow with their number."""
    path = str(tmp_path / "counts")
    rows = spark.createDataFrame([("a", 5, True, 1.0), ("a", 5, False, 2.0), ("b", 7, True, 4.0)],
                                 "session_id string, latency_ms int, cache_hit boolean, cost_usd double")
    sink = J.counts_sink(path, J.session_histogram, "session_id", "latency_ms")
    for batch in range(3):
        sink(rows, batch)
        sink(rows, batch)  # a repeated batch replaces its own
    assert K.read_parts(spark, path).count() == 6
    before = sorted(map(tuple, J.read_session_metrics(spark, path).collect()))
    folded = J.folded_histogram(K.read_parts(spark, path)).withColumn("cell", F.concat_ws("|", "session_id", "latency_ms"))
    K.write_base(folded, path, 2)
    assert K.read_parts(spark, path).count() == 2
    assert sorted(map(tuple, J.read_session_metrics(spark, path).collect())) == before
    sink(rows, 3)
    assert {r.session_id: r.total_calls for r in J.read_session_metrics(spark, path).collect()} == {"a": 8, "b": 4}


def test_files_of_a_batch_follow_the_number_of_files(spark, tmp_path):
    from echoledger.plans.queries import _files_of_a_batch

    for n, want in ((4, 1), (9, 3)):
        spark.range(90).repartition(n).write.parquet(str(tmp_path / str(n)))
        assert _files_of_a_batch(spark, str(tmp_path / str(n)), 4) == want


def test_assembly_works_through_its_state_once_a_batch(spark, tmp_path, monkeypatch):
    """The rows that the sink looks through for the latest of a key come from a table, not from the stateful operator."""
    plans = []
    write = K.write_batch
    monkeypatch.setattr(K, "write_batch", lambda rows, *a, **k: (plans.append(rows._jdf.queryExecution().logical().toString()), write(rows, *a, **k)))
    rows = [("r", 0, "a", False), ("r", 1, "b", True)]
    path, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    spark.createDataFrame(rows, "response_id string, seq long, data string, last boolean").coalesce(1).write.parquet(path)
    CH.run_assembly(J.stream_parquet(spark, path), out, ckpt)
    assert plans and not any("TransformWithState" in p or "RDD" in p for p in plans)
    assert [(r.raw, r.ended) for r in CH.read_assembled(spark, out).collect()] == [("ab", True)]
