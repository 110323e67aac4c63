"""The registered queries: (spark, sf_dir) -> DataFrame over the given tables."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from echoledger import schemas
from echoledger.config import DEFAULTS
from echoledger.functions import canonical as C, guard as G, responses as R, stats, vectors as V
from echoledger.operators import analytics as A, cost, quality as Q, requests as N, resolve, responses as RS
from echoledger.operators import buckets as B, feed as D, indexed as X, scored as SC, similarity as S, store as K
from echoledger.session import bound_batches, cut_lineage
from echoledger.sources import logs, tables as T
from echoledger.streaming import chunks as CH, jobs as J

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The nearest rows that the cut before the filters keeps.
TOP_ROWS = dataclasses.replace(DEFAULTS, top_k=5)


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def bounded(spark: SparkSession, sf: str) -> DataFrame:
        bound_batches(spark)
        return fn(spark, sf)

    QUERIES[fn.__name__] = bounded
    return bounded


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return cost.with_costs(T.usage(spark, sf))


def document_log(spark: SparkSession, sf: str, *unread: str) -> DataFrame:
    """Documents as a canonical request log in document order, without the columns that the caller does not read."""
    docs = T.document_requests(spark, sf)
    body = F.to_json(
        F.struct(
            F.col("model"),
            F.array(F.struct(F.lit("user").alias("role"), F.col("prompt_text").alias("content"))).alias("messages"),
        )
    )
    log = docs.select(
        "request_id", "session_id", F.timestamp_seconds(F.col("request_id") + 1_704_067_200).alias("ts"), body.alias("body")
    )
    # a table of canonical requests: parsed once, read by column afterwards
    return cut_lineage(N.canonicalize(log).drop("body", *unread))


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents prepared for similarity: id, arrival order, vector, family, guard features."""
    docs = T.document_requests(spark, sf).withColumn("family", C.model_family(F.col("model")))
    rows = docs.withColumn("vec", V.hashed_terms(F.col("prompt_text")))
    return S.materialised(S.prepare(rows, "request_id", F.col("request_id"), "vec", "family", "prompt_text"))


def snapshot_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(requests, store): odd documents ask, even ones are stored once per key."""
    log = document_log(spark, sf, "prompt_text")
    held = log.where(F.col("request_id") % 2 == 0)
    store = K.latest_by_key(
        held.select("prompt_hash", "request_id", "model", "embed_text", F.col("ts").alias("created_at"),
                    (-F.col("request_id")).alias("age")),
        "prompt_hash", ["age"], again=True,
    )
    return log.where(F.col("request_id") % 2 == 1), store.withColumn("embedding", V.hashed_terms(F.col("embed_text")))


def stored_documents(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    """Store rows of all distinct documents, with an answer of known size. log: what document_log gives, where it is there already."""
    log = document_log(spark, sf) if log is None else log
    answer = F.to_json(
        F.struct(
            F.lit("message").alias("type"),
            F.array(F.struct(F.lit("text").alias("type"), F.col("prompt_hash").alias("text"))).alias("content"),
            F.struct(F.length("embed_text").alias("input_tokens"), (F.col("request_id") % 97).alias("output_tokens")).alias("usage"),
        )
    )
    oldest = K.latest_by_key(log.withColumn("age", -F.col("request_id")), "prompt_hash", ["age"], again=True).drop("age")
    rows = K.store_rows(oldest.withColumn("response_json", answer))
    return rows.withColumn("doc", (F.unix_seconds("created_at") - 1_704_067_200))


# ---------------------------------------------------------------- usage analytics


@query
def stats_all_time(spark, sf):
    return A.all_time_stats(facts(spark, sf))


@query
def session_stats(spark, sf):
    return A.session_stats(facts(spark, sf))


@query
def daily_hits(spark, sf):
    return A.daily_hits(T.usage(spark, sf))


@query
def hit_rate(spark, sf):
    return A.hit_rate(T.usage(spark, sf))


@query
def total_saved(spark, sf):
    return A.total_saved(facts(spark, sf))


@query
def daily_summary(spark, sf):
    return A.daily_summary(facts(spark, sf))


@query
def cost_by_model(spark, sf):
    return cost.cost_by_model(T.usage(spark, sf))


@query
def rate_lookup(spark, sf):
    return cost.rates_by_join(T.usage(spark, sf), cost.rate_table(spark))


@query
def savings_model(spark, sf):
    return cost.savings_model(T.usage(spark, sf), "claude-sonnet-4-6", 1500, 350)


@query
def session_metrics(spark, sf):
    return A.session_metrics(facts(spark, sf))


@query
def metric_rows(spark, sf):
    return A.metric_rows(A.session_metrics(facts(spark, sf)))


@query
def session_p95(spark, sf):
    return A.p95_exclusive(T.usage(spark, sf), ["session_id"], "latency_ms")


@query
def latency_nearest_rank(spark, sf):
    return A.nearest_rank(T.usage(spark, sf), ["model"], "latency_ms", 0.95)


@query
def latency_floor_rank(spark, sf):
    return A.floor_rank(T.usage(spark, sf), [], "latency_ms", 0.95)


@query
def newest_latencies(spark, sf):
    return A.newest(T.usage(spark, sf), ["session_id"], ["created_at", "id"], 20).select("session_id", "id", "latency_ms")


@query
def running_totals(spark, sf):
    return A.running_totals(facts(spark, sf))


@query
def fact_invariants(spark, sf):
    return A.fact_violations(facts(spark, sf))


@query
def fact_faults(spark, sf):
    """The same checks, tiers included, over facts that break every rule somewhere."""
    i = F.col("id")
    broken = facts(spark, sf).withColumn(
        "cost_saved_usd", F.when(i % 37 == 0, F.lit(0.0)).when(i % 41 == 0, F.col("cost_usd")).otherwise(F.col("cost_saved_usd"))
    ).withColumn("tier", F.when(F.col("similarity_score") == 1.0, "L1").when(F.col("cache_hit"), "L2").otherwise("miss")).withColumn(
        "similarity_score", F.when(i % 43 != 0, F.when(i % 47 == 0, F.lit(0.5)).otherwise(F.col("similarity_score"))))
    return A.fact_violations(broken, "tier")


@query
def tail_lines(spark, sf):
    return A.tail_lines(facts(spark, sf)).select("id", "line")


@query
def failure_rolling(spark, sf):
    calls = T.usage(spark, sf).withColumn("service", F.col("model"))
    return J.rolling_failures(calls, window_s=3600).drop("created_at")


# ---------------------------------------------------------------- requests


@query
def eligible_requests(spark, sf):
    return logs.eligible(T.document_bodies(spark, sf)).select("request_id")


@query
def model_family(spark, sf):
    return T.document_requests(spark, sf).select("request_id", C.model_family(F.col("model")).alias("model"))


@query
def canonical_hash(spark, sf):
    return N.canonicalize(T.document_bodies(spark, sf)).select("request_id", "prompt_hash", "model")


@query
def request_rejects(spark, sf):
    return N.rejects(T.document_bodies(spark, sf)).select("request_id", "reject_reason")


@query
def embedding_text(spark, sf):
    return N.canonicalize(T.document_bodies(spark, sf)).select("request_id", F.sha2("embed_text", 256).alias("embed_hash"))


@query
def conversation_embedding_text(spark, sf):
    return N.canonicalize(T.conversation_requests(spark, sf)).select(
        "conv_id", F.sha2("embed_text", 256).alias("embed_hash")
    )


@query
def exact_repeat_attribution(spark, sf):
    return resolve.exact_repeats(document_log(spark, sf)).select("request_id", "first_id", "is_repeat")


@query
def exact_lookup(spark, sf):
    log = document_log(spark, sf)
    store = log.where(F.col("request_id") % 2 == 0).select("prompt_hash").distinct()
    return resolve.exact_lookup(log.where(F.col("request_id") % 2 == 1), store).select("request_id", "similarity_score")


@query
def top_prompts(spark, sf):
    """Reuse counts by prompt; the report keeps the top n, here every reused prompt."""
    log = document_log(spark, sf)
    repeats = resolve.exact_repeats(log).where("is_repeat").withColumn("matched_hash", F.col("prompt_hash"))
    store = K.latest_by_key(
        log.select("prompt_hash", F.sha2("embed_text", 256).alias("prompt_text"), F.col("ts").alias("created_at")),
        "prompt_hash", ["created_at"],
    )
    top = A.reuse_counts(repeats, store)
    return top.select(
        F.col("prompt_text").alias("text_hash"), "hit_count", (F.unix_seconds("last_hit_at") - 1_704_067_200).alias("last_id")
    )


@query
def top_prompts_limited(spark, sf):
    log = document_log(spark, sf)
    repeats = resolve.exact_repeats(log).where("is_repeat").withColumn("matched_hash", F.col("prompt_hash"))
    store = K.latest_by_key(
        log.select("prompt_hash", "prompt_text", F.col("ts").alias("created_at")), "prompt_hash", ["created_at"]
    )
    return A.top_prompts(repeats, store, 20).select("prompt_hash", F.sha2("prompt_text", 256).alias("text_hash"), "hit_count")


# ---------------------------------------------------------------- store


@query
def store_upsert(spark, sf):
    events = T.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("payload"), "ts"
    )
    old, new = events.where(F.col("version") % 2 == 0), events.where(F.col("version") % 2 == 1)
    return K.upsert(old, new, "id", ["ts", "version"]).drop("ts")


@query
def store_append(spark, sf):
    """Two batches, each written twice, the first folded in between; read once."""
    events = T.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("payload"),
        F.col("ts").cast("timestamp").alias("ts"))
    table = B.BucketedTable(spark, J.fresh(spark, "store-append")[0], "id", ("ts", "version"))
    for batch in (0, 0, 1, 1):
        table.append(events.where(F.col("version") % 2 == batch), batch)
        table.fold(0)
    return table.read().drop("ts")


@query
def usage_append(spark, sf):
    """Every batch of usage rows goes out twice and counts once."""
    rows = facts(spark, sf)
    folder, _ = J.fresh(spark, "usage-append")
    for batch in (0, 1, 0, 2, 1, 2):
        B.append_usage(rows.where(F.col("id") % 3 == batch), folder, batch, again=batch == 1)
    return B.read_usage(spark, folder).select("date", "batch", "id", "session_id", "cache_hit", F.round("cost_usd", 6).alias("cost_usd"))


def _document_versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents: some are new, some are gone, some have another text or source."""
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text"), "source")
    changed = F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text"))
    source = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("source"))
    old = docs.where(F.col("id") % 7 != 0)
    return old, docs.where(F.col("id") % 5 != 0).select("id", changed.alias("text"), source.alias("source"))


@query
def change_feed(spark, sf):
    return D.change_feed(*_document_versions(spark, sf), "id")


@query
def index_after_changes(spark, sf):
    """The index follows the feed as a stream: changes replace rows, deletions leave a tombstone."""
    old, new = _document_versions(spark, sf)
    out, ckpt = J.fresh(spark, "index-changes")
    feed_dir, _ = J.fresh(spark, "feed")
    first = old.select(F.lit(D.INSERT).alias("change"), "id", "text", "source")
    first.withColumn("version", F.lit(0)).write.parquet(feed_dir)
    D.change_feed(old, new, "id").withColumn("version", F.lit(1)).write.mode("append").parquet(feed_dir)
    J.run(J.stream_parquet(spark, feed_dir, files_per_batch=2), J.keyed_sink(out, "id", ["version"]), ckpt)
    return D.without_deleted(K.read_keyed(spark, out, "id", ["version"])).drop("version")


@query
def insert_if_absent(spark, sf):
    """Keys of all even documents are there; those of all odd ones come in."""
    docs = T.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("id"))
    old = docs.where("doc_id % 2 = 0").select("id").distinct().withColumn("origin", F.lit("old"))
    new = docs.where("doc_id % 2 = 1").select("id").distinct().withColumn("origin", F.lit("new"))
    return K.insert_if_absent(old, new, "id")


@query
def store_index_reconcile(spark, sf):
    """Store: the keys of even documents; index: those of odd ones. Copies stand in both."""
    docs = T.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("prompt_hash"))
    store, index = (docs.where(F.col("doc_id") % 2 == r).select("prompt_hash").distinct() for r in (0, 1))
    return resolve.reconcile(store, index).withColumnRenamed("prompt_hash", "id")


@query
def index_projection(spark, sf):
    rows = stored_documents(spark, sf)
    return K.index_projection(rows.withColumn("id", F.col("doc"))).select("id", "model", "cost_usd")


@query
def pending_round_trip(spark, sf):
    rows = stored_documents(spark, sf).withColumn("id", F.col("doc"))
    back = K.decode_pending(K.encode_pending(rows))
    used = F.filter("embedding", lambda x: x != 0)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    all_docs = document_log(spark, sf).select("request_id", "prompt_hash")
    return back.join(all_docs, "prompt_hash").where(F.size(used) > 0).select(
        "request_id", F.size(used).cast("long").alias("n_dims"), F.round(norm, 4).alias("norm")
    )


@query
def seed_store(spark, sf):
    docs = T.table(spark, sf, "documents")
    prompts = docs.select(
        F.col("text").alias("prompt"), F.lit("{}").alias("response_json"), F.timestamp_seconds(F.lit(1_704_067_200) - F.col("doc_id")).alias("ts")
    )
    store = K.seed(prompts, "claude-sonnet-4")
    counts = docs.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n_prompts"))
    seeded = store.select(
        (F.lit(1_704_067_200) - F.unix_seconds("created_at")).alias("first_id"),
        F.sha2(C.embedding_text(F.col("prompt_text")), 256).alias("text_hash"),
        F.size("embedding").alias("n_dims"),
    )
    return seeded.join(counts, "text_hash").select("first_id", "text_hash", "n_prompts", "n_dims")


@query
def schema_check(spark, sf):
    return schemas.column_fill_report(facts(spark, sf), schemas.USAGE_LOG)


# ---------------------------------------------------------------- responses


@query
def stream_tokens(spark, sf):
    return RS.with_tokens(T.response_buffers(spark, sf)).select("response_id", "input_tokens", "output_tokens")


@query
def message_tokens(spark, sf):
    return RS.with_tokens(T.response_messages(spark, sf)).select("response_id", "input_tokens", "output_tokens")


@query
def assemble_message(spark, sf):
    built = RS.assembled(T.response_buffers(spark, sf)).withColumn("v", F.try_parse_json("message"))
    v = F.col("v")
    return built.select(
        "response_id",
        F.sha2(F.try_variant_get(v, "$.content[0].text", "string"), 256).alias("text_hash"),
        F.to_json(F.try_variant_get(v, "$.content[1].input", "variant")).alias("tool_input"),
        F.try_variant_get(v, "$.content[1].partial_json_unparsed", "string").alias("leftover"),
        F.try_variant_get(v, "$.stop_reason", "string").alias("stop_reason"),
        F.to_json(F.try_variant_get(v, "$.usage", "variant")).alias("usage"),
        F.size(F.try_variant_get(v, "$.content", "array<variant>")).alias("n_blocks"),
    )


def _message_parts(built: DataFrame) -> DataFrame:
    """What callers see of assembled messages."""
    v = F.col("v")
    return built.withColumn("v", F.try_parse_json("message")).select(
        "response_id",
        F.sha2(F.try_variant_get(v, "$.content[0].text", "string"), 256).alias("text_hash"),
        F.to_json(F.try_variant_get(v, "$.content[1].input", "variant")).alias("tool_input"),
        F.try_variant_get(v, "$.content[1].partial_json_unparsed", "string").alias("leftover"),
        F.try_variant_get(v, "$.stop_reason", "string").alias("stop_reason"),
        F.to_json(F.try_variant_get(v, "$.usage", "variant")).alias("usage"),
        F.size(F.try_variant_get(v, "$.content", "array<variant>")).alias("n_blocks"),
    )


@query
def chunk_assembly(spark, sf):
    """Chunks in any order and some of them twice, merged in one batch; unfinished answers stay out."""
    merged = CH.merge_chunks(T.response_chunks(spark, sf)).where("ended")
    return _message_parts(RS.assembled(RS.complete_only(merged.withColumn("status", F.lit(200)))))


@query
def stream_assembly(spark, sf):
    """The same chunks as a stream of four batches that cut across all responses."""
    out, ckpt = J.fresh(spark, "assembly")
    folder, _ = J.fresh(spark, "chunks")
    chunks = T.response_chunks(spark, sf)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.repartition(4 * parts, "response_id", "seq").write.parquet(folder)
    CH.run_assembly(J.stream_parquet(spark, folder, files_per_batch=_files_of_a_batch(spark, folder, 4)), out, ckpt)
    merged = CH.read_assembled(spark, out).where("ended").withColumn("status", F.lit(200))
    return _message_parts(RS.assembled(RS.complete_only(merged)))


@query
def expand_message(spark, sf):
    return RS.event_rows(T.response_messages(spark, sf)).select("response_id", "block", "step", "name")


@query
def complete_responses(spark, sf):
    buffers = T.response_buffers(spark, sf).withColumn("status", F.lit(200))
    return RS.complete_only(buffers).select("response_id")


@query
def replay_form(spark, sf):
    """Stored form against asked form; tells the form that came out and whether it was converted."""
    sse = T.response_buffers(spark, sf).where(F.col("conv_id") % 2 == 1).select("response_id", "turn", "raw")
    messages = T.response_messages(spark, sf).where(F.col("conv_id") % 2 == 0).select("response_id", "turn", "raw")
    both = sse.unionByName(messages)
    out = both.withColumn("sent", R.replay(F.col("raw"), F.col("turn") % 3 == 0))
    return out.select(
        "response_id",
        F.when(R.is_json_form(F.col("sent")), "json").otherwise("stream").alias("form"),
        (F.col("sent") != F.col("raw")).alias("converted"),
    )


@query
def round_trip(spark, sf):
    return RS.round_trip_report(T.response_messages(spark, sf))


# ---------------------------------------------------------------- vectors and similarity


@query
def doc_vectors(spark, sf):
    docs = T.document_requests(spark, sf).select("request_id", V.hashed_terms(F.col("prompt_text")).alias("v"))
    return docs.select("request_id", F.posexplode("v").alias("bucket", "x")).where("x > 0").select(
        "request_id", F.col("bucket").cast("long").alias("bucket"), F.round("x", 6).alias("x")
    )


@query
def unit_vectors(spark, sf):
    e = T.table(spark, sf, "embeddings").withColumn("u", V.unit(F.col("embedding")))
    norm = F.sqrt(V.dot(F.col("embedding"), F.col("embedding")))
    return e.select("vec_id", F.round(norm, 4).alias("norm"), F.round(F.col("u")[0], 6).alias("first_value"))


@query
def contradiction_probability(spark, sf):
    """Scorer arithmetic over logit rows of three, cut from all 64 values of each vector."""
    logits = F.array(*[
        F.array(*[F.col("embedding")[r + c].cast("double") for c in range(3)]) for r in (*range(0, 61, 3), 61)
    ])
    p = V.contradiction_probability(logits, 0)
    return T.table(spark, sf, "embeddings").select("vec_id", p.alias("p")).select(
        "vec_id", F.round("p", 6).alias("probability"), (F.col("p") >= DEFAULTS.contradiction_threshold).alias("contradicts")
    )


def _matched(found: DataFrame) -> DataFrame:
    return found.select(F.col("pid").alias("request_id"), F.col("sid").alias("matched_id"), F.round("score", 6).alias("score"))


@query
def similarity_profile(spark, sf):
    docs = document_vectors(spark, sf)
    return S.match_profile(docs, docs, DEFAULTS, earlier=True).withColumnRenamed("pid", "request_id").withColumn(
        "top_score", F.round("top_score", 6)
    )


@query
def similarity_best(spark, sf):
    docs = document_vectors(spark, sf)
    return _matched(S.best_match(docs, docs, DEFAULTS, earlier=True))


@query
def similarity_indexed(spark, sf):
    """The best match by the inverted index instead of cells."""
    docs = document_vectors(spark, sf)
    return _matched(X.best_match(docs, docs, DEFAULTS, earlier=True))


@query
def similarity_top(spark, sf):
    docs = document_vectors(spark, sf)
    return _matched(S.best_of_top(S.top_candidates(docs, docs, TOP_ROWS, earlier=True)))


@query
def similarity_newest(spark, sf):
    docs = document_vectors(spark, sf)
    asked, held = docs.where(F.col("id") % 2 == 1), docs.where(F.col("id") % 2 == 0)
    return _matched(S.best_match(asked, held, dataclasses.replace(DEFAULTS, max_store_rows=300)))


@query
def similarity_newest_blocks(spark, sf):
    """The same bound, through blocks instead of a broadcast store."""
    docs = document_vectors(spark, sf)
    asked, held = docs.where(F.col("id") % 2 == 1), docs.where(F.col("id") % 2 == 0)
    return _matched(S.best_match(asked, held, dataclasses.replace(DEFAULTS, max_store_rows=300, broadcast_rows=0, block_rows=100)))


@query
def similarity_scored(spark, sf):
    """Best match under a pair scorer that refuses by the texts' lengths."""
    docs = T.document_requests(spark, sf).withColumn("family", C.model_family(F.col("model")))
    rows = docs.withColumn("vec", V.hashed_terms(F.col("prompt_text")))
    held = S.materialised(S.prepare(rows, "request_id", F.col("request_id"), "vec", "family", "prompt_text", keep_text=True))

    def make_predict():
        return lambda a, b: [[4.0, 0.0] if (len(x) + len(y)) % 3 == 0 else [0.0, 4.0] for x, y in zip(a, b)]

    found = SC.best_unrefused(held, held, SC.contradiction_udf(make_predict, 0), DEFAULTS, earlier=True)
    return _matched(found).join(found.select(F.col("pid").alias("request_id"), "n_failed"), "request_id")


@query
def embedding_best(spark, sf):
    rows = T.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.lit("").alias("family"), F.lit("").alias("text")
    )
    e = S.materialised(S.prepare(rows, "vec_id", F.col("vec_id"), "vec", "family", "text", guarded=False))
    cfg = dataclasses.replace(DEFAULTS, similarity_threshold=0.30, embedding_dims=64)
    return _matched(S.best_match(e, e, cfg, earlier=True))


def _snapshot(spark, sf):
    requests, store = snapshot_sides(spark, sf)
    out = resolve.resolve_snapshot(requests, store, DEFAULTS)
    ids = store.select(F.col("prompt_hash").alias("matched_hash"), F.col("request_id").alias("matched_id"))
    return out, ids


@query
def tiered_resolution(spark, sf):
    out, ids = _snapshot(spark, sf)
    return out.join(ids, "matched_hash", "left").select(
        "request_id", "tier", "matched_id", F.round("similarity_score", 6).alias("score")
    )


@query
def phase_report(spark, sf):
    out, _ = _snapshot(spark, sf)
    phases = T.table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), F.col("lang").alias("phase"))
    return Q.phase_report(out.join(phases, "request_id"))


@query
def replay_attribution(spark, sf):
    log = document_log(spark, sf)
    out = resolve.replay_log(log, DEFAULTS)
    served = F.when(F.col("tier") != "miss", F.col("served_id"))
    return out.select("request_id", "tier", served.alias("matched_id"), F.round("similarity_score", 6).alias("score"))


@query
def replay_failed_embeds(spark, sf):
    """Replay where texts of every eleventh length get no vector: they and their repeats miss and are never stored."""
    log = document_log(spark, sf)
    vector = lambda text: F.when(F.length(text) % 11 != 0, V.hashed_terms(text))
    out = resolve.replay_log(log, DEFAULTS, vector)
    return out.select(
        "request_id", "tier", F.when(F.col("tier") != "miss", F.col("served_id")).alias("matched_id"),
        F.round("similarity_score", 6).alias("score"))


@query
def usage_ledger(spark, sf):
    """Usage facts of the replayed log, priced, with the links a hit needs."""
    log = document_log(spark, sf)
    out = resolve.replay_log(log, DEFAULTS)
    answers = stored_documents(spark, sf, log).select("prompt_hash", "input_tokens", "output_tokens")
    ledger = resolve.usage_facts(out, answers, F.length("embed_text") % 1000)
    return ledger.select(
        "id", "request_id", "tier", "cache_hit", "model", "input_tokens", "output_tokens", "latency_ms",
        *[F.round(c, 6).alias(c) for c in ("cost_usd", "cost_saved_usd", "spend_usd")],
    )


# ---------------------------------------------------------------- guard and quality


def _guarded_pairs(spark, sf):
    # features once for both sides, on rows dealt by document; what is joined afterwards is narrow
    docs = cut_lineage(T.dealt(T.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", G.features(F.col("text")).alias("g")))
    left = docs.select(F.col("doc_id").alias("pair_id"), F.col("g").alias("ga"))
    right = docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("g").alias("gb"))
    return left.join(right, "pair_id")


@query
def guard_negation(spark, sf):
    return _guarded_pairs(spark, sf).select("pair_id", G.negation_conflict(F.col("ga"), F.col("gb")).alias("neg_conflict"))


@query
def guard_difference(spark, sf):
    a, b = F.col("ga.words"), F.col("gb.words")
    return _guarded_pairs(spark, sf).select(
        "pair_id", F.size(G.only_in(a, b)).alias("only_a"), F.size(G.only_in(b, a)).alias("only_b")
    )


@query
def guard_words(spark, sf):
    return _guarded_pairs(spark, sf).select("pair_id", G.word_conflict(F.col("ga"), F.col("gb")).alias("word_conflict"))


@query
def guard_direction(spark, sf):
    way = G.direction(G.tokens(F.col("text")))
    return T.dealt(T.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", way.alias("w")).select("doc_id", "w.source", "w.target")


@query
def guard_safe(spark, sf):
    return _guarded_pairs(spark, sf).select("pair_id", G.is_safe(F.col("ga"), F.col("gb")).alias("safe"))


def _scored(spark, sf):
    return Q.score_pairs(T.adjacent_pairs(spark, sf))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in df.columns])


@query
def pair_scores(spark, sf):
    return _scored(spark, sf).select("pair_id", F.round("score", 6).alias("score"), "safe")


@query
def confusion_sweep(spark, sf):
    return _rounded(Q.confusion_sweep(_scored(spark, sf)))


@query
def best_threshold(spark, sf):
    return Q.best_thresholds(Q.confusion_sweep(_scored(spark, sf))).withColumn("recall", F.round("recall", 6))


@query
def generalization(spark, sf):
    return _rounded(Q.generalization(_scored(spark, sf)).select("eval_set", "role", "tp", "fp", "n_hit", "precision", "recall"))


@query
def recall_report(spark, sf):
    return Q.recall_report(_scored(spark, sf))


@query
def wilson_ci(spark, sf):
    marked = T.table(spark, sf, "labels").join(T.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    counts = marked.groupBy(F.col("source").alias("grp")).agg(
        F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n")
    )
    ci = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("grp", "k", "n", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


@query
def pair_scan(spark, sf):
    """Labelled pairs read back from text lines, with blank and comment lines among them."""
    folder, _ = J.fresh(spark, "pairs")
    pairs = T.adjacent_pairs(spark, sf)
    fields = [F.concat(F.lit(f'"{c}":'), F.to_json(F.col(c).cast("variant"))) for c in ("a", "b", "expect")]
    line = F.concat(F.lit("  {"), F.concat_ws(", ", *fields), F.when(F.col("pair_id") % 5 == 0, F.concat(F.lit(', "note":'), F.col("pair_id"))).otherwise(F.lit("")), F.lit("}\t"))
    note = F.when(F.col("pair_id") % 7 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" // pair "), F.col("pair_id")))
    pairs.select(F.explode(F.array(line, note)).alias("value")).write.text(folder)
    back = logs.read_pairs(spark, folder)
    return back.groupBy("expect").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.size("keys") == 4).alias("n_odd"),
        F.sum(F.length("a") + 2 * F.length("b")).alias("n_chars"), F.countDistinct(F.sha2(F.concat("a", F.lit("|"), "b"), 256)).alias("n_distinct"))


@query
def pair_faults(spark, sf):
    """Pair sets with labels, texts and keys that break the rules."""
    pairs = T.adjacent_pairs(spark, sf)
    expect = F.when(F.col("pair_id") % 13 == 0, "maybe").when(F.col("pair_id") % 17 != 0, F.col("expect"))
    keys = F.when(F.col("pair_id") % 19 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("expect")))
    b = F.when(F.col("pair_id") % 23 == 0, F.lit(" \t")).otherwise(F.col("b"))
    broken = pairs.withColumn("expect", expect).withColumn("keys", keys).withColumn("b", b)
    return Q.pair_integrity(broken, ("eval_set",)).drop("repeated_pairs")


@query
def sweep_intervals(spark, sf):
    found = Q.with_intervals(Q.confusion_sweep(_scored(spark, sf)))
    return found.select("pipeline", "thr", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("recall_low", "recall_high", "false_hit_low", "false_hit_high")])


@query
def pair_integrity(spark, sf):
    return Q.pair_integrity(T.adjacent_pairs(spark, sf), ("eval_set",)).drop("odd_keys")


# ---------------------------------------------------------------- streams


def _usage_stream(spark, sf):
    return cost.with_costs(T.usage_columns(J.stream_parquet(spark, sf, "events.parquet")))


def _files_of_a_batch(spark, folder, batches):
    """Files that one of so many batches reads."""
    return max(1, -(-len(spark.read.parquet(folder).inputFiles()) // batches))


def _backwards(spark, sf):
    """The usage stream in files of falling time, in four batches however many files there are."""
    folder, _ = J.fresh(spark, "backwards")
    events = T.table(spark, sf, "events")
    for part in range(4):
        quarter = F.floor((F.dayofmonth("ts") - 1) / 8)
        events.where(quarter == 3 - part).write.mode("append").parquet(folder)
    return cost.with_costs(T.usage_columns(J.stream_parquet(spark, folder, files_per_batch=_files_of_a_batch(spark, folder, 4))))


@query
def stream_session_metrics(spark, sf):
    out, ckpt = J.fresh(spark, "session-metrics")
    J.run_session_metrics(_usage_stream(spark, sf), out, ckpt)
    return J.read_session_metrics(spark, out)


@query
def stream_metric_rows(spark, sf):
    """Metric rows written batch by batch, and folded every second batch."""
    out, ckpt = J.fresh(spark, "metric-rows")
    J.run_metric_rows(_backwards(spark, sf), out, ckpt, compact_every=2)
    return J.read_metric_rows(spark, out)


@query
def stream_resolution(spark, sf):
    """All tiers of a request stream, in two batches, against the snapshot."""
    requests, store = snapshot_sides(spark, sf)
    out, ckpt = J.fresh(spark, "resolution")
    log_dir, _ = J.fresh(spark, "asked")
    for part in (0, 1):
        requests.where(F.col("request_id") % 4 == 2 * part + 1).coalesce(1).write.mode("append").parquet(log_dir)
    store = cut_lineage(store)
    J.run_resolution(J.stream_parquet(spark, log_dir, files_per_batch=1), store, out, ckpt)
    ids = store.select(F.col("prompt_hash").alias("matched_hash"), F.col("request_id").alias("matched_id"))
    return K.read_keyed(spark, out, "request_id", ["ts"]).join(ids, "matched_hash", "left").select(
        "request_id", "tier", "matched_id", F.round("similarity_score", 6).alias("score"))


@query
def stream_ingest(spark, sf):
    """Every event arrives twice, newest first, and is kept once."""
    out, ckpt = J.fresh(spark, "ingest")
    twice = _backwards(spark, sf).withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1))))
    J.run_ingest(twice, out, ckpt)
    return K.read_keyed(spark, out, "id", ["created_at"]).select("id", "session_id", "cache_hit")


@query
def stream_daily(spark, sf):
    out, ckpt = J.fresh(spark, "daily")
    J.run_daily(_backwards(spark, sf), out, ckpt)
    return J.read_daily(spark, out)


@query
def stream_tail(spark, sf):
    out, ckpt = J.fresh(spark, "tail")
    J.run(J.tail(_usage_stream(spark, sf)), J.keyed_sink(out, "id", ["created_at"]), ckpt)
    return K.read_keyed(spark, out, "id", ["created_at"]).select("id", "line")


@query
def stream_drain(spark, sf):
    out, ckpt = J.fresh(spark, "drain")
    queue_dir, _ = J.fresh(spark, "queue")
    K.encode_pending(stored_documents(spark, sf)).write.parquet(queue_dir)
    J.run_drain(J.stream_parquet(spark, queue_dir), out, ckpt)
    rows = K.read_keyed(spark, out, "id", ["created_at"])
    return rows.select((F.unix_seconds("created_at") - 1_704_067_200).alias("id"), "model")


@query
def stream_propagation(spark, sf):
    out, ckpt = J.fresh(spark, "propagation")
    store_dir, _ = J.fresh(spark, "store")
    stored_documents(spark, sf).write.option("compression", "zstd").parquet(store_dir)
    J.run_propagation(J.stream_parquet(spark, store_dir), out, ckpt)
    rows = K.read_keyed(spark, out, "id", ["changed_at"])
    return rows.select((F.unix_seconds("changed_at") - 1_704_067_200).alias("id"), "model")


@query
def stream_lookup(spark, sf):
    """A stream of canonical requests against the stored keys."""
    out, ckpt = J.fresh(spark, "lookup")
    log_dir, _ = J.fresh(spark, "log")
    document_log(spark, sf).write.parquet(log_dir)
    store = spark.read.parquet(log_dir).where(F.col("request_id") % 2 == 0).select("prompt_hash").distinct()
    hits = J.exact_lookup_stream(J.stream_parquet(spark, log_dir), store)
    J.run(hits, J.keyed_sink(out, "request_id", ["ts"]), ckpt)
    return K.read_keyed(spark, out, "request_id", ["ts"]).select(
        "request_id", F.col("matched_hash").isNotNull().alias("hit")
    )
