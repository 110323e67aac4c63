"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, SF, name, queries()[name], oracle_sql().get(name))
    assert ok, note


def test_every_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_queries_hold_arrow_batches_small(spark):
    """A worker holds one batch, so its rows must not grow with those of a partition; a smaller setting stays."""
    from echoledger.plans.queries import query, QUERIES
    from echoledger.session import BATCH_ROWS

    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def probe_of_batches(spark, sf):
        return int(spark.conf.get(name))

    try:
        run = query(probe_of_batches)
        seen = []
        for given in (10_000, 0, 7):
            spark.conf.set(name, given)
            seen.append(run(spark, ""))
        assert seen == [BATCH_ROWS, BATCH_ROWS, 7]
    finally:
        QUERIES.pop("probe_of_batches")
        spark.conf.set(name, before)


def test_queries_bound_the_bytes_of_arrow_batches(spark):
    """A row may be a whole block of documents, so that rows alone do not bound a batch."""
    from echoledger.session import BATCH_BYTES, bound_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    try:
        for given in ("256m", "1000"):
            spark.conf.set(name, given)
            bound_batches(spark)
            seen.append(int(spark.conf.get(name).rstrip("b")))
        assert seen == [BATCH_BYTES, 1000]
    finally:
        spark.conf.set(name, before)


def test_a_log_that_is_there_is_not_read_again(spark, monkeypatch):
    from echoledger.plans import queries as Q

    monkeypatch.setattr(Q, "document_log", lambda *a: pytest.fail("the log was read again"))
    kind = "request_id long, session_id string, ts timestamp, prompt_text string, prompt_hash string, model string, embed_text string"
    log = spark.sql("SELECT 1704067200 AS t").selectExpr("explode(sequence(0, 3)) AS i", "t").selectExpr(
        "cast(i AS long) AS request_id", "'s' AS session_id", "timestamp_seconds(t + i) AS ts", "'p' AS prompt_text",
        "concat('h', i % 2) AS prompt_hash", "'m' AS model", "'some text' AS embed_text")
    assert log.columns == [c.split()[0] for c in kind.split(", ")]
    got = {(r.prompt_hash, r.input_tokens, r.output_tokens) for r in Q.stored_documents(spark, "", log).collect()}
    assert got == {("h0", 9, 0), ("h1", 9, 1)}
