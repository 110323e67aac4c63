"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from echoledger.llm.shared import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(id, root) for every id of edges (a, b): the root is the smallest id reachable.

    Each round hangs neighbours below the smallest id they see, in joins and aggregations alone; the
    edge table is written after each round, and rounds end when it no longer changes.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept, before = None, None
    while True:
        if kept is not None:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = tables.keep(now, "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if kept is not None:
            tables.drop(kept)
        now = kept = new
        if state == before or not state[0]:
            break
        before = state
    roots = kept.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return kept.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
