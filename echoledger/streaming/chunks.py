"""Responses that arrive in chunks: merged by sequence number, in batches or as a stream.

Whether an answer is finished is told from its whole buffer, so a closing marker that two chunks share is found. Chunks
may come in any order, more than once, and in different micro-batches. A response ends with its last chunk; one that
never ends leaves as unfinished after a time without new chunks, and its state goes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from echoledger.operators import store as K
from echoledger.session import cut_lineage
from echoledger.streaming import jobs as J

#: Milliseconds without a chunk after which a response is given up.
PATIENCE_MS = 600_000
MERGED = "response_id string, raw string, n_chunks long, ended boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """response_id, raw, n_chunks, ended: one buffer for each response out of (response_id, seq, data, last).

    Repeated chunks count once, of different texts the larger one; null is an empty chunk. ended: the last chunk and all before it are there.
    """
    one = chunks.groupBy("response_id", "seq").agg(F.max("data").alias("data"), F.bool_or("last").alias("last"))
    found = one.groupBy("response_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts"), F.max(F.when(F.col("last"), F.col("seq"))).alias("end"))
    n = F.size("parts").cast("long")
    ended = F.coalesce((F.col("end") + 1 == n) & (F.col("parts")[0]["seq"] == 0) & (F.element_at("parts", -1)["seq"] == F.col("end")), F.lit(False))
    raw = F.array_join(F.transform("parts", lambda p: p["data"]), "")
    return found.select("response_id", raw.alias("raw"), n.alias("n_chunks"), ended.alias("ended"))


class ChunkMerger(StatefulProcessor):
    """Holds the chunks of one response until all of them are there, or no more have come for a while.

    A call reads and writes the state a fixed number of times, however many chunks it brings: they are appended as one list,
    and which numbers have come is one bit each.
    """

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq long, data string")
        self.progress = handle.getValueState("progress", "end long, timer long, seen binary")

    def _taken(self, key, more: list, ended: bool) -> pd.DataFrame:
        parts: dict[int, str] = {}
        for seq, data in [*(tuple(r) for r in self.parts.get()), *more]:
            parts[seq] = max(data, parts.get(seq, ""))  # of different texts the larger, as in a batch
        self.parts.clear()
        self.progress.clear()
        return pd.DataFrame({"response_id": [key[0]], "raw": ["".join(parts[k] for k in sorted(parts))], "n_chunks": [len(parts)], "ended": [ended]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end, timer, seen, now, new = -1, -1, 0, 0, []
        if self.progress.exists():
            end, timer, raw = self.progress.get()
            seen = int.from_bytes(raw, "little")
        for frame in rows:
            now = max(now, int(frame["arrived_at"].max().timestamp() * 1000))
            for seq, data, last in zip(frame["seq"].tolist(), frame["data"], frame["last"]):
                new.append((seq, data or ""))
                seen |= 1 << seq
                if last:
                    end = seq
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if end >= 0 and seen == (1 << end + 1) - 1:  # every number up to the last one
            yield self._taken(key, new, True)
            return
        self.parts.appendList(new)
        self.handle.registerTimer(now + self.patience_ms)
        self.progress.update((end, now + self.patience_ms, seen.to_bytes(seen.bit_length() // 8 + 1, "little")))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.progress.exists():
            yield self._taken(key, [], False)

    def close(self) -> None:
        pass


def merged_stream(chunks: DataFrame, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """Stream of finished and given-up responses out of a stream of chunks.

    The clock is the arrival of micro-batches, which never goes back, so that no chunk counts as late.
    """
    rows = chunks.select(F.col("response_id").cast("string"), F.col("seq").cast("long"), "data", "last", F.current_timestamp().alias("arrived_at"))
    return rows.withWatermark("arrived_at", "0 seconds").groupBy("response_id").transformWithStateInPandas(
        statefulProcessor=ChunkMerger(patience_ms), outputStructType=MERGED, outputMode="append", timeMode="eventTime")


def run_assembly(chunks: DataFrame, path: str, checkpoint: str, patience_ms: int = PATIENCE_MS, every: str | None = None):
    """Merged responses into the table keyed by response; a response that goes on after it was given up is merged anew."""
    spark = chunks.sparkSession

    def sink(rows: DataFrame, batch_id: int) -> None:
        # the keyed write reads its rows several times, and each time the state would be worked through anew
        K.write_batch(cut_lineage(rows), path, batch_id, "response_id", ["n_chunks", "arrived_at"])

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        stamped = merged_stream(chunks, patience_ms).withColumn("arrived_at", F.current_timestamp())
        return J.run(stamped, sink, checkpoint, every=every)
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def read_assembled(spark: SparkSession, path: str) -> DataFrame:
    return K.read_keyed(spark, path, "response_id", ["n_chunks", "arrived_at"]).drop("arrived_at")
