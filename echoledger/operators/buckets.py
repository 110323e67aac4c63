"""A keyed table in hash buckets: batches rewrite what they touch, look-ups read the buckets of their keys.

    path/delta/batch=N/bucket=B    rows of one batch, the latest of each key
    path/base/upto=N/bucket=B      latest rows of a touched bucket, all batches up to N folded in

Every folder is written once and whole, under the number of its batch; one that lacks its success file does not exist
for readers. So a batch that runs again replaces only itself, an interrupted one leaves nothing, and readers go on
with the version they have found. Folding rewrites only the buckets with new rows; for every bucket a reader takes its
newest base and the later deltas, found from the folder names, and Spark prunes the rest by partition.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoledger.operators.store import latest_by_key


def children(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Number and path of the finished folders `name=number` below a path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {}
    found = {}
    for f in fs.listStatus(p):
        label = f.getPath().getName()
        if label.startswith(f"{name}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found[int(label.split("=")[1])] = str(f.getPath())
    return found


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders `name=number` directly below a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = (f.getPath().getName() for f in fs.listStatus(p))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))


@dataclass(frozen=True)
class BucketedTable:
    """key: one column; order: which row of a key is the latest (see winners); buckets: fixed for the life of a table."""

    spark: SparkSession
    path: str
    key: str
    order: tuple[str, ...]
    buckets: int = 64

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        """One file a bucket, sorted by key; the folder replaces what an interrupted or repeated run has left."""
        placed = rows.withColumn("bucket", self.bucket_of(F.col(self.key))).repartition(self.buckets, "bucket")
        placed.sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def append(self, rows: DataFrame, batch: int) -> None:
        """The latest row of each key of a batch; writing a batch again replaces it."""
        self._write(latest_by_key(rows, self.key, list(self.order)), f"{self.path}/delta/batch={batch}")

    def _sources(self) -> tuple[dict[int, int], dict[int, str], dict[int, str]]:
        """(newest base of each bucket, bases, deltas), from folder names alone."""
        bases = children(self.spark, f"{self.path}/base", "upto")
        newest = {}
        for upto in sorted(bases):
            newest |= {b: upto for b in _folders(self.spark, bases[upto], "bucket")}
        return newest, bases, children(self.spark, f"{self.path}/delta", "batch")

    def versions(self, only: Iterable[int] | None = None) -> DataFrame:
        """All rows that a reader has to look at, with their batch; `only`: of these buckets."""
        newest, bases, deltas = self._sources()
        some = None if only is None else sorted(set(only))
        parts = []
        for upto in sorted(set(newest.values())):
            mine = [b for b, n in newest.items() if n == upto and (some is None or b in some)]
            if mine:
                rows = self.spark.read.parquet(bases[upto]).where(F.col("bucket").isin(mine))
                parts.append(rows.withColumn("batch", F.lit(upto).cast("long")))
        for batch, path in sorted(deltas.items()):
            folded = [b for b, n in newest.items() if n >= batch]
            rows = self.spark.read.parquet(path).where(~F.col("bucket").isin(folded) if folded else F.lit(True))
            rows = rows.where(F.col("bucket").isin(some)) if some is not None else rows
            if len(folded) < self.buckets:
                parts.append(rows.withColumn("batch", F.lit(batch).cast("long")))
        if not parts:
            raise FileNotFoundError(f"no finished batch below {self.path}")
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The latest row of each key; among equal orders the later batch wins."""
        return latest_by_key(self.versions(only).drop("bucket"), self.key, [*self.order, "batch"]).drop("batch")

    def buckets_of(self, keys: Iterable) -> list[int]:
        """Buckets of some keys that the caller holds."""
        kind = self.versions(()).schema[self.key].dataType if keys else None
        rows = self.spark.createDataFrame([(k,) for k in keys], f"k {kind.simpleString()}") if keys else None
        return sorted({r[0] for r in rows.select(self.bucket_of(F.col("k"))).collect()}) if keys else []

    def lookup(self, keys: list) -> DataFrame:
        """Rows of a few keys: only the files of their buckets are read, and of those the row groups that hold them."""
        return self.versions(self.buckets_of(keys)).where(F.col(self.key).isin(list(keys))).transform(
            lambda rows: latest_by_key(rows.drop("bucket"), self.key, [*self.order, "batch"]).drop("batch"))

    def fold(self, upto: int) -> list[int]:
        """New bases of the buckets that deltas up to `upto` have touched since theirs; their numbers. Run with one folder at a time."""
        newest, _, deltas = self._sources()
        touched = set()
        for batch, path in deltas.items():
            if batch <= upto:
                touched |= {b for b in _folders(self.spark, path, "bucket") if newest.get(b, -1) < batch}
        if touched:
            rows = self.versions(touched).where(F.col("batch") <= upto).drop("bucket")
            self._write(latest_by_key(rows, self.key, [*self.order, "batch"]).drop("batch"), f"{self.path}/base/upto={upto}")
        return sorted(touched)


# ---------------------------------------------------------------- usage log


def append_usage(facts: DataFrame, path: str, batch: int, again: bool = False) -> bool:
    """One batch of usage rows by day, under its number: a batch that is there already is left alone (False), or replaced (`again`).

    The folder of a batch is its entry in the ledger: it counts once it has its success file, which is written last.
    """
    if not again and batch in children(facts.sparkSession, path, "batch"):
        return False
    dated = facts.withColumn("date", F.to_date("created_at"))
    dated.write.mode("overwrite").partitionBy("date").parquet(f"{path}/batch={batch}")
    return True


def read_usage(spark: SparkSession, path: str, batches: Iterable[int] | None = None) -> DataFrame:
    """Usage rows of the finished batches, with date and batch; a condition on date reads only those days."""
    found = children(spark, path, "batch")
    wanted = [p for b, p in sorted(found.items()) if batches is None or b in set(batches)]
    if not wanted:
        raise FileNotFoundError(f"no finished batch below {path}")
    return spark.read.option("basePath", path).parquet(*wanted)
