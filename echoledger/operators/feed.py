"""Changes between two versions of a keyed table, and tables that follow them.

Versions are compared by key and row digest alone; a row's columns move only if it has changed. Applying a feed is
an anti-join against its keys, so what has not changed is neither sorted nor rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def row_digest(rows: DataFrame, key: str, columns: list[str] | None = None) -> Column:
    """SHA-256 of the named columns (all but the key); null and absent values differ from every text."""
    names = columns or [c for c in rows.columns if c != key]
    parts = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}), F.lit("")) for c in names]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def change_feed(old: DataFrame, new: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """change (insert, update or delete), key, and the new row's other columns (null for a deleted one).

    A key stands once in each version. `columns`: those that count as a change; null is a key like any other.
    """
    def narrow(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col(key).alias(f"{name}_key"), row_digest(rows, key, columns).alias(f"{name}_digest"))

    both = narrow(old, "old").join(narrow(new, "new"), F.col("old_key").eqNullSafe(F.col("new_key")), "full")
    change = (
        F.when(F.col("old_digest").isNull(), INSERT).when(F.col("new_digest").isNull(), DELETE)
        .when(F.col("old_digest") != F.col("new_digest"), UPDATE))
    named = F.when(F.col("new_digest").isNull(), F.col("old_key")).otherwise(F.col("new_key"))
    changed = both.select(change.alias("change"), named.alias("changed_key")).where("change IS NOT NULL")
    others = [F.col(f"n.`{c}`") for c in new.columns if c != key]
    found = changed.alias("c").join(new.alias("n"), F.col("c.changed_key").eqNullSafe(F.col(f"n.{key}")), "left")
    return found.select("change", F.col("changed_key").alias(key), *others)


def apply_changes(table: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The table after a feed: changed and deleted keys leave, new rows come in. Applying a feed twice changes nothing."""
    keys = feed.select(F.col(key).alias("changed_key")).distinct()
    kept = table.join(keys, table[key].eqNullSafe(F.col("changed_key")), "left_anti")
    return kept.unionByName(feed.where(F.col("change") != DELETE).select(*table.columns))


def without_deleted(rows: DataFrame) -> DataFrame:
    """Rows of a followed table: a deleted key's latest row is its tombstone."""
    return rows.where(F.col("change") != DELETE).drop("change")
