"""Mutable tables as append-only logs, and the jobs that keep shelves in step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], ts: str = "ts", op: str = "op") -> DataFrame:
    """The current rows of a change log (keys, ts, op, payload): the last change wins, D deletes. Ties go to the greater op, so a deletion does not win a tie against U."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(op))
    return log.withColumn("place", F.row_number().over(w)).where((F.col("place") == 1) & (F.col(op) != "D")).drop("place", op)


def live(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that are not softly deleted."""
    return df.where(F.col(deleted).isNull())


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of changes put in by key."""
    return current.join(changes, keys, "left_anti").unionByName(changes)


def insert_or_ignore(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current with those rows of new whose key it lacks."""
    return current.unionByName(new.dropDuplicates(keys).join(current, keys, "left_anti"))


def replace_children(children: DataFrame, parent: str, new: DataFrame) -> DataFrame:
    """children with all rows of the parents in new replaced by those of new."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def newest(rows: DataFrame, keys: list[str], ts: str, keep: int) -> DataFrame:
    """The newest rows of each key (retention)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).drop("place")


def expired(rows: DataFrame, deleted: str, now: str, days: int = 30) -> DataFrame:
    """Softly deleted rows that are past their time."""
    return rows.where(F.col(deleted) < F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))


def sync_actions(own: DataFrame, shipped: DataFrame, used: DataFrame) -> DataFrame:
    """(key, action): what a new shipment of files means for the shelf.

    own and shipped have key, path and name (the file's); own rows without a key can be adopted by name;
    used lists the keys that a reader's data points at.
    """
    s = shipped.select("key", F.col("path").alias("new_path"), "name")
    o = own.select(F.col("key"), F.col("path").alias("old_path"))
    both = s.join(o.where("key is not null"), "key", "full").join(used.select("key").distinct().withColumn("in_use", F.lit(True)), "key", "left")
    loose = own.where("key is null").select("name").distinct().withColumn("adoptable", F.lit(True))
    both = both.join(loose, "name", "left")
    action = (
        F.when(F.col("new_path").isNull(), F.when(F.col("in_use"), "retire").otherwise("drop"))
        .when(F.col("old_path").isNull(), F.when(F.col("adoptable"), "adopt").otherwise("add"))
        .when(F.col("old_path") != F.col("new_path"), "repoint")
        .otherwise("keep")
    )
    return both.select("key", action.alias("action"))
