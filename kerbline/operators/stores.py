"""Append-only stores: the latest row wins; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OK, MISSING = 1, 2


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; max_by keeps one row a key and task before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def violations(log: DataFrame, status: str = "status", content: str = "content") -> DataFrame:
    """Rows that a cache table would refuse: a status out of range, or content that doesn't
    agree with it (there if and only if the tile is)."""
    s, c = F.col(status), F.col(content)
    return log.where(~s.isin(OK, MISSING) | s.isNull() | ((s == OK) != c.isNotNull()))


def lookup(latest_rows: DataFrame, wanted: DataFrame, keys: list[str], now: Column, ttl_seconds: int = 86400) -> DataFrame:
    """What the cache says of each wanted key: ok, missing (while fresh) or absent."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    state = F.when(F.col("status") == OK, "ok").when((F.col("status") == MISSING) & (F.lit(ttl_seconds) > 0) & (age <= ttl_seconds * 1_000_000), "missing").otherwise("absent")
    return wanted.join(latest_rows, keys, "left").withColumn("state", state)


def answered(log: DataFrame, asked: DataFrame, keys: list[str], ttl_seconds: int = 86400) -> DataFrame:
    """``keys, at, number, state``: what the cache said to each question when it was asked.

    ``log`` has (keys, status, at, number), ``asked`` (keys, at, number). Rows count in order
    of ``at`` and ``number``, a status before a question of the same place; the last status
    decides: ok, missing (while it is no older than the time to live) or absent.
    """
    cols = [*keys, F.col("at").cast("timestamp").alias("at"), "number"]
    both = log.select(*cols, "status").unionByName(asked.select(*cols, F.lit(None).cast("int").alias("status")))
    us = F.unix_micros("at")
    w = Window.partitionBy(*keys).orderBy("at", "number", F.col("status").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.last(F.when(F.col("status").isNotNull(), F.struct("status", us.alias("us"))), ignorenulls=True).over(w)).where("status IS NULL")
    fresh = (F.lit(ttl_seconds) > 0) & (us - F.col("last.us") <= ttl_seconds * 1_000_000)
    return seen.select(*keys, "at", "number", F.when(F.col("last.status") == OK, "ok").when((F.col("last.status") == MISSING) & fresh, "missing").otherwise("absent").alias("state"))


def deleted(log: DataFrame, keys: list[str], tombstones: DataFrame) -> DataFrame:
    """The log without keys that were deleted."""
    return log.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def run_key(*parts: Column) -> Column:
    """One hash over everything that a result depends on, tile source and parameters too."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def resumed(edges: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with their stored result, if any; ``cached`` tells which have one."""
    return edges.join(done.withColumn("cached", F.lit(True)), keys, "left").fillna(False, ["cached"])


def failed_before(log: DataFrame, keys: list[str], order: list[str], failed: Column) -> DataFrame:
    """Adds whether the key had failed earlier in the run (it is then not tried again)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("failed_before", F.coalesce(F.max(failed.cast("int")).over(w), F.lit(0)) == 1)
