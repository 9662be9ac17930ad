"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _lowest(pairs: DataFrame, keep) -> DataFrame:
    """For each ``u`` the least of itself and its ``v``; kept, so that the join after it is
    between two plain shuffles, which adaptive execution can split where one ``u`` is hot."""
    return keep(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "component-lows")


def _large_star(links: DataFrame, keep) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = both.join(_lowest(both, keep), "u").where("v > u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, keep) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down, keep)
    met = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """``node, root`` for every node of ``links(u long, v long)``: root is the least node
    that it reaches. Repeated links and self links do no harm; no link, no row.

    Each step is kept in the shared folder, by ``keep``. The steps end when the links no longer change,
    which takes a number of steps that grows with the logarithm of the largest component.
    """
    links = keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-links")
    mark = None
    while True:
        links = keep(_small_star(_large_star(links, keep).where("u <> v"), keep).where("u <> v").distinct(), "component-links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
