"""Mixing sources to target weights by temperature, realised as block permutations.

Source weights are token shares raised to an exponent and normalised. The exponent is
bisected to meet a target entropy or a limit on repetition. Each source then gives its
weight's part of the token budget: whole passes over all its rows, and for the rest a part
of one more pass. A pass is a permutation of blocks, and of the rows within a block, keyed
by a hash, so a hot source is spread over its blocks and nothing is sorted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_SPLIT, staged

#: Sources up to which their plan, a short row each, is sent to every task; a plan of more is
#: joined by shuffles instead.
SENT_SOURCES = 10_000
BLOCK_ROWS, TILE_BLOCKS = 256, 4096


def least_fine(fine: Callable[[list[float]], list[bool]], tries: int = 1) -> float:
    """The least exponent in [0, 1] (0: equal weights, 1: natural shares) from which on
    ``fine`` holds, 1 if it never does. Each round divides the bracket at ``tries`` places."""
    if fine([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    while high - low > 1e-15:
        at = [low + (high - low) * (i + 1) / (tries + 1) for i in range(tries)]
        if not low < at[0] <= at[-1] < high:
            break
        first = (fine(at) + [True]).index(True)
        low, high = ([low] + at)[first], (at + [high])[first]
    return high


def entropies(shares: DataFrame, exponents: list[float]) -> list[float]:
    """The entropy of the tempered ``share`` column at each exponent, in one aggregate."""
    tried = shares.select(F.log("share").alias("log"), F.posexplode(F.array(*[F.lit(x) for x in exponents])).alias("i", "x"))
    power = F.col("x") * F.col("log")
    sums = tried.groupBy("i").agg(F.sum(F.exp(power)).alias("z"), F.sum(F.exp(power) * power).alias("s"))
    found = {r["i"]: math.log(r["z"]) - r["s"] / r["z"] for r in sums.collect()}  # a row an exponent
    return [found[i] for i in range(len(exponents))]


def exponent(shares: DataFrame, spread: float, target_entropy: float | None, repetition_limit: float | None) -> float:
    """The least exponent that holds the repetition limit and whose entropy is no more than
    the target, 1 if none does. ``spread``: the log of the greatest share over the least;
    between these two sources the passes differ most, by the factor
    exp(spread * (1 - exponent))."""
    low = 0.0
    if repetition_limit is not None:
        low = least_fine(lambda at: [spread * (1 - x) <= math.log(repetition_limit) for x in at])
    if target_entropy is not None:
        low = max(low, least_fine(lambda at: [e <= target_entropy for e in entropies(shares, at)], 31))
    return low


def source_plan(sized: DataFrame, budget: int | None, target_entropy: float | None, repetition_limit: float | None) -> tuple[DataFrame, int]:
    """``mix_source, source_tokens, passes, blocks`` of each source, and their number; passes
    may be a fraction. The totals stay a table; the driver gets sums over it."""
    totals = staged(sized.groupBy("mix_source").agg(F.sum("mix_tokens").alias("source_tokens"), F.count("*").alias("rows")), "mix-sources")
    n, whole, least, most = totals.agg(F.count("*"), F.sum("source_tokens"), F.min("source_tokens"), F.max("source_tokens")).first()
    if not n:
        return totals.select("mix_source", "source_tokens", F.lit(0.0).alias("passes"), F.lit(1).alias("blocks")), 0
    shares = totals.withColumn("share", F.col("source_tokens") / F.lit(whole))
    if target_entropy is not None and (natural := entropies(shares, [1.0])[0]) > target_entropy + 1e-9:
        raise ValueError(f"an entropy of {target_entropy} can't be met: that of the natural shares is {natural}")
    x = exponent(shares, math.log(most / least), target_entropy, repetition_limit)
    raised = F.pow("share", F.lit(x))
    if budget is None:  # the largest source, whose part is the least, is used once
        passes = F.pow(F.col("share") / F.lit(most / whole), F.lit(x - 1))
    else:
        passes = raised / shares.agg(F.sum(raised)).first()[0] * F.lit(float(budget)) / F.col("source_tokens")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    return shares.select("mix_source", "source_tokens", F.round(passes, 9).alias("passes"), blocks.alias("blocks")), n


def _tile(turn: str, tiles):
    """The tile of a hash: ranges of hashes in order, about ``TILE_BLOCKS`` blocks each."""
    return F.least(F.floor((F.col(turn) / F.lit(2.0**64) + 0.5) * tiles), tiles - 1).cast("long")


def _before(turns: DataFrame) -> DataFrame:
    """Adds ``before``: the tokens of a source's pass before each block, by order of ``turn``.
    Tiles are added up first, so no task orders all blocks of a source."""
    tiles = turns.groupBy("mix_source", "mix_pass", "tile").agg(F.sum("block_tokens").alias("tile_tokens"))
    over = Window.partitionBy("mix_source", "mix_pass").orderBy("tile").rowsBetween(Window.unboundedPreceding, 0)
    first = tiles.select("mix_source", "mix_pass", "tile", (F.sum("tile_tokens").over(over) - F.col("tile_tokens")).alias("tile_before"))
    within = Window.partitionBy("mix_source", "mix_pass", "tile").orderBy("turn", "mix_block").rowsBetween(Window.unboundedPreceding, 0)
    inner = turns.withColumn("inner", F.sum("block_tokens").over(within) - F.col("block_tokens"))
    return inner.join(first, ["mix_source", "mix_pass", "tile"]).withColumn("before", F.col("tile_before") + F.col("inner"))


def mix_sources(
    docs: DataFrame,
    budget: int | None = None,
    target_entropy: float | None = None,
    repetition_limit: float | None = 2.0,
    seed: int = 11,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``mix_source, mix_tokens, mix_pass, mix_block,
    mix_slot``, a row for each time that a document is used.

    ``mix_slot`` in [0, 1) orders the mixed stream: sorted by it, sources interleave at
    their weights. Without a budget it is the least at which every source is used whole at
    least once, so no row is lost; with one, a source may be used in part. Tokens are words
    and one end mark, so an empty or null text has one. The row at the edge of a part of a pass
    is used if at least half of it lies within. A null source is the source "". Rows
    with equal or null ids are separate, each with its own place. A target entropy that no
    exponent in [0, 1] meets is a ValueError. An empty table gives no rows.
    """
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), WORD_SPLIT), ""))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"),
        (words + 1).cast("long").alias("mix_tokens"),
        # the text too, so that rows without ids spread over the blocks
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col), F.lit(seed)).alias("mix_key"),
        F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]).alias("mix_tie"),
    )
    plan, n_sources = source_plan(sized, budget, target_entropy, repetition_limit)
    plan = F.broadcast(plan) if n_sources <= SENT_SOURCES else plan.hint("merge")
    placed = sized.join(plan, "mix_source").withColumn("mix_block", F.pmod("mix_key", "blocks").cast("int"))
    totals = staged(placed.groupBy("mix_source", "source_tokens", "passes", "blocks", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens")), "mix-blocks")
    turns = totals.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes"), F.lit(1)).cast("int") - 1)).alias("mix_pass"))
    turn = F.xxhash64("mix_source", "mix_block", "mix_pass", F.lit(seed))
    before = _before(turns.withColumn("turn", turn).withColumn("tile", _tile("turn", F.ceil(F.col("blocks") / TILE_BLOCKS))))
    quota = F.least(F.lit(1.0), F.col("passes") - F.col("mix_pass")) * F.col("source_tokens")
    used = staged(before.select("mix_source", "mix_block", "mix_pass", "source_tokens", "passes", "before", quota.alias("quota")).where("before < quota"), "mix-turns")
    joined = placed.select("row", "mix_source", "mix_tokens", "mix_key", "mix_tie", "mix_block").join(used, ["mix_source", "mix_block"])
    within = Window.partitionBy("mix_source", "mix_block", "mix_pass").orderBy(F.xxhash64("mix_key", "mix_pass"), "mix_key", "mix_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed_in = joined.withColumn("in_block", F.sum("mix_tokens").over(within) - F.col("mix_tokens"))
    at = F.col("before") + F.col("in_block")
    slot = (F.col("mix_pass") * F.col("source_tokens") + at) / (F.greatest("passes", F.lit(1e-9)) * F.col("source_tokens"))
    return placed_in.where(at + F.col("mix_tokens") / 2 <= F.col("quota") + 1e-6).select("row", "mix_source", "mix_tokens", F.col("mix_pass").cast("int"), "mix_block", slot.alias("mix_slot"))
