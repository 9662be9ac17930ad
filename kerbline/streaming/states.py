"""Streams whose state ages: a cache that forgets missing tiles, and remaining time that is told
anew while a run stands still. State goes, or tells, by the timeouts of its group."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.progress import Last, Trail, fold_all, ticked
from ..operators.stores import MISSING, OK


def _us(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[us]").astype("int64")


def _cache(keys: list[str], ttl_seconds: int) -> Callable[..., Iterator[pd.DataFrame]]:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, last, written = state.getCurrentProcessingTimeMs(), None, 0
        if state.exists:
            *last, written = state.get
            if last[2] == MISSING and now - written > ttl_seconds * 1000:
                last = None
        before = last = tuple(last) if last else None
        frames = list(batches)
        new = {c: np.concatenate([f[c].to_numpy() for f in frames]) for c in (*keys, "us", "number", "status")}
        asks = np.isnan(new["status"])
        order = np.lexsort((asks, new["number"], new["us"]))
        out = []
        for us, number, status, ask in zip(*(c[order].tolist() for c in (new["us"], new["number"], new["status"], asks))):
            if not ask:
                row = (us, number, int(status))
                last = row if last is None else max(last, row)
                continue
            seen = last[2] if last else None
            fresh = seen == MISSING and ttl_seconds > 0 and us - last[0] <= ttl_seconds * 1_000_000
            out.append("ok" if seen == OK else "missing" if fresh else "absent")
        written = now if last != before else written
        if last is not None:
            state.update((*map(int, last), written))
            if last[2] == MISSING:
                state.setTimeoutDuration(max(1, written + ttl_seconds * 1000 - now))
        elif state.exists:
            state.remove()
        if out:
            asked = order[asks[order]]
            yield pd.DataFrame({c: new[c][asked] for c in (*keys, "us", "number")} | {"state": out})

    return step


def answered_stream(rows: DataFrame, keys: list[str], ttl_seconds: int = 86400) -> DataFrame:
    """A stream of (keys, at, number, status) to answers, by the rules of ``stores.answered``;
    a row without status is a question.

    Rows of one trigger are put in order; a later trigger's statuses count only if they are
    later. The state of a missing tile goes ``ttl_seconds`` of the machine's clock after it
    was written, so a tile that nobody asks for again leaves nothing behind; that a tile is
    there stays. What is told rests on the times in the rows as well, so a replay of old rows
    gives the same answers. A key's rows of one trigger are held in one task.

    Times go to the workers and back as microseconds, the least of them for a row without time,
    since pandas would turn each group's timestamps to the session's time zone and back.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    no_time = F.lit(-(2**63)).cast("long")
    us = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), no_time)
    use = rows.select(*keys, us.alias("us"), rows["number"].cast("long").alias("number"), rows["status"].cast("int").alias("status"))
    state = "us long, number long, status int, written long"
    out = use.groupBy(*keys).applyInPandasWithState(_cache(keys, ttl_seconds), f"{kinds}, us long, number long, state string", state, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(*keys, F.timestamp_micros(F.nullif("us", no_time)).alias("at"), "number", "state")


def _remaining(every: float, speed: float) -> Callable[..., Iterator[pd.DataFrame]]:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trail, last, ms, seen = Trail(), None, 0, state.getCurrentWatermarkMs()
        if state.exists:
            times, parts, eta, *rest, ms = state.get
            trail, last = Trail(tuple(times), tuple(parts), eta), Last(*rest)
        if state.hasTimedOut:
            told = ticked(trail, last, every, last.elapsed + (seen - ms) / 1000 * speed)
        else:
            new = pd.concat(list(batches)).sort_values(["at", "event_id"])
            first, ms = last.i + 1 if last else 1, int(_us(new["at"]).iloc[-1]) // 1000
            told = fold_all(trail, last, zip(range(first, first + len(new)), new["elapsed"], new["percent"]), every)
        out = []
        for trail, last, shown in told:  # noqa: B020
            out.append((key[0], last.i, last.ticks, last.elapsed + last.ticks * every, shown))
        state.update((list(trail.times), list(trail.parts), trail.eta, *last, ms))
        if 0 < last.percent < 100:
            state.setTimeoutTimestamp(max(seen, ms + math.ceil((last.ticks + 1) * every / speed * 1000)) + 1)
        yield pd.DataFrame(out, columns=["run", "i", "tick", "elapsed", "eta"])

    return step


def remaining_told_stream(samples: DataFrame, every: float, delay: str = "0 seconds", speed: float = 1.0) -> DataFrame:
    """A stream of (run, event_id, at, elapsed, percent) to (run, i, tick, elapsed, eta), by the
    rules of ``progress.remaining_shown``, and with ticks up to the watermark while a run
    stands still. A tick is told once: when the next sample comes, or when the watermark has
    passed it, whichever is first.

    ``at`` is the time of a sample and its watermark is ``delay`` behind; later samples are
    dropped. ``elapsed`` moves ``speed`` seconds a second. State is the last samples of a run.
    """
    kind = samples.schema["run"].dataType.simpleString()
    use = samples.select("run", "event_id", "at", samples["elapsed"].cast("double").alias("elapsed"), samples["percent"].cast("double").alias("percent")).withWatermark("at", delay)
    state = "times array<double>, parts array<double>, eta double, i int, elapsed double, percent double, ticks int, ms long"
    return use.groupBy("run").applyInPandasWithState(_remaining(every, speed), f"run {kind}, i int, tick int, elapsed double, eta double", state, "append", GroupStateTimeout.EventTimeTimeout)
