"""Progress of a run and its remaining time, as batch plans."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The part of a whole run that each stage takes, in percent.
STAGE_RANGES = {
    "load_graph": (0.0, 3.0),
    "tile_indices": (3.0, 10.0),
    "find_tiles": (10.0, 13.0),
    "prepare_tiles": (13.0, 22.0),
    "predict_masks": (22.0, 68.0),
    "calculate_widths": (68.0, 98.0),
    "update_graph": (98.0, 100.0),
}

# Fixed values of the estimate, with those in ``unsmoothed`` and ``told`` (0.3, 0.7, 0.35, 0.18,
# 2, 4, 0.05, 0.5): how far back speeds are looked at and how they are mixed.
RECENT_SECONDS, MOST_SAMPLES, LONGEST = 90.0, 120, 7 * 24 * 3600.0
LEAST_RISE = 1e-6


def overall_percent(stage: Column, current: Column, total: Column) -> tuple[Column, Column]:
    """Percent of the stage and of the run; a place beyond the total counts as its end."""
    safe = F.greatest(F.lit(1), total)
    part = F.least(F.greatest(F.lit(0), current), safe) / safe
    table = F.create_map(*[v for k, (a, b) in STAGE_RANGES.items() for v in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
    span = F.element_at(table, stage)
    return part * 100.0, span[0] + (span[1] - span[0]) * part


class RunProgress:
    """Tells a listener how far a run is, as ``stage, current, total, percent``.

    The percent of the run never falls, whatever order counts come in."""

    def __init__(self, listen: Callable[[dict], None] | None = None):
        self.listen, self.percent = listen, 0.0

    def at(self, stage: str, current: float, total: float) -> float:
        low, high = STAGE_RANGES[stage]
        safe = max(1, total)
        self.percent = max(self.percent, low + (high - low) * min(max(0, current), safe) / safe)
        if self.listen is not None:
            self.listen({"stage": stage, "current": current, "total": total, "percent": self.percent})
        return self.percent


def running_percent(samples: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Progress that never falls: the greatest value so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("shown", F.max(value).over(w))


class Trail(NamedTuple):
    """The last samples of a run that moved forward, and its smoothed remaining seconds."""

    times: tuple[float, ...] = ()
    parts: tuple[float, ...] = ()
    eta: float | None = None


def moved(trail: Trail, elapsed: float, percent: float) -> Trail | None:
    """The trail with a sample more; None if it lies before the last one or rises by no more
    than ``LEAST_RISE``."""
    if trail.times and not (elapsed >= trail.times[-1] and percent > trail.parts[-1] + LEAST_RISE):
        return None
    return trail._replace(times=(*trail.times, elapsed)[-MOST_SAMPLES:], parts=(*trail.parts, percent)[-MOST_SAMPLES:])


def unsmoothed(trail: Trail, elapsed: float, percent: float) -> float | None:
    """Seconds left at the speed since the start, mixed with that of the recent samples."""
    if percent >= 100:
        return 0.0
    first = bisect_left(trail.times, -RECENT_SECONDS, key=lambda t: t - elapsed) % max(len(trail.times), 1)
    if len(trail.times) < 2 or elapsed < 4 or percent < 0.5:
        return None
    seconds, rise = elapsed - trail.times[first], percent - trail.parts[first]
    speeds = [percent / max(elapsed, 1e-9)]
    if seconds >= 2 and rise >= 0.05:
        speeds.append(rise / seconds)
    speed = speeds[0] if len(speeds) == 1 else 0.3 * speeds[0] + 0.7 * speeds[1]
    return min((100 - percent) / speed, LONGEST) if speed > 1e-9 else None


def told(trail: Trail, elapsed: float, percent: float) -> tuple[Trail, float | None]:
    """The trail with its smoothed value after a sample, and what is shown: none while unknown."""
    new = unsmoothed(trail, elapsed, percent)
    if new is not None and trail.eta is not None and percent < 100:
        new = 0.35 * new + 0.65 * trail.eta if new > trail.eta else 0.18 * new + 0.82 * trail.eta  # slowing down counts more
    return (trail if new is None else trail._replace(eta=new)), new


def fold(trail: Trail, samples: Iterable[tuple[int, float, float]]) -> Iterator[tuple[Trail, int, float | None]]:
    """The trail after each sample (i, elapsed, percent) that is taken, its ``i`` and what is
    shown. Values are brought into their ranges first."""
    for i, elapsed, percent in samples:
        elapsed, percent = max(0.0, elapsed), min(max(0.0, percent), 100.0)
        longer = moved(trail, elapsed, percent)
        if longer is not None:
            trail, shown = told(longer, elapsed, percent)
            yield trail, i, shown


class Last(NamedTuple):
    """The last sample of a run, taken or not, and how many ticks were told after it."""

    i: int
    elapsed: float
    percent: float
    ticks: int = 0


def ticked(trail: Trail, last: Last, every: float, until: float) -> Iterator[tuple[Trail, Last, float | None]]:
    """What is shown ``every`` seconds after a sample, up to a time (exclusive), while no other
    comes. The percent stands still, so the rest grows. A run at 0 or 100 % has no ticks."""
    while 0 < last.percent < 100 and (at := last.elapsed + (last.ticks + 1) * every) < until:
        last = last._replace(ticks=last.ticks + 1)
        trail, shown = told(trail, at, last.percent)
        yield trail, last, shown


def fold_all(trail: Trail, last: Last | None, samples: Iterable[tuple[int, float, float]], every: float) -> Iterator[tuple[Trail, Last, float | None]]:
    """The trail, the last sample and what is shown after every sample, also one that isn't
    taken, and after every tick between samples."""
    for i, elapsed, percent in samples:
        elapsed, percent = max(0.0, elapsed), min(max(0.0, percent), 100.0)
        if last is not None:
            for trail, last, shown in ticked(trail, last, every, elapsed):
                yield trail, last, shown
        last = Last(i, elapsed, percent)
        trail, shown = told(moved(trail, elapsed, percent) or trail, elapsed, percent)
        yield trail, last, shown


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run and ``i``; only the trail of the run at hand is held."""
    run, trail = None, Trail()
    for batch in batches:
        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("run", "i", "elapsed", "percent")))
        for key, own in groupby(rows, key=lambda r: r[0]):
            run, trail = key, trail if key == run else Trail()
            for trail, i, shown in fold(trail, (r[1:] for r in own)):  # noqa: B020
                out.append((key, i, shown))
        columns = zip(*out) if out else ((), (), ())
        types = (batch.schema.field("run").type, pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["run", "i", "eta"])


def remaining(samples: DataFrame) -> DataFrame:
    """``run, i, eta``: the smoothed remaining seconds after each sample that is taken, null
    where unknown.

    Samples are (run, i, elapsed, percent); they are folded in order of ``i``, each compared
    with the last one taken of its run. Rows with a null in these columns take no part. A
    task goes through its runs in order and holds the last samples of one.
    """
    rows = samples.select("run", F.col("i").cast("int").alias("i"), F.col("elapsed").cast("double").alias("elapsed"), F.col("percent").cast("double").alias("percent")).na.drop()
    kind = rows.schema["run"].dataType.simpleString()
    return rows.repartition("run").sortWithinPartitions("run", "i", "elapsed", "percent").mapInArrow(_folded, f"run {kind}, i int, eta double")


def remaining_shown(samples: DataFrame, every: float) -> DataFrame:
    """``run, i, tick, elapsed, eta``: what is shown after every sample (``tick`` 0), and every
    so many seconds while the next one is awaited (``tick`` from 1); null where unknown.

    Samples as in ``remaining``. One that isn't taken moves the smoothing all the same. No tick
    comes after the last sample of a run.
    """

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, trail, last = None, Trail(), None
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("run", "i", "elapsed", "percent")))
            for key, own in groupby(rows, key=lambda r: r[0]):
                run, trail, last = key, *((trail, last) if key == run else (Trail(), None))
                for trail, last, shown in fold_all(trail, last, (r[1:] for r in own), every):  # noqa: B020
                    out.append((key, last.i, last.ticks, last.elapsed + last.ticks * every, shown))
            columns = zip(*out) if out else ((),) * 5
            types = (batch.schema.field("run").type, pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["run", "i", "tick", "elapsed", "eta"])

    rows = samples.select("run", F.col("i").cast("int").alias("i"), F.col("elapsed").cast("double").alias("elapsed"), F.col("percent").cast("double").alias("percent")).na.drop()
    kind = rows.schema["run"].dataType.simpleString()
    return rows.repartition("run").sortWithinPartitions("run", "i", "elapsed", "percent").mapInArrow(run_, f"run {kind}, i int, tick int, elapsed double, eta double")
