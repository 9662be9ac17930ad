"""Streams with state that ages, against their batch twins."""

import datetime as dt
import time

import pandas as pd
import pytest

from kerbline.operators import stores
from kerbline.operators.progress import Last, Trail, fold_all, remaining_shown, ticked, told
from kerbline.streaming import states

# "once" where state goes by the machine's clock: such a stream always has another batch to run
T0 = dt.datetime(2024, 5, 1)
ROWS = "k int, at timestamp, number long, status int"
SAMPLES = "run string, event_id long, at timestamp, elapsed double, percent double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


class Drops:
    """A stream that is stopped after each drop of rows and started again."""

    def __init__(self, spark, tmp_path, schema, plan, **trigger):
        self.trigger = trigger or {"availableNow": True}
        self.spark, self.schema, self.plan = spark, schema, plan
        self.src, self.mark, self.out = (str(tmp_path / n) for n in ("src", "mark", "out"))

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.src)
        stream = self.plan(self.spark.readStream.schema(self.schema).parquet(self.src))
        self.shape = stream.schema
        stream.writeStream.format("parquet").option("checkpointLocation", self.mark).option("path", self.out).trigger(**self.trigger).start().awaitTermination()

    def got(self):
        return sorted((tuple(r) for r in self.spark.read.schema(self.shape).parquet(self.out).collect()), key=str)


def test_answers_of_stream_and_batch_agree_across_restarts(spark, tmp_path):
    drops = Drops(spark, tmp_path, ROWS, lambda s: states.answered_stream(s, ["k"], 100), once=True)
    batches = [
        [(1, at(0), 1, 2), (1, at(100), 2, None), (1, at(101), 3, None), (2, at(5), 4, 1), (2, at(5), 4, None), (3, at(9), 5, None)],
        [(1, at(90), 6, None), (2, at(500), 7, None), (3, at(20), 8, 2), (3, at(20), 9, None)],
        [(3, at(30), 10, None), (3, at(40), 11, 1), (3, at(999), 12, None), (2, at(600), 13, 2), (2, at(700), 14, None), (2, at(701), 15, None)],
    ]
    for rows in batches:
        drops.put(rows)
    whole = spark.createDataFrame(sum(batches, []), ROWS)
    batch = stores.answered(whole.where("status IS NOT NULL"), whole.where("status IS NULL"), ["k"], 100)
    assert drops.got() == sorted((tuple(r) for r in batch.collect()), key=str)
    assert {r["number"]: r["state"] for r in batch.collect()} == {2: "missing", 3: "absent", 4: "ok", 5: "absent", 6: "missing", 7: "ok", 9: "missing", 10: "missing", 12: "ok", 14: "missing", 15: "absent"}


def test_state_of_a_missing_tile_expires(spark, tmp_path):
    drops = Drops(spark, tmp_path, ROWS, lambda s: states.answered_stream(s, ["k"], 3), once=True)
    drops.put([(1, at(0), 1, 2), (2, at(0), 2, 1)])
    time.sleep(4)
    drops.put([(1, at(1), 3, None), (2, at(1), 4, None)])  # fresh by its time, but the state is gone
    assert [(r[2], r[3]) for r in drops.got()] == [(3, "absent"), (4, "ok")]


def test_no_time_to_live_and_empty_tables(spark):
    log = spark.createDataFrame([(1, at(0), 1, 2)], ROWS)
    asked = spark.createDataFrame([(1, at(0), 1, None), (None, at(1), 2, None)], ROWS)
    assert [r["state"] for r in stores.answered(log, asked, ["k"], 0).collect()] == ["absent"] * 2
    assert stores.answered(log, asked.limit(0), ["k"]).count() == 0
    assert [r["state"] for r in stores.answered(log.limit(0), asked, ["k"]).collect()] == ["absent"] * 2


def test_ticks_grow_while_a_run_stands_still():
    *_, (trail, last, first) = fold_all(Trail(), None, [(1, 0, 1), (2, 10, 20)], 5)
    shown = [x for _, _, x in ticked(trail, last, 5, 60)]
    assert len(shown) == 9 and shown == sorted(shown) and shown[0] > first
    assert not list(ticked(trail, Last(3, 20, 100), 5, 60)) and not list(ticked(trail, Last(3, 20, 0), 5, 60))


def test_samples_that_are_not_taken_move_the_smoothing(spark):
    rows = [(1, 0.0, 1.0), (2, 10.0, 20.0), (3, 12.0, 20.0), (4, 11.0, 15.0), (5, 30.0, 40.0)]
    table = spark.createDataFrame([("a", *r) for r in rows], "run string, i int, elapsed double, percent double")
    got = {(r["i"], r["tick"]): r["eta"] for r in remaining_shown(table, 1000.0).collect()}
    assert set(got) == {(i, 0) for i in range(1, 6)}
    t = Trail((0.0, 10.0), (1.0, 20.0), got[2, 0])
    t, third = told(t, 12.0, 20.0)
    assert got[3, 0] == third and got[4, 0] == pytest.approx(told(t, 11.0, 15.0)[1])
    assert remaining_shown(table.limit(0), 1.0).count() == 0


def test_timers_tell_remaining_time_between_samples(spark, tmp_path):
    drops = Drops(spark, tmp_path, SAMPLES, lambda s: states.remaining_told_stream(s, 10.0))
    sample = lambda run, n, s, part: (run, n, at(s), float(s), float(part))
    batches = [
        [sample("a", 1, 0, 1), sample("a", 2, 8, 5), sample("b", 3, 0, 2), sample("b", 4, 9, 7)],
        [sample("a", 5, 45, 6), sample("a", 6, 50, 30)],  # b stands still: the watermark moves past its ticks
        [sample("b", 7, 72, 40), sample("a", 8, 75, 100)],
    ]
    for rows in batches:
        drops.put(rows)
    i = {"a": 0, "b": 0}
    numbered = []
    for run, _, _, elapsed, percent in sum(batches, []):
        i[run] += 1
        numbered.append((run, i[run], elapsed, percent))
    batch = remaining_shown(spark.createDataFrame(numbered, "run string, i int, elapsed double, percent double"), 10.0)
    rows = lambda found: [(*r[:4], None if r[4] is None else round(r[4], 6)) for r in found]
    got, want = rows(drops.got()), rows(sorted((tuple(r) for r in batch.collect()), key=str))
    assert len(got) == len(set(got)) and set(want) <= set(got)
    beyond = set(got) - set(want)  # after the last sample of a run, up to the watermark
    assert all(run == "b" and n == 3 and elapsed < 75 for run, n, _, elapsed, _ in beyond)
    assert ("b", 2, 1) in {r[:3] for r in want}


class Kept:
    """The state of one key, without a stream."""

    def __init__(self, value=None, now=0):
        self.value, self.now, self.timeout = value, now, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)
    hasTimedOut = False  # noqa: N815

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.timeout = ms


def test_a_key_that_nobody_asks_for_gives_no_frame():
    told = pd.DataFrame({"k": [7, 7], "us": [20, 10], "number": [2, 1], "status": [2, 1]})
    state = Kept(now=5)
    assert list(states._cache(["k"], 100)((7,), iter([told[:1], told[1:]]), state)) == []
    assert state.value == (20, 2, 2, 5) and state.timeout == 100_000


def test_workers_get_numbers_and_no_timestamps(spark, tmp_path):
    spark.createDataFrame([(1, at(0), 1, 2)], ROWS).write.parquet(str(tmp_path / "rows"))
    plan = states.answered_stream(spark.readStream.schema(ROWS).parquet(str(tmp_path / "rows")), ["k"])
    asked = plan._jdf.queryExecution().analyzed().children().head().children().head().output()
    assert [asked.apply(i).dataType().simpleString() for i in range(asked.size())].count("timestamp") == 0
    assert plan.schema.simpleString() == "struct<k:int,at:timestamp,number:bigint,state:string>"


def test_odd_rows_of_a_stream(spark, tmp_path):
    drops = Drops(spark, tmp_path, ROWS, lambda s: states.answered_stream(s, ["k"], 100), once=True)
    drops.put(
        [(1, at(0), 1, 1), (1, at(0), 1, 2), (1, at(1), 2, None), (1, at(1), 2, None)]  # two statuses of one place; a question twice
        + [(None, at(0), 3, 1), (None, at(1), None, None), (None, at(1), 4, None)]  # no key, no number
        + [(2, None, 5, None), (2, None, 6, 1), (2, None, 6, None), (2, at(3), 7, None)]  # no time: before all others
        + [(3, at(0), 8, 7), (3, at(1), 9, None)]  # a status that isn't known
    )
    t = lambda n: at(n)
    want = [(1, t(1), 2, "missing")] * 2 + [(None, t(1), None, "ok"), (None, t(1), 4, "ok"), (2, None, 5, "absent"), (2, None, 6, "ok"), (2, t(3), 7, "ok"), (3, t(1), 9, "absent")]
    assert drops.got() == sorted(want, key=str)


def test_hours_that_clocks_show_twice_stay_in_order(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    utc = lambda h, m: dt.datetime(2024, 11, 3, h, m, tzinfo=dt.UTC)
    rows = [(1, utc(5, 30), 1, 2), (1, utc(6, 10), 2, None), (1, utc(6, 40), 3, None)]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        drops = Drops(spark, tmp_path, ROWS, lambda s: states.answered_stream(s, ["k"], 3600), once=True)
        drops.put(rows)
        got = spark.read.schema(drops.shape).parquet(drops.out).selectExpr("unix_timestamp(at)", "number", "state").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(tuple, got)) == [(int(rows[1][1].timestamp()), 2, "missing"), (int(rows[2][1].timestamp()), 3, "absent")]
