"""Streams: a resumed store, and the estimator's rules."""

import pytest

from kerbline.operators.progress import Trail, fold, moved, remaining, told
from kerbline.streaming import store_sink


def test_store_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "k int, status int, at int"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        store_sink.keep_batches(spark.readStream.schema(schema).parquet(src), out, mark, ["k"], ["at"]).awaitTermination()

    put([(1, 1, 1), (1, 2, 5), (2, 1, 3)])
    put([(1, 1, 4), (3, 2, 1)])
    put([(2, 2, 9)])
    got = {tuple(r) for r in store_sink.current(spark, out, ["k"], ["at"]).collect()}
    assert got == {(1, 2, 5), (2, 2, 9), (3, 2, 1)}


def test_estimator_rules():
    e = moved(Trail(), 0, 1)
    assert moved(e, 5, 1) is None
    e = moved(e, 5, 2)
    assert told(e, 3, 2)[1] is None  # too early
    e, first = told(e, 5, 2)
    assert first == pytest.approx(98 / (0.7 * (1 / 5) + 0.3 * (2 / 5)))
    assert moved(e, 4, 50) is None  # back in time
    e, second = told(moved(e, 10, 50), 10, 50)
    assert second < first
    assert told(e, 11, 100)[1] == 0


def test_samples_are_compared_with_the_last_taken(spark):
    rows = [(5, 10), (50, 10), (20, 20), (60, 30), (70, 130), (71, -5)]
    samples = [(run, i + 1, float(t), float(p)) for run in (1, 2) for i, (t, p) in enumerate(rows)]
    table = spark.createDataFrame([*samples, (3, 1, None, 4.0)], "run long, i int, elapsed double, percent double")
    batch = {(r["run"], r["i"]): r["eta"] for r in remaining(table).collect()}
    assert set(batch) == {(run, i) for run in (1, 2) for i in (1, 3, 4, 5)} and batch[1, 5] == 0
    assert [x[1:] for x in fold(Trail(), [s[1:] for s in samples[:6]])] == [(i, batch[1, i]) for i in (1, 3, 4, 5)]
    assert remaining(table.limit(0)).count() == 0
