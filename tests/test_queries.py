"""Every query that SQL can express gives DuckDB's rows; the others have their columns."""

from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as driver
from kerbline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def as_rows(rows, order):
    return sorted(tuple(repr(r[i] + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLE[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert as_rows(got.collect(), [got.columns.index(c) for c in names]) == as_rows(want.fetchall(), [want.columns.index(c) for c in names])


def test_pauses_round_as_sql_does(spark, tmp_path):
    start, us = datetime(2024, 1, 1), [0, 928161912600, 928161916200, 1912432665000]  # the second is 257.8227535 s
    rows = [(k + 1, start + timedelta(microseconds=t), 1, 1.0 + k) for k, t in enumerate(us)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE["eta_pauses"])
    got = catalogue.QUERIES["eta_pauses"](spark, str(tmp_path)).select(*want.columns)
    assert as_rows(got.collect(), range(5)) == as_rows(want.fetchall(), range(5))
    assert any(r["elapsed"] == 257.822753 for r in got.collect())


def test_stream_and_batch_agree(spark, sf_dir):
    both = [{(r["run"], r["i"]): r["eta"] for r in catalogue.QUERIES[n](spark, sf_dir).collect()} for n in ("eta_batch", "eta_stream")]
    assert both[0] == both[1] and both[0]


@pytest.mark.parametrize("name", ["cross_sections", "edge_width_full", "crosswalk_target", "polygon_assignment"])
def test_kernels_run_over_whole_tables(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_widths_are_bounded(spark, sf_dir):
    rows = catalogue.QUERIES["cross_sections"](spark, sf_dir).where("width_px IS NOT NULL").selectExpr("min(width_px) lo", "max(width_px) hi").first()
    assert 0 < rows["lo"] <= rows["hi"] <= 240


def test_entry(spark):
    assert driver.entry(spark).columns == ["feature_idx", "part_idx", "n_tiles", "n_missing", "eligible"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
