"""Prediction, key matching, tile reprojection and registered functions."""

import numpy as np
import pytest
import stand_ins
from pyspark.sql import functions as F

from kerbline.functions.register import register
from kerbline.operators import measures, predict


def test_masks_from_stored_logits(spark):
    x = np.zeros((4, 2, 2), "<f4")
    x[2, 0, 0] = x[1, 1, 1] = 5
    rows = spark.createDataFrame([(20, 1, 1, x.tobytes()), (20, 1, 2, b"bad"), (20, 1, 3, x.tobytes())], "z int, x long, y long, content binary")
    got = {r["y"]: r for r in predict.predict_masks(rows, stand_ins.StoredLogits(), rows.where("y = 3"), size=4).collect()}
    assert set(got) == {1, 2}
    mask = np.frombuffer(got[1]["mask"], np.uint8).reshape(4, 4)
    assert mask[0, 0] == 2 and mask[3, 3] == 1 and mask[0, 3] == 0
    assert got[2]["mask"] is None and got[2]["error"]


@pytest.mark.parametrize("batch", [1, 2, 5, 64])
def test_images_of_several_batches_go_in_one_call(spark, batch):
    rng = np.random.default_rng(2)
    rows = [(20, 1, y, rng.normal(size=(4, 2, 2)).astype("<f4").tobytes()) for y in range(23)]
    rows[7] = (20, 1, 7, np.full((4, 2, 2), np.nan, "<f4").tobytes())
    rows[8] = (20, 1, 8, b"bad")
    images = spark.createDataFrame(rows, "z int, x long, y long, content binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        alone = {r["y"]: r["mask"] for r in predict.predict_masks(images, stand_ins.Refusing(), size=4).collect()}
        counted = stand_ins.Together(batch, spark.sparkContext.accumulator(0))
        got = {r["y"]: (r["mask"], r["error"]) for r in predict.predict_masks(images, counted, size=4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {y: m for y, (m, _) in got.items()} == alone and sum(m is None for m in alone.values()) == 2
    assert "refused" in got[7][1] and got[8][1]

    def calls(low, high):
        whole = high - low == 1 or not {7, 8} & set(range(low, high))
        half = low + (high - low) // 2
        return 1 if whole else 1 + calls(low, half) + calls(half, high)

    assert counted.calls.value == sum(calls(k, min(k + batch, 23)) for k in range(0, 23, batch))


def test_two_outputs_use_the_first():
    class Two(stand_ins.StoredLogits):
        def logits(self, image):
            return [super().logits(image), None]

    assert predict.class_mask(Two().logits(np.ones((4, 1, 1), "<f4").tobytes())[0], 2, 2).tolist() == [[0, 0], [0, 0]]


def test_resize_agrees_with_the_column_form(spark):
    x = np.random.default_rng(0).normal(size=(1, 4, 4))
    got = spark.createDataFrame([(x.ravel().tolist(),)], "g array<double>").select(measures.upsampled(F.col("g"), 4, 8).alias("v")).first()["v"]
    assert np.allclose(predict.resized(x, 8, 8).ravel(), got)


def test_preprocessing():
    out = predict.preprocessed(np.full((2, 3, 3), 255, np.uint8))
    assert out.shape == (3, 2, 3) and out.dtype == np.float32
    assert out[0, 0, 0] == pytest.approx((1 - 0.485) / 0.229, rel=1e-6)


def test_keys(spark):
    model = spark.createDataFrame([(1, "net.a.w"), (2, "a.w"), (3, "net.b.w"), (4, "old.b.w")], "pos int, name string")
    keys = spark.createDataFrame([("module.a.w",), ("backbone.b.w",), ("c.w",)], "key string")
    got = predict.match_keys(keys, model)
    assert {r["key"]: r["matched"] for r in got.collect()} == {"module.a.w": "a.w", "backbone.b.w": "net.b.w", "c.w": None}
    assert tuple(predict.load_counts(got).first()) == (2, 1)
    with pytest.raises(Exception, match="fits the model"):
        predict.load_counts(predict.match_keys(keys.where("key = 'c.w'"), model)).collect()


def test_reprojection():
    rows = predict.source_rows(330000, 20)
    first = int(rows.min() // 256)
    tiles = {k: np.full((256, 4, 3), 7 * (k - first) + 10, np.uint8) for k in range(first, int(rows.max() // 256) + 1)}
    out = predict.reprojected(330000, 20, tiles)
    assert out.shape == (256, 4, 3) and out.min() >= 10
    assert (np.diff(rows) > 0).all()
    assert predict.reprojected(330000, 20, {}) is None


def test_registered_functions(spark):
    register(spark)
    r = spark.sql("SELECT kb_tile_x(0D, 20) x, kb_tile_y(0D, 20) y, kb_narrow_width(array(10D, 20D)) w, kb_cross_section(array(0D, 200D, 200D, 0D), array(0D, 0D, 40D, 40D), 100D, 20D, 1D, 0D) c").first()
    assert (r["x"], round(r["y"], 6), r["w"], round(r["c"], 6)) == (524288.0, 524288.0, 1.2, 40.0)
