"""Masks from tiles by a network that is given: batches of images in, class masks out.

A predictor is any object with ``load()`` (once a worker) and ``logits(image)`` giving
(classes, h, w) for a float image (3, H, W). The first of its outputs is used if there are
several. One that takes many images at once has ``logits_of(images)``, giving (n, classes,
h, w) for (n, 3, H, W), and ``batch``, how many. One with a true ``raw`` gets the bytes.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EARTH_ECCENTRICITY, IMAGE_MEAN, IMAGE_STD, TILE_SIZE
from .tiles import TILE_KEY

_OUT = "z int, x long, y long, mask binary, error string"


class Predictor(Protocol):
    def load(self) -> None: ...

    def logits(self, image: np.ndarray): ...


def preprocessed(rgb: np.ndarray) -> np.ndarray:
    """An 8-bit image (H, W, 3) as normalised float32 (3, H, W)."""
    scaled = (rgb.astype(np.float32) / 255 - np.float32(IMAGE_MEAN)) / np.float32(IMAGE_STD)
    return np.ascontiguousarray(scaled.transpose(2, 0, 1), dtype=np.float32)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize of (classes, h, w), pixel centres kept at half places."""
    for axis, out in ((1, height), (2, width)):
        n = x.shape[axis]
        at = np.maximum((np.arange(out) + 0.5) * n / out - 0.5, 0)
        low = np.floor(at).astype(int)
        t = (at - low).reshape([-1 if a == axis else 1 for a in range(3)])
        x = np.take(x, low, axis) * (1 - t) + np.take(x, np.minimum(low + 1, n - 1), axis) * t
    return x


def class_mask(logits: np.ndarray, height: int, width: int) -> np.ndarray:
    """The first class of the greatest logit of each pixel."""
    return resized(np.asarray(logits, np.float32), height, width).argmax(0).astype(np.uint8)


def _first_output(got):
    return got[0] if isinstance(got, (list, tuple)) else got


def _together(predictor: Predictor, images: list) -> list:
    """The logits of images, by one call if the network takes many."""
    if not hasattr(predictor, "logits_of"):
        return [_first_output(predictor.logits(x)) for x in images]
    got = list(_first_output(predictor.logits_of(np.stack(images) if isinstance(images[0], np.ndarray) else images)))
    if len(got) != len(images):
        raise ValueError(f"{len(got)} outputs for {len(images)} images")
    return got


def _each(predictor: Predictor, images: list) -> list:
    """The logits of each image, or what it failed with. A call for many images that fails is
    tried again by halves, so that only images that fail alone are lost."""
    try:
        return _together(predictor, images)
    except Exception as e:  # one bad tile must not end the others
        half = len(images) // 2
        return _each(predictor, images[:half]) + _each(predictor, images[half:]) if half else [e]


def predict_masks(images: DataFrame, predictor: Predictor, done: DataFrame | None = None, size: int = TILE_SIZE) -> DataFrame:
    """(z, x, y, mask, error) of ``images`` (z, x, y, content binary of 8-bit RGB rows).

    Tiles in ``done`` are skipped. A tile that fails has a null mask and its error; the
    others go on. Images are put together for one call across Arrow batches.
    """
    todo = images if done is None else images.join(done.select(*TILE_KEY), TILE_KEY, "left_anti")
    at_once = int(getattr(predictor, "batch", 1)) if hasattr(predictor, "logits_of") else 1

    def decoded(content):
        if getattr(predictor, "raw", False):
            return content
        return preprocessed(np.frombuffer(content, np.uint8).reshape(size, size, 3))

    def rows_of(held: list[tuple]) -> pd.DataFrame:
        ready, out = [], {}
        for k, (*_, content) in enumerate(held):
            try:
                ready.append((k, decoded(content)))
            except Exception as e:  # one bad tile must not end the others
                out[k] = e
        if ready:
            out |= zip((k for k, _ in ready), _each(predictor, [x for _, x in ready]))
        rows = []
        for k, (z, x, y, _) in enumerate(held):
            try:
                if isinstance(out[k], Exception):
                    raise out[k]
                rows.append((z, x, y, class_mask(out[k], size, size).tobytes(), None))
            except Exception as e:  # logits of a wrong shape, too
                rows.append((z, x, y, None, f"{type(e).__name__}: {e}"[:500]))
        return pd.DataFrame(rows, columns=["z", "x", "y", "mask", "error"])

    def run(batches):
        predictor.load()
        held: list[tuple] = []
        for b in batches:
            for row in zip(b["z"], b["x"], b["y"], b["content"]):
                held.append(row)
                if len(held) == at_once:
                    yield rows_of(held)
                    held = []
        if held:
            yield rows_of(held)

    return todo.select(*TILE_KEY, "content").mapInPandas(run, _OUT)


def clean_key(key: Column) -> Column:
    for word in ("model.", "backbone.", "module."):
        key = F.replace(key, F.lit(word), F.lit(""))
    return key


def match_keys(checkpoint: DataFrame, model: DataFrame) -> DataFrame:
    """``checkpoint`` (key) with the ``model`` key (pos, name) that it loads into, or null.

    Prefixes are taken off; then an equal key matches, else the first that ends so. All
    endings of model keys are listed, which makes it an equi-join.
    """
    ends = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), i, F.length("name")))
    tails = model.select("pos", "name", F.explode(ends).alias("clean"))
    best = tails.groupBy("clean").agg(F.min_by("name", F.struct(F.col("name") != F.col("clean"), "pos")).alias("matched"))
    return checkpoint.withColumn("clean", clean_key(F.col("key"))).join(best, "clean", "left").drop("clean")


def load_counts(matched: DataFrame) -> DataFrame:
    """How many keys load and how many are skipped; none that loads is an error."""
    loaded = F.count_if(F.col("matched").isNotNull())
    return matched.agg(F.when(loaded > 0, loaded).otherwise(F.raise_error(F.lit("no key of the checkpoint fits the model")).cast("long")).alias("loaded"), F.count_if(F.col("matched").isNull()).alias("skipped"))


def source_rows(tile_row: int, zoom: int, size: int = TILE_SIZE) -> np.ndarray:
    """Global source pixel row (ellipsoidal map) of each row of a tile (spherical map)."""
    world = size * 2**zoom
    phi = np.arctan(np.sinh(np.pi * (1 - 2 * (tile_row * size + np.arange(size) + 0.5) / world)))
    e = EARTH_ECCENTRICITY
    merc = np.log(np.tan(np.pi / 4 + phi / 2) * ((1 - e * np.sin(phi)) / (1 + e * np.sin(phi))) ** (e / 2))
    return (1 - merc / np.pi) / 2 * world


def reprojected(tile_row: int, zoom: int, sources: dict[int, np.ndarray], size: int = TILE_SIZE) -> np.ndarray | None:
    """An image tile blended row by row from the source tiles, by row number, of its column;
    none if one of those that it needs is missing."""
    at = source_rows(tile_row, zoom, size)
    first, last = int(at.min() // size), int(at.max() // size)
    if any(k not in sources for k in range(first, last + 1)):
        return None
    strip = np.concatenate([sources[k] for k in range(first, last + 1)]).astype(np.float32)
    at = np.clip(at - first * size - 0.5, 0, len(strip) - 1)
    low = np.floor(at).astype(int)
    t = (at - low).astype(np.float32)[:, None, None]
    mix = strip[low] * (1 - t) + strip[np.minimum(low + 1, len(strip) - 1)] * t
    return np.clip(np.rint(mix), 0, 255).astype(np.uint8)
