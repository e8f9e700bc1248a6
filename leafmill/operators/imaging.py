"""Image measures over arrays of samples, and the decisions taken from them.

The measures need pixels and are vectorised UDFs; the decisions are Column expressions over them.
``gray``: row-major 8-bit samples as binary. Spark's own ``image`` source decodes files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.plans.policy import PRESETS, TYPE_STEPS, preset_steps

_QUALITY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("pixels", "contrast", "sharpness")])
_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("deviation", "noise", "edges")])
_DARK = T.StructType([T.StructField(n, T.DoubleType()) for n in ("dark", "median")])


def _arrays(gray: pd.Series, width: pd.Series):
    for g, w in zip(gray, width, strict=True):
        yield None if g is None or not w or len(g) < w else np.frombuffer(g, np.uint8)[: len(g) // w * w].reshape(-1, int(w)).astype(float)


def _small(a: np.ndarray, most: int) -> np.ndarray:
    step = max(1, -(-max(a.shape) // most))
    return a[::step, ::step]


def _inside(a: np.ndarray, most: int) -> np.ndarray:
    """Means of equal blocks, so that neither side is longer than ``most``; smaller images stay as they are."""
    k = -(-max(a.shape) // most)
    if k <= 1:
        return a
    rows, columns = np.arange(0, a.shape[0], k), np.arange(0, a.shape[1], k)
    sums = np.add.reduceat(np.add.reduceat(a, rows, axis=0), columns, axis=1)
    sizes = np.outer(np.diff(np.append(rows, a.shape[0])), np.diff(np.append(columns, a.shape[1])))
    return sums / sizes


@F.pandas_udf(_QUALITY)
def quality_measures(gray: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Pixels, and of the image reduced to 512 a side: deviation of the samples, mean absolute difference of neighbours."""
    rows = []
    for a in _arrays(gray, width):
        if a is None:
            rows.append((None, None, None))
            continue
        size, a = a.size, _inside(a, 512)
        d = [np.abs(np.diff(a, axis=k)) for k in (0, 1) if a.shape[k] > 1]
        n = sum(x.size for x in d)
        rows.append((float(size), float(a.std()), float(sum(x.sum() for x in d) / n) if n else 0.0))
    return pd.DataFrame(rows, columns=["pixels", "contrast", "sharpness"])


def quality_level(m: Column) -> Column:
    """Low below 300,000 pixels or either lower bound, high above both upper bounds."""
    low = (m["pixels"] < 300_000) | (m["contrast"] < 10) | (m["sharpness"] < 2)
    return F.when(m["pixels"].isNull() | low, "low").when((m["contrast"] >= 18) & (m["sharpness"] >= 4), "high").otherwise("medium")


@F.pandas_udf(_DARK)
def darkness(gray: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Share of samples under 128 and the upper median, on at most 400 samples a side."""
    rows = []
    for a in _arrays(gray, width):
        if a is None:
            rows.append((None, None))
            continue
        s = np.sort(_small(a, 400).ravel())
        rows.append((float((s < 128).mean()), float(s[len(s) // 2])))
    return pd.DataFrame(rows, columns=["dark", "median"])


def is_inverted(m: Column) -> Column:
    return F.coalesce((m["dark"] > 0.6) & (m["median"] < 80), F.lit(False))


@F.pandas_udf(_TYPE)
def type_measures(gray: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Deviation, local differences on 100 x 100 samples, and on 200 the share of samples that stand out from their eight neighbours."""
    rows = []
    for a in _arrays(gray, width):
        if a is None:
            rows.append((None, None, None))
            continue
        flat, e = _small(a, 100).ravel(), _small(a, 200)
        n = len(flat)
        noise = (np.abs(flat[32 : n - 32] - flat[: n - 64]).sum() + np.abs(flat[32 : n - 32] - flat[33 : n - 31]).sum()) / (2 * n) if n > 64 else 0.0
        around = np.pad(e, 1, mode="edge")
        h, w = e.shape
        nine = sum(around[i : i + h, j : j + w] for i in range(3) for j in range(3))
        rows.append((float(a.std()), float(noise), float((np.clip(9 * e - nine, 0, 255) > 40).mean())))
    return pd.DataFrame(rows, columns=["deviation", "noise", "edges"])


def document_type(m: Column) -> Column:
    low_contrast, high_contrast = m["deviation"] < 30, m["deviation"] > 65
    low_noise, high_noise = m["noise"] < 8, m["noise"] > 20
    table = (m["edges"] > 0.04) & (m["edges"] < 0.30) & ~high_noise
    return (
        F.when(table, "table")
        .when(high_noise & ~high_contrast & (m["edges"] > 0.03), "handwriting")
        .when(low_contrast & ~low_noise, "photo")
        .otherwise("scan")
    )


def step_log(preset: Column, inverted: Column, kind: Column | None = None) -> Column:
    """The steps a preset takes for a page; an unknown preset takes none. ``kind``: a measured type, null for the preset's own."""
    kinds = ["", *TYPE_STEPS]
    every = {f"{p}/{i}/{k}": preset_steps(p, bool(i), k or None) for p in PRESETS for i in (0, 1) for k in kinds}
    table = F.create_map(*[x for k, v in every.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    asked = F.concat_ws("/", preset, F.coalesce(inverted, F.lit(False)).cast("int").cast("string"), F.coalesce(kind, F.lit("")) if kind is not None else F.lit(""))
    return F.coalesce(F.try_element_at(table, asked), F.array().cast("array<string>"))


def _blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    for axis in (0, 1):
        p = np.pad(a, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        n = a.shape[axis]
        a = sum(w * (p[k : k + n] if axis == 0 else p[:, k : k + n]) for k, w in enumerate(weights))
    return a


def _sharpened(a: np.ndarray, sigma: float, m1: float, m2: float, x1: float, y2: float, y3: float) -> np.ndarray:
    """Differences from the blurred image, on a scale of 100, raised by ``m1`` where small, by ``m2`` beyond ``x1``, within limits."""
    d = (a - _blurred(a, sigma)) / 2.55
    more = np.where(np.abs(d) > x1, np.sign(d) * (m1 * x1 + m2 * (np.abs(d) - x1)), m1 * d)
    return a + np.clip(more, -y3, y2) * 2.55


def preprocess(samples: np.ndarray, steps: list[str]) -> np.ndarray:
    """Apply the steps of a log to 8-bit grey samples."""
    linear = {t[1][0]: t[1][1:] for t in TYPE_STEPS.values()}
    sharpen = {t[2][0]: t[2][1:] for t in TYPE_STEPS.values()}
    edges = {t[3][0]: t[3][1] for t in TYPE_STEPS.values() if t[3]}
    a = samples.astype(float)
    for s in steps:
        if s.startswith("invert"):
            a = 255 - a
        elif s.startswith("normalize"):
            low, high = np.percentile(a, (1, 99))
            if high > low:
                a = (a - low) * 255 / (high - low)
        elif s in linear:
            a = a * linear[s][0] + linear[s][1]
        elif s in sharpen:
            a = _sharpened(a, *sharpen[s])
        elif s in edges:
            p = np.pad(a, 1, mode="edge")
            rows = p[2:] - p[:-2]
            a = (rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / edges[s]
        a = np.clip(a, 0, 255)
    return np.floor(a + 0.5).clip(0, 255).astype(np.uint8)


def prepare(images: DataFrame, gray: str = "gray", width: str = "width", preset: str = "preset") -> DataFrame:
    """Preprocessed samples beside a log of the steps; the original's digest is kept as lineage."""

    @F.pandas_udf(T.BinaryType())
    def apply(g: pd.Series, w: pd.Series, steps: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else preprocess(a, list(s)).tobytes() for a, s in zip(_arrays(g, w), steps, strict=True)])

    with_steps = images.withColumn("inverted", is_inverted(darkness(gray, width))).withColumn("steps", step_log(F.col(preset), F.col("inverted")))
    return with_steps.withColumn("prepared", apply(gray, width, "steps")).withColumn("original_sha1", F.substring(F.sha1(F.col(gray)), 1, 16))


@F.pandas_udf(T.BinaryType())
def crop(gray: pd.Series, width: pd.Series, box: pd.DataFrame) -> pd.Series:
    """A rectangle of the samples, as ``crop_box`` gives it."""
    out = []
    for a, (left, top, w, h) in zip(_arrays(gray, width), box[["left", "top", "width", "height"]].itertuples(index=False), strict=True):
        out.append(None if a is None else a[int(top) : int(top + h), int(left) : int(left + w)].astype(np.uint8).tobytes())
    return pd.Series(out)


def optimized_size(width: Column, height: Column, most: int = 4096) -> Column:
    """Sides after the cap, with the ratio kept."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct(F.floor(width * scale + 0.5).cast("int").alias("width"), F.floor(height * scale + 0.5).cast("int").alias("height"))
