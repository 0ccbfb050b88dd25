"""Jobs over images: one Arrow batch of image rows in, rows of features, masks or planes out. No shuffle.

Image rows are (image_id, h, w, pixels) and any other columns, pixels being the grey levels packed in rows. A batch is
cut into groups of one shape, and groups into blocks, so the kernels' working memory is bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import pixels as K
from scanloom.operators.cohort import is_accepted
from scanloom.sources.images import SIZE, gray_plane

#: Pixels that a kernel works on at once.
BLOCK_PIXELS = 64 * 128 * 128


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in batches:
        for (h, w), group in frame.groupby(["h", "w"], sort=False):
            step = max(1, BLOCK_PIXELS // max(1, h * w))
            for at in range(0, len(group), step):
                part = group.iloc[at : at + step]
                yield part, np.stack([np.frombuffer(p, np.uint8).reshape(h, w) for p in part["pixels"]])


def _schema(df: DataFrame, keep: tuple[str, ...], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), more])


def _doubles(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} double" for n in names)


def _feature_rows(df: DataFrame, keep: tuple[str, ...], names: tuple[str, ...], kernel: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, block in _blocks(batches):
            values, valid = kernel(block)
            rows = part[list(keep)] if valid is None else part.loc[valid, list(keep)]
            yield pd.concat([rows.reset_index(drop=True), pd.DataFrame(values, columns=list(names))], axis=1)

    return df.select(*dict.fromkeys([*keep, "h", "w", "pixels"])).mapInPandas(run, _schema(df, keep, _doubles(names)))


def features_f10(df: DataFrame, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Ten features of every image; borders are reflected without their edge."""
    return _feature_rows(df, keep, K.F10, lambda x: (K.features_f10(K.preprocess(x, "reflect")), None))


def features_f13(df: DataFrame, keep: tuple[str, ...] = ("image_id",), least: int = 300) -> DataFrame:
    """Thirteen features of each image with a valid region; the other images have no row. Borders repeat their edge."""
    return _feature_rows(df, keep, K.F13, lambda x: K.features_f13(K.preprocess(x, "symmetric"), least))


def described_f13(images: DataFrame, keep: tuple[str, ...] = ("path", "file_name"), least: int = 300, size: int = SIZE) -> DataFrame:
    """One pass over images as read: keep, reason and the thirteen features. Each image has a row: reason tells why it has
    no features (file type, not decoded, no valid region), and is null if it has."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), step := max(1, BLOCK_PIXELS // (size * size))):
                part = frame.iloc[at : at + step].reset_index(drop=True)
                reason = np.where(~part["_accepted"].to_numpy(bool), "file type", np.where(part["_w"].to_numpy() > 0, "", "not decoded")).astype(object)
                rows = np.flatnonzero(reason == "")
                values = np.full((len(part), len(K.F13)), np.nan)
                if rows.size:
                    block = np.stack([gray_plane(*part.loc[i, ["_h", "_w", "_c", "_data"]], size) for i in rows])
                    found, valid = K.features_f13(K.preprocess(block, "symmetric"), least)
                    values[rows[valid]] = found
                    reason[rows[~valid]] = "no valid region"
                out = part[list(keep)].assign(reason=pd.Series(reason).replace("", None))
                yield pd.concat([out, pd.DataFrame(values, columns=list(K.F13))], axis=1)

    rows = images.select(*keep, F.coalesce(is_accepted("path"), F.lit(False)).alias("_accepted"), F.coalesce("image.height", F.lit(-1)).alias("_h"), F.coalesce("image.width", F.lit(-1)).alias("_w"), F.coalesce("image.nChannels", F.lit(-1)).alias("_c"), F.col("image.data").alias("_data"))
    return rows.mapInPandas(describe, _schema(images, keep, "reason string, " + _doubles(K.F13)))


def features_d10(df: DataFrame, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return _feature_rows(df, keep, K.D10, lambda x: (K.features_d10(K.preprocess(x, "reflect")), None))


def quality(df: DataFrame, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The quality score of each raw image."""
    return _feature_rows(df, keep, ("quality",), lambda x: (K.quality_score(x)[:, None], None))


def texture(df: DataFrame, keep: tuple[str, ...] = ("image_id",), whole: bool = True) -> DataFrame:
    """Local patterns, gradients and co-occurrences of whole normalised images, without a region."""
    names = ("lbp_mean", "lbp_std", "lbp_energy", "lbp_entropy", "gradient_mean", "gradient_std", "gradient_max", "glcm_contrast", "glcm_homogeneity", "glcm_energy", "glcm_correlation")

    def kernel(x: np.ndarray) -> tuple[np.ndarray, None]:
        n = K.normalize(x)
        return np.concatenate((K.lbp(n), K.gradient(n), [K.glcm_features((i * 31).astype(np.uint8)) for i in n]), axis=1), None

    return _feature_rows(df, keep, names, kernel)


MEASURES = ("mean", "std", "skewness", "kurtosis", "local_entropy", "border_compactness", "edge_compactness", "perimeter")


def region_measures(df: DataFrame, keep: tuple[str, ...] = ("image_id",), above: int = 127) -> DataFrame:
    """Moments, entropy and outlines of the pixels above a level, in raw images; images without any have no row."""

    def kernel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        masks, n = x > above, K.normalize(x)
        outlines = np.stack((K.border_compactness(masks), K.edge_compactness(masks), K.weighted_perimeter(masks)), axis=1)
        valid = masks.any(axis=(1, 2))
        return np.array([(*K.moments(i[m], 1e-8), K.local_entropy(i[m]), *o) for i, m, o in zip(n[valid], masks[valid], outlines[valid], strict=True)]).reshape(-1, len(MEASURES)), valid

    return _feature_rows(df, keep, MEASURES, kernel)


def overlays(df: DataFrame, keep: tuple[str, ...] = ("image_id",), mask: Callable[[np.ndarray], np.ndarray] = lambda x: K.segment_stages(K.preprocess(x))[3], colour: tuple[int, int, int] = (255, 0, 0)) -> DataFrame:
    """(keep, h, w, rgb): previews of normalised images with their region in colour, packed by pixel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, block in _blocks(batches):
            planes = [K.overlay(n, m, colour).astype(np.uint8).tobytes() for n, m in zip(K.normalize(block), mask(block), strict=True)]
            yield part[[*keep, "h", "w"]].reset_index(drop=True).assign(rgb=planes)

    return df.select(*dict.fromkeys([*keep, "h", "w", "pixels"])).mapInPandas(run, _schema(df, keep, "h int, w int, rgb binary"))


#: Planes of levels by name, from raw images. Masks are 0 and 1.
STAGES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "raw": lambda x: x,
    "blurred": lambda x: K.blur(x),
    "equalized": lambda x: K.equalize_hist(K.blur(x)),
    "normalized": lambda x: (K.preprocess(x) * 255).astype(np.uint8),
    "binary": lambda x: K.segment_stages(K.preprocess(x))[0],
    "eroded": lambda x: K.segment_stages(K.preprocess(x))[1],
    "component": lambda x: K.segment_stages(K.preprocess(x))[2],
    "final": lambda x: K.segment_stages(K.preprocess(x))[3],
    "symmetric_blur": lambda x: K.blur(x, "symmetric"),
    "only_equalized": lambda x: K.equalize_hist(x),
    "only_eroded": lambda x: K.erode(x > 127),
    "only_dilated": lambda x: K.dilate(x > 127),
    "only_component": lambda x: K.largest_component(x > 127),
    "lbp": lambda x: K.lbp_codes(K.normalize(x)),
    "chan_vese": lambda x: K.segment_chan_vese(K.preprocess(x, "symmetric")),
    "brain": lambda x: K.brain_mask(K.preprocess(x, "symmetric")),
}
REPORTED_STAGES = ("raw", "blurred", "equalized", "normalized", "binary", "eroded", "component", "final")


def stage_planes(df: DataFrame, stages: tuple[str, ...] = REPORTED_STAGES, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keep, stage, h, w, pixels): the planes of each image after the named stages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, block in _blocks(batches):
            for stage in stages:
                planes = STAGES[stage](block).astype(np.uint8)
                rows = part[[*keep, "h", "w"]].reset_index(drop=True)
                yield rows.assign(stage=stage, pixels=[p.tobytes() for p in planes])[[*keep, "stage", "h", "w", "pixels"]]

    return df.select(*dict.fromkeys([*keep, "h", "w", "pixels"])).mapInPandas(run, _schema(df, keep, "stage string, h int, w int, pixels binary"))


def thresholds(df: DataFrame, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The Otsu threshold, the 82nd percentile and the normalised range of each preprocessed image."""
    names = ("otsu", "p82", "low", "high")

    def kernel(x: np.ndarray) -> tuple[np.ndarray, None]:
        n = K.preprocess(x)
        flat = n.reshape(len(n), -1)
        return np.stack((K.otsu_threshold(n), np.percentile(flat, 82, axis=1), flat.min(axis=1), flat.max(axis=1)), axis=1), None

    return _feature_rows(df, keep, names, kernel)


def boxes(masks: DataFrame, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keep, y0, x0, y1, x1) of mask planes, ends exclusive."""
    names = ("y0", "x0", "y1", "x1")
    return _feature_rows(masks, keep, names, lambda x: (np.array([K.bounding_box(m > 0) for m in x], float), None)).select(*keep, *[F.col(n).cast("int").alias(n) for n in names])


def pixel_table(planes: DataFrame, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keep, y, x, v): one row per pixel. For tests and small reports: production jobs keep planes packed."""
    text = F.hex("pixels")
    levels = F.transform(F.sequence(F.lit(0), F.octet_length("pixels") - 1), lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    rows = planes.select(*keep, "w", F.posexplode(levels).alias("p", "v"))
    return rows.select(*keep, F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), "v")


def feature_table(df: DataFrame, class_column: str, name_column: str, n: int, label_column: str | None = None) -> DataFrame:
    """The report's table: the first n images of each class with their ten display features, as numbers and as text with
    four decimals, and a running number over (class, file)."""
    from scanloom.operators.cohort import first_per_class

    chosen = first_per_class(df.withColumn("image_id", F.col(name_column)), class_column, name_column, n)
    rows = features_d10(chosen, (class_column, name_column, "nth"))
    index = F.row_number().over(Window.orderBy(class_column, "nth"))  # a report of n rows per class
    return rows.withColumn("index", index).select("index", F.col(name_column).alias("file_name"), F.col(label_column or class_column).alias("class_label"), *K.D10, *[F.format_string("%.4f", F.col(c)).alias(f"{c}_text") for c in K.D10])
