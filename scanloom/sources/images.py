"""Folders of images as rows. Spark decodes them; what it can't decode is kept apart, counted, or left out."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.functions import pixels as K

SUFFIXES = "*.{jpg,jpeg,png,bmp,JPG,JPEG,PNG,BMP}"
SIZE = 128
#: The classes in their order, with the names that reports show.
CLASSES = ((0, "glioma_tumor", "Glioma"), (1, "meningioma_tumor", "Meningioma"), (2, "no_tumor", "No tumor"), (3, "pituitary_tumor", "Pituitary"))
IMAGE_SCHEMA = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def class_dimension(spark: SparkSession, classes: tuple = CLASSES) -> DataFrame:
    return spark.createDataFrame(list(classes), "class_id int, class_name string, class_label string")


def with_path_parts(df: DataFrame, path: str | Column) -> DataFrame:
    """df with path, split, class_name and file_name, from .../<split>/<class>/<file>; the path is URL-decoded."""
    plain = F.url_decode(F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\+", "%2B"))
    return df.withColumn("path", plain).withColumns({"split": F.regexp_extract("path", "/([^/]+)/[^/]+/[^/]+$", 1), "class_name": F.regexp_extract("path", "/([^/]+)/[^/]+$", 1), "file_name": F.regexp_extract("path", "([^/]+)$", 1)})


def read_images(spark: SparkSession, root: str, classes: DataFrame | None = None, drop_invalid: bool = True) -> DataFrame:
    """image (Spark's struct), path, split, class_name, file_name, label. drop_invalid: leave out what can't be decoded;
    otherwise such rows stay, with a width of -1."""
    images = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES).option("dropInvalid", drop_invalid).load(root)
    rows = with_path_parts(images, "image.origin")
    names = F.broadcast((classes or class_dimension(spark)).select(F.col("class_id").alias("label"), "class_name"))  # a handful of classes
    return rows.join(names, "class_name", "left")


def rejects(images: DataFrame) -> DataFrame:
    """The paths that Spark couldn't decode."""
    return images.filter("image.width = -1").select("path")


def gray_plane(h: int, w: int, channels: int, data: bytes, size: int) -> np.ndarray:
    """The grey levels of a decoded image, size x size."""
    plane = np.frombuffer(data, np.uint8).reshape(h, w, channels)
    return K.resize(plane[:, :, 0] if channels == 1 else K.luma(plane), size)


def to_gray(images: DataFrame, size: int = SIZE, keep: tuple[str, ...] = ("path", "split", "class_name", "file_name", "label")) -> DataFrame:
    """(keep, image_id, h, w, pixels): grey levels of size x size, packed. Rows without a decoded image are left out."""
    kinds = dict(images.dtypes)

    def grey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            planes = [gray_plane(h, w, c, data, size).tobytes() for h, w, c, data in zip(frame["_h"], frame["_w"], frame["_c"], frame["_data"], strict=True)]
            yield frame[list(keep)].assign(image_id=frame["path"], h=size, w=size, pixels=planes)

    rows = images.filter("image.width > 0").select(*keep, F.col("image.height").alias("_h"), F.col("image.width").alias("_w"), F.col("image.nChannels").alias("_c"), F.col("image.data").alias("_data"))
    return rows.mapInPandas(grey, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "image_id string, h int, w int, pixels binary"]))


def stream_images(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The images of a folder as they arrive, with the columns of read_images but for the label."""
    schema = StructType.fromDDL(IMAGE_SCHEMA)
    images = spark.readStream.format("image").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return with_path_parts(images, "image.origin")


def png_bytes(h: int, w: int, pixels: bytes) -> bytes:
    """A grey PNG of 8 bits. The signature, the chunks IHDR, IDAT and IEND, and filter 0 before each row."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + pixels[y * w : (y + 1) * w] for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_pngs(planes: DataFrame, root: str) -> int:
    """planes: split, class_name, file_name, h, w, pixels. Writes <root>/<split>/<class>/<file> from the executors, to any
    store that Arrow knows by the root's scheme; each file is put in place when it is whole, so a task that runs again does
    no harm. Gives the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", root))
        n, folders = 0, set()
        for batch in batches:
            for row in batch.to_pylist():
                folder = f"{base}/{row['split']}/{row['class_name']}"
                if folder not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                part = f"{folder}/.{row['file_name']}.part"
                with store.open_output_stream(part) as out:
                    out.write(png_bytes(row["h"], row["w"], row["pixels"]))
                store.move(part, f"{folder}/{row['file_name']}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return planes.select("split", "class_name", "file_name", "h", "w", "pixels").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
