"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.sources.tables import checkpointed, shared_folder  # noqa: F401, operators take them from here

#: The ASCII white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that an operator works on at once; a longer text is alone.
PART_BYTES = 8 << 20


def small_parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts whose texts, or lists of 8-byte numbers, in the given column have about PART_BYTES: Spark bounds
    a batch, but by far more."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(sizes, 0).to_numpy() * (8 if pa.types.is_list(values.type) else 1)
        start, size = 0, 0
        for nth, own in enumerate(sizes.tolist()):
            if nth > start and size + own > PART_BYTES:
                yield batch.slice(start, nth - start)
                start, size = nth, 0
            size += own
        if batch.num_rows > start:
            yield batch.slice(start)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, and by name, on a missing column."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
