"""Character trigram models of a fixed size.

The vocabulary is one for all models: the printable ASCII characters, white space as one line end, and all others dealt
over the classes that are left. A trigram is a number below 128^3, so counts of any corpus are one array, and a model
of it is an array of losses, in nats, with each order smoothed by the next lower one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES, ORDER = 128, 3
SIZE = CLASSES**ORDER
#: How many observations the lower order counts for.
SMOOTHING = 5.0
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    points = np.arange(0x110000)
    found = 96 + points % 32
    found[32:127] = points[32:127] - 31  # 1 to 95
    found[[9, 10, 11, 12, 13]] = 0
    return found.astype(np.int32)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """The trigram that ends at each character, in pieces; the text follows two line ends."""
    before = np.zeros(ORDER - 1, np.int32)
    for at in range(0, len(text), CHUNK):
        own = np.concatenate((before, classes()[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]))
        yield (own[:-2] * CLASSES + own[1:-1]) * CLASSES + own[2:]
        before = own[-2:]


def counted(rows: DataFrame, groups: int) -> np.ndarray:
    """rows: text and group (0 to groups - 1; null: none). Trigram counts of each group, and of all rows last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((groups + 1, SIZE), np.int64)
        waiting: dict[int, list[np.ndarray]] = {g: [] for g in range(groups + 1)}

        def add(g: int, codes: np.ndarray, least: int = CHUNK) -> None:
            waiting[g].append(codes)
            if sum(map(len, waiting[g])) >= least:
                found[g] += np.bincount(np.concatenate(waiting[g]), minlength=SIZE)
                waiting[g].clear()

        for batch in batches:
            for text, group in zip(*batch.columns, strict=True):
                g = group.as_py()
                for codes in trigrams(text.as_py() or ""):
                    add(groups if g is None else g, codes)
        for g in waiting:
            add(g, np.empty(0, np.int32), 0)
        found[groups] = found.sum(axis=0)
        which, code = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(code, pa.int32()), pa.array(found[which, code], pa.int64())], ["which", "code", "n"])

    table = rows.select("text", "group").mapInArrow(count, "which int, code int, n long").groupBy("which", "code").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros((groups + 1, SIZE), np.int64)
    found[table["which"].to_numpy(), table["code"].to_numpy()] = table["n"].to_numpy()
    return found


def losses(counts: np.ndarray) -> np.ndarray:
    """The loss of each trigram's last character given the two before it."""
    three = counts.astype(float).reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p = (one + 1) / (one.sum() + CLASSES)
    p = (two + SMOOTHING * p) / (two.sum(axis=1, keepdims=True) + SMOOTHING)
    p = (three + SMOOTHING * p) / (three.sum(axis=2, keepdims=True) + SMOOTHING)
    return -np.log(p).reshape(-1).astype(np.float32)
