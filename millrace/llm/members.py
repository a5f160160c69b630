"""A fixed-size bitmap of hashed 64-bit ids: a filter before a shuffle, never a replacement of the join after it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

BITS = 24


def places(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """2^24 bits (2 MB whatever the table's size) with the places of ``ids`` set; executors set the bits."""
    import pyarrow as pa

    def work(batches):
        bits = np.zeros(1 << BITS, bool)
        for b in batches:
            bits[places(b.column(0).drop_null().to_numpy())] = True
        packed = np.packbits(bits).view(np.uint64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at].view(np.int64))], ["at", "bits"])

    got = ids.select(F.col(column).cast("bigint")).mapInArrow(work, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros((1 << BITS) // 64, np.int64)
    packed[got["at"].to_numpy()] = got["bits"].to_numpy()
    return packed.view(np.uint8)


def holds(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = places(ids)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
