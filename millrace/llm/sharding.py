"""Jump consistent hashing of stable keys to shards, with gapless slots inside each shard.

A key's shard depends on the key and the number of shards alone: no ring table is
kept, and with one more shard about 1/(n+1) of the keys move, all of them into the
new shard.

Defined cases: null key columns count as a marker of their own and stay together;
repeated rows go to the same shard and get slots of their own; an empty table gives
an empty result; a null text has size 1 and the CRC-32 of the empty text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Multiplier of the jump sequence's generator, a fixed value of the published algorithm.
JUMP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard in ``[0, n)`` of each unsigned 64-bit key: it jumps ahead until the next jump leaves the range."""
    at = np.zeros(len(keys), np.int64)
    state, live = keys.astype(np.uint64), np.arange(len(keys))
    while len(live):
        state = state * JUMP + np.uint64(1)
        ahead = ((at[live] + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = ahead < n
        live, state = live[on], state[on]
        at[live] = ahead[on]
    return at.astype(np.int32)


def key_text(*keys: str) -> Column:
    """Text form of a stable key; the separator and the null marker can't be mistaken for values of ids."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])


def jump_shards(df: DataFrame, keys: list[str], shards: int, *, slot_buckets: int = 1024, order: list[str] | None = None) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless from 0 in each shard).

    Slots are numbered without bringing a shard into one task: each shard is cut into
    ``slot_buckets`` buckets by key hash, rows are numbered inside their bucket, and the
    bucket's first slot comes from a table of ``shards * slot_buckets`` counts at most, the
    only table that is broadcast. A key that repeats without bound would fill one bucket,
    so ``order`` columns take part in the bucket's hash.
    """
    if shards < 1 or slot_buckets < 1:
        raise ValueError("shards and slot_buckets must be at least 1")
    order = order or []

    @F.pandas_udf("struct<shard:int,grown_shard:int>")
    def place(high: pd.Series, low: pd.Series) -> pd.DataFrame:
        k = (high.to_numpy(np.uint64) << np.uint64(32)) | low.to_numpy(np.uint64)
        return pd.DataFrame({"shard": jump_hash(k, shards), "grown_shard": jump_hash(k, shards + 1)})

    digest = F.md5(key_text(*keys).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    bucket = F.conv(F.substring(F.md5(key_text(*keys, *order).cast("binary")), 25, 8), 16, 10).cast("long") % slot_buckets
    rows = df.withColumns({"_m_at": place(part(1), part(9)), "_m_bucket": bucket})
    rows = rows.withColumns({"shard": F.col("_m_at.shard"), "grown_shard": F.col("_m_at.grown_shard")}).drop("_m_at")
    sizes = rows.groupBy("shard", "_m_bucket").agg(F.count("*").alias("_m_n"))
    before = W.partitionBy("shard").orderBy("_m_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("shard", "_m_bucket", F.coalesce(F.sum("_m_n").over(before), F.lit(0)).alias("_m_first"))
    inside = F.row_number().over(W.partitionBy("shard", "_m_bucket").orderBy(*keys, *order))
    return (
        rows.withColumn("_m_rank", inside)
        .join(F.broadcast(first), ["shard", "_m_bucket"])
        .withColumn("slot", F.col("_m_first") + F.col("_m_rank") - 1)
        .drop("_m_bucket", "_m_rank", "_m_first")
    )
