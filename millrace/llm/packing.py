"""Packing by cutting-stock column generation.

Documents are tokenised whole and cut into full sequences and one remainder. Remainders
are the orders of a cutting-stock problem over classes of lengths: a linear program over
patterns (how many pieces of each class fill one sequence) is solved by a revised simplex
whose columns are priced by an unbounded-knapsack dynamic program. The patterns' numbers
are rounded down, the patterns of greatest remainder are rounded up and trimmed to what is
left, and the program is solved again for the rest until nothing is left. Pieces, ranked
inside their class, are dealt to the patterns' slots.

Only the length histogram (one count for each class) reaches the driver, and only the
patterns (a few hundred rows, bounded by the number of classes) are sent back.

Defined cases: a null text is empty and has one token, the end token; repeated rows are
packed as often as they come; an empty table gives an empty result; a document longer than
a sequence is cut at every full sequence; the strings of the file's added tokens are these tokens.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts_of, staged, texts_of


@functools.cache
def byte_bpe(path: str, pattern: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken, which gives the same ids several times faster."""
    import tiktoken

    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, pattern: str, text: str) -> np.ndarray:
    try:
        return byte_bpe(path, pattern).encode_to_numpy(text, allowed_special="all").astype("<u4")
    except BaseException as e:  # the matcher's stack ends on extreme runs; the reference implementation has none
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return np.array(t.encode(text, add_special_tokens=False).ids, "<u4")


def pieces(df: DataFrame, path: str, pattern: str, *, capacity: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, and ``_m_row``, which tells rows apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in parts_of(batches):
            out: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids = np.append(token_ids(path, pattern, t) if t else np.zeros(0, "<u4"), np.array(end_id, "<u4")).astype("<u4")
                out += [(k, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids), row) for s in range(0, len(ids), capacity)]
                row += 1
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({c: "int64" for c in names[1:]}), schema=arrow, preserve_index=False)

    names = ["_m_key", "start", "length", "ids_crc32", "doc_tokens", "_m_row"]
    kind = df.schema[key].dataType.simpleString()
    arrow = pa.schema([("_m_key", pa.int64() if kind in ("bigint", "int") else pa.string()), *((c, pa.int64()) for c in names[1:])])
    rows = df.select((F.col(key).cast("bigint") if kind in ("bigint", "int") else F.col(key).cast("string")).alias("_m_key"), F.col(text).alias("_m_text"))
    return rows.mapInArrow(work, f"_m_key {'bigint' if kind in ('bigint', 'int') else 'string'}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _m_row bigint")


def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within ``room``."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    live = np.flatnonzero(value > 1e-9)
    live = live[np.argsort(sizes[live], kind="stable")]
    w, v = sizes[live], value[live]
    fits = np.searchsorted(w, np.arange(room + 1), side="right")
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        if k := fits[r]:
            got = best[r - w[:k]] + v[:k]
            j = got.argmax()
            if got[j] > best[r] + 1e-12:
                best[r], take[r] = got[j], live[j]
    column, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if take[r] < 0:
            r -= 1
        else:
            column[take[r]] += 1
            r -= sizes[take[r]]
    return float(best[room]), column


def relaxed(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 20_000, gap: float = 0.0001, draw: float = 0.9) -> tuple[np.ndarray, list[np.ndarray]]:
    """The linear program's patterns and how many sequences of each; ``sizes`` rise.

    Revised simplex from the diagonal basis (``room // size`` pieces of one class). Besides
    patterns it has free columns that put a smaller piece into a larger one's slot, which keep
    the dual prices in the order of the sizes. The knapsack's prices are drawn towards a centre:
    at first ``size / room``, under which no pattern is worth more than one sequence, later any
    that prove a higher bound. The end is reached at a value within ``gap`` of the bound, or
    when no pattern is worth more than its sequence.
    """
    m = len(sizes)
    cols: list[np.ndarray] = [np.eye(m, dtype=np.int64)[i] * (room // sizes[i]) for i in range(m)]
    cost = np.ones(m)
    inverse = np.diag(1 / np.array([c[i] for i, c in enumerate(cols)], float))
    x = inverse.sum(axis=1) * demand
    centre, now = sizes / room, draw
    bound = float(centre @ demand)

    def enter(new: np.ndarray, price: float) -> None:
        nonlocal x
        d = np.einsum("ij,j->i", inverse, new.astype(float))  # not by BLAS, whose threads wait for the JVM's
        up = d > 1e-9
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        i = int(ratio.argmin())
        x = x - ratio[i] * d
        x[i] = ratio[i]
        x = np.maximum(x, 0)
        cols[i], cost[i] = new, price
        pivot = inverse[i] / d[i]
        np.subtract(inverse, np.outer(d, pivot), out=inverse)
        inverse[i] = pivot

    for _ in range(rounds):
        if cost @ x <= bound * (1 + gap):
            break
        true = np.einsum("i,ij->j", cost, inverse)
        fall = true - np.minimum.accumulate(true[::-1])[::-1]
        if fall.max() > 1e-6:  # a larger piece is priced below a smaller one
            small = int(fall.argmax())
            new = np.zeros(m, np.int64)
            new[small], new[small + int(true[small:].argmin())] = 1, -1
            enter(new, 0.0)
            continue
        price = np.maximum(now * centre + (1 - now) * true, 0)
        worth, new = best_pattern(price, sizes, room)
        if (proved := float(price @ demand) / max(worth, 1e-9)) > bound:
            bound, centre = proved, price / worth
        if true @ new > 1 + 1e-7:
            now = draw
            enter(new, 1.0)
        elif now:
            now = now / 2 if now > 1e-3 else 0.0
        else:
            break
    use = cost > 0
    return x[use], [c for c, u in zip(cols, use, strict=True) if u]


def filled(sizes: np.ndarray, pattern: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The pattern trimmed to what is left, its spare room filled with the largest pieces that fit."""
    c = np.minimum(pattern, left)
    space = room - int(c @ sizes)
    for j in range(len(sizes) - 1, -1, -1):
        if space >= sizes[j] and left[j] > c[j]:
            more = min(int(left[j] - c[j]), space // int(sizes[j]))
            c[j] += more
            space -= more * int(sizes[j])
    return c


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, *, share: float = 0.25) -> list[tuple[int, np.ndarray]]:
    """Patterns with whole numbers of sequences that hold exactly the demand; ``sizes`` rise.

    Each round solves the program for what is left, takes every pattern's whole number of
    sequences, and rounds up the ``share`` of the patterns whose remainders are largest. So the
    rest shrinks by about that share each round, and only its last pieces miss the program's bound.
    """
    left, plan = demand.astype(np.int64).copy(), []
    while left.any():
        live = np.flatnonzero(left)
        size, rest, taken = sizes[live], left[live].copy(), 0

        def take(n: int, pattern: np.ndarray) -> None:
            """``n`` sequences of the pattern; where a class has run out, its room goes to others."""
            nonlocal rest, taken
            while n > 0 and (c := filled(size, pattern, rest, room)).any():
                used = c > 0
                times = min(n, int((rest[used] // c[used]).min()))
                wide = np.zeros(len(sizes), np.int64)
                wide[live] = c
                plan.append((times, wide))
                rest, n, taken = rest - times * c, n - times, taken + times

        x, cols = relaxed(size, rest, room)
        whole = np.floor(x + 1e-9).astype(np.int64)
        for n, c in zip(whole, cols, strict=True):
            take(int(n), c)
        part = x - whole
        order = np.argsort(-part, kind="stable")
        for i in order[: int(share * (part > 1e-6).sum())]:
            take(1, cols[i])
        if not taken:
            take(1, cols[order[0]])
        left[live] = rest
    return plan


def first_fit(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """First fit by decreasing length, over counts of classes: equal sequences are made together."""
    left, plan, order = demand.astype(np.int64).copy(), [], np.argsort(-sizes)
    while left.sum():
        space, c = room, np.zeros(len(sizes), np.int64)
        for j in order:
            if left[j] and sizes[j] <= space:
                c[j] = min(left[j], space // sizes[j])
                space -= c[j] * sizes[j]
        used = c > 0
        n = int((left[used] // c[used]).min())
        plan.append((n, c))
        left -= n * c
    return plan


def pack(df: DataFrame, *, capacity: int = 2048, grain: int = 8, key: str = "doc_id", rank_buckets: int = 256) -> DataFrame:
    """Assign pieces (of :func:`pieces`) to sequences: adds ``sequence_id`` and ``offset``.

    A remainder's class is its length in units of ``grain``, rounded up. Ranks inside a class
    come from (class, bucket) counts, so that a length that a third of all rows share is
    numbered by ``rank_buckets`` tasks.
    """
    rows = staged(df, "pieces")
    units = capacity // grain
    rows = rows.withColumn("_m_class", F.when(F.col("length") == capacity, F.lit(0)).otherwise(F.ceil(F.col("length") / grain).cast("int")))
    rows = rows.withColumn("_m_bucket", F.pmod(F.xxhash64("_m_row", "start"), F.lit(rank_buckets)).cast("int"))
    counts = rows.groupBy("_m_class", "_m_bucket").agg(F.count("*").alias("_m_n"))
    got = staged(counts, "lengths").toPandas().sort_values(["_m_class", "_m_bucket"])  # (capacity / grain + 1) * rank_buckets rows at most
    got["_m_first"] = got.groupby("_m_class")._m_n.cumsum() - got._m_n
    demand = got[got._m_class > 0].groupby("_m_class")._m_n.sum()
    sizes = demand.index.to_numpy(np.int64)
    plan = column_generation(sizes, demand.to_numpy(np.int64), units)
    full = int(got[got._m_class == 0]._m_n.sum())
    slots, base = {int(s): [] for s in sizes}, full
    taken = dict.fromkeys(slots, 0)
    for n, c in plan:
        for j in np.flatnonzero(c):
            s = int(sizes[j])
            slots[s].append((taken[s], int(c[j]), base))
            taken[s] += n * int(c[j])
        base += n
    table = {s: np.array(v, np.int64) for s, v in slots.items()}
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("struct<sequence_id:bigint,_m_slot:bigint>")
    def deal(klass: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, slot = rank.to_numpy(np.int64).copy(), np.zeros(len(rank), np.int64)
        k = klass.to_numpy()
        for s in np.unique(k):
            if s:
                at, t = k == s, shared.value[int(s)]
                r = rank.to_numpy(np.int64)[at]
                i = np.searchsorted(t[:, 0], r, side="right") - 1
                local = r - t[i, 0]
                seq[at] = t[i, 2] + local // t[i, 1]
                slot[at] = local % t[i, 1]
        return pd.DataFrame({"sequence_id": seq, "_m_slot": slot})

    first = df.sparkSession.createDataFrame(got[["_m_class", "_m_bucket", "_m_first"]].astype("int64"), "_m_class bigint, _m_bucket bigint, _m_first bigint")
    ranked = rows.withColumn("_m_rank", F.row_number().over(W.partitionBy("_m_class", "_m_bucket").orderBy("_m_row", "start"))).join(F.broadcast(first), ["_m_class", "_m_bucket"])
    placed = ranked.withColumn("_m_at", deal("_m_class", F.col("_m_first") + F.col("_m_rank") - 1))
    placed = placed.select("_m_key", "start", "length", "ids_crc32", "doc_tokens", "_m_class", "_m_at.sequence_id", "_m_at._m_slot", "_m_row")
    before = W.partitionBy("sequence_id").orderBy(F.desc("_m_class"), "_m_slot", "_m_row").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(F.col("_m_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
