"""Substring de-duplication by collinear chaining of shared k-mer seeds.

Seeds are k-mers of words, picked by minimum hash in a sliding window, so that two texts
that share any run of ``k + window - 1`` words share a seed. Each seed that two documents
hold is matched to its first holder (the document of least id), so a passage in a third
of all documents gives as many matches as occurrences, not their square. Seeds that lie in
no passage found so are matched once more, to their second holder: the parts of a passage may
have been seen apart in earlier documents before one held it whole. Where seeds still lie in no
passage, all runs of ``min_words`` words around them go to their first holder of all, so a run
that any earlier document holds word for word is found however its seeds are spread. For each pair of
documents the matches are chained in order with gap costs, the best predecessor being found
in a Fenwick tree of prefix maxima; chains are aligned over the words between and beyond
their seeds, and kept as fuzzy passages when they are long and alike enough.

Defined cases: null, empty and short texts hold no passages; rows with a null key take no
part; rows that repeat a key are one document; ties go to the smaller id and the earlier
place; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHash, lower_words_of, parts_of, staged, texts_of, window_hashes
from .members import bitmap, holds


def seeds(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the minimizers: of every ``window`` neighbouring hashes the least one, the first if equal."""
    if len(h) <= window:
        return np.array([int(h.argmin())]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


class Fenwick:
    """Prefix maxima with the place that reached them."""

    def __init__(self, n: int):
        self.best, self.at = [-np.inf] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, at: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i], self.at[i] = value, at
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Best over places before ``i``."""
        value, at = -np.inf, -1
        while i > 0:
            if self.best[i] > value:
                value, at = self.best[i], self.at[i]
            i -= i & -i
        return value, at


def chains(x: np.ndarray, y: np.ndarray, k: int, *, gap: float = 0.5, max_gap: int = 60) -> list[np.ndarray]:
    """Collinear chains of matches (x in the document, y in the holder), best first, each match in one chain.

    A chain's score is the words its seeds cover less ``gap`` for each word by which the two
    sides' distances differ from contact; with the cost linear in x + y it splits into terms
    of the two ends. Of the predecessors a whole seed away on both sides the best is then a
    prefix maximum over y, kept in a Fenwick tree; where that one lies beyond ``max_gap``, those
    within it are tried one by one. Predecessors that overlap the match are looked up by place.
    """
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n, far = len(x), max_gap + k
    levels = np.unique(y)
    rank, below = np.searchsorted(levels, y).tolist(), np.searchsorted(levels, y - k, side="right").tolist()
    first = np.searchsorted(x, x - far).tolist()
    tree = Fenwick(len(levels))
    score, back = np.full(n, float(k)), np.full(n, -1)
    at_y: dict[int, list[int]] = {}
    xs, ys, ready = x.tolist(), y.tolist(), 0

    for j, (u, v) in enumerate(zip(xs, ys, strict=True)):
        while xs[ready] <= u - k:
            tree.put(rank[ready], score[ready] + gap / 2 * (xs[ready] + ys[ready]), ready)
            ready += 1
        best, at = float(k), -1
        value, i = tree.top(below[j])
        if i >= 0 and (u - xs[i] > far or v - ys[i] > far):
            near = np.arange(first[j], ready)
            near = near[(v - y[near] >= k) & (v - y[near] <= far)]
            i = -1
            if len(near):
                i = int(near[(score[near] + gap / 2 * (x[near] + y[near])).argmax()])
                value = score[i] + gap / 2 * (xs[i] + ys[i])
        if i >= 0 and (got := value + (1 + gap) * k - gap / 2 * (u + v)) > best:
            best, at = got, i
        overlapping = [i for i in range(ready, j) if 0 < v - ys[i] <= far and xs[i] < u]
        for w in range(v - k + 1, v):
            for i in reversed(at_y.get(w, ())):
                if u - xs[i] > far:
                    break
                if u - xs[i] >= k:
                    overlapping.append(i)
        for i in overlapping:
            du, dv = u - xs[i], v - ys[i]
            cover = min(k, du, dv)
            if (got := score[i] + (1 + gap) * cover - gap / 2 * (du + dv)) > best:
                best, at = got, i
        score[j], back[j] = best, at
        at_y.setdefault(v, []).append(j)
    used, out = np.zeros(n, bool), []
    for e in np.argsort(-score, kind="stable"):
        path, m = [], int(e)
        while m >= 0 and not used[m]:
            path.append(m)
            used[m] = True
            m = int(back[m])
        if path:
            at = order[np.array(path[::-1])]
            out.append(at)
    return out


def extend(a: np.ndarray, b: np.ndarray, drop: int = 8) -> int:
    """Words by which an alignment goes on along one diagonal: best prefix at +1 a match, -1 a mismatch, ended ``drop`` below the best."""
    n = min(len(a), len(b))
    if not n:
        return 0
    run = np.cumsum(np.where(a[:n] == b[:n], 1, -1))
    top = np.maximum.accumulate(np.maximum(run, 0))
    off = np.flatnonzero(top - run > drop)
    run = run[: off[0]] if len(off) else run
    return int(run.argmax()) + 1 if len(run) and run.max() > 0 else 0


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of two short runs (between neighbouring seeds of a chain)."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == w)))
    return int(row[-1])


def open_starts(p: np.ndarray, shared: np.ndarray, free: np.ndarray, k: int, window: int, words: int) -> list[tuple[int, int]]:
    """Ranges [lo, hi] of starts of runs of ``words`` words that another document may hold and that a ``free`` seed lies amid.

    ``p`` are a document's seed places. Seeds ``window`` - 1 places inside a run's ends are chosen by
    the run alone, so in a repeated run all of them are shared.
    """
    first, last = window - 1, words - k - (window - 1)
    if last < first:  # runs too short for that: all around free seeds
        first, last, shared = 0, max(0, words - k), np.ones(len(p), bool)
    edges = p[~shared]
    out: list[tuple[int, int]] = []
    for w in p[free].tolist():
        i = int(np.searchsorted(edges, w))
        lo, hi = w - last, w - first
        if i:
            lo = max(lo, int(edges[i - 1]) - first + 1)
        if i < len(edges):
            hi = min(hi, int(edges[i]) - last - 1)
        lo = max(lo, 0)
        if lo > hi:
            continue
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _kind(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("doc"), F.col("_m_text")).where("doc is not null")


def repeated_passages(df: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 6, window: int = 12, min_words: int = 50, min_alike: float = 0.8, reach: int = 200) -> DataFrame:
    """Spans (key, start_word, end_word, first_id, first_start, first_end, alike) of later documents that repeat an earlier one's passage.

    Places count words from 0, the end excluded; ``alike`` is the share of aligned words.
    """
    docs = df.select(key, F.col(text).alias("_m_text"))
    docs = _kind(docs, key)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in parts_of(batches):
            hs, ps = [], []
            for t in texts_of(b.column(1)):
                h = words.array(lower_words_of(t))
                h = window_hashes(h, k) if len(h) >= k else np.zeros(0, np.uint64)
                p = seeds(h, window)
                hs.append(h[p].view(np.int64))
                ps.append(p.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hs, pa.list_(pa.int64())), pa.array(ps, pa.list_(pa.int32()))], ["doc", "h", "p"])

    held = staged(docs.mapInArrow(pick, "doc bigint, h array<bigint>, p array<int>"), "seeds")
    spread = held.select("doc", F.explode(F.arrays_zip("h", "p")).alias("s")).select("doc", F.col("s.h").alias("h"), F.col("s.p").alias("p"))
    first = spread.groupBy("h").agg(F.min(F.struct("doc", "p")).alias("first"), F.max("doc").alias("last"))
    first = staged(first.where("last > first.doc").select("h", F.col("first.doc").alias("lead"), F.col("first.p").alias("y")), "shared")
    wanted = df.sparkSession.sparkContext.broadcast(bitmap(first, "h"))

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            h, p = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            hit = holds(wanted.value, h)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), lengths)[hit]), pa.array(h[hit]), pa.array(p[hit])], ["doc", "h", "x"])

    matches = held.mapInArrow(shared_only, "doc bigint, h bigint, x int").join(first, "h").where("doc <> lead").select("doc", "lead", "x", "y", "h")
    matches = staged(matches, "matches")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[np.ndarray]:
            held: list[np.ndarray] = []
            for b in batches:
                m = np.column_stack([c.to_numpy() for c in b.columns]).astype(np.int64)
                if not len(m):
                    continue
                cuts = np.flatnonzero((np.diff(m[:, :2], axis=0) != 0).any(axis=1)) + 1
                parts = np.split(m, cuts)
                if held and (held[-1][-1, :2] == parts[0][0, :2]).all():
                    held.append(parts.pop(0))
                elif held:
                    yield np.concatenate(held)
                    held = []
                if parts:
                    if held:
                        yield np.concatenate(held)
                    yield from parts[:-1]
                    held = [parts[-1]]
            if held:
                yield np.concatenate(held)

        out: list[tuple] = []
        for g in groups():
            if len(g) < 2 or g[-1, 2] - g[0, 2] + k < min_words - 2 * (window + k):
                continue
            for c in chains(g[:, 2], g[:, 3], k):
                x, y = g[c, 2], g[c, 3]
                if len(c) > 1 and x[-1] - x[0] + k >= min_words - 2 * (window + k):
                    out.append((int(g[0, 0]), int(g[0, 1]), x.tolist(), y.tolist()))
            if len(out) >= 4096:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc", "lead", "x", "y"])

    def hashed(needed):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = WordHash()
            for b in parts_of(batches):
                d = b.column(0).to_numpy()
                hit = np.flatnonzero(holds(needed.value, d)) if len(d) else []
                texts = b.column(1)
                arrays = [(words.array(lower_words_of(texts[int(i)].as_py())) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(d[hit] if len(d) else d), pa.array(arrays, pa.binary())], ["doc", "w"])

        return work

    def around(places: str, begin: str) -> Column:
        """The four-byte words of ``w`` from ``begin`` to ``reach`` words beyond the last seed, cut before rows go to Python."""
        upto = F.element_at(places, -1) + k + reach
        return F.substring("w", (4 * F.col(begin) + 1).cast("int"), (4 * (upto - F.col(begin))).cast("int"))

    def begun(places: str) -> Column:
        return F.greatest(F.lit(0), F.element_at(places, 1) - reach)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 256):  # a row holds the words around a chain on both sides
            out = []
            for doc, lead, x, y, bx, wx, by, wy in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, o = np.frombuffer(wx, np.uint32), np.frombuffer(wy, np.uint32)
                x, y = np.array(x) - bx, np.array(y) - by
                back = extend(a[: x[0]][::-1], o[: y[0]][::-1])
                on = extend(a[x[-1] + k :], o[y[-1] + k :])
                same = k
                for i in range(1, len(x)):
                    dx, dy = int(x[i] - x[i - 1]), int(y[i] - y[i - 1])
                    same += min(dx, dy) if dx == dy and min(dx, dy) <= k else common_words(a[x[i - 1] + k : x[i]], o[y[i - 1] + k : y[i]]) + min(k, dx, dy)
                same += int((a[x[0] - back : x[0]] == o[y[0] - back : y[0]]).sum()) + int((a[x[-1] + k : x[-1] + k + on] == o[y[-1] + k : y[-1] + k + on]).sum())
                sx, ex, sy, ey = int(x[0]) - back, int(x[-1]) + k + on, int(y[0]) - back, int(y[-1]) + k + on
                alike = same / max(ex - sx, ey - sy)
                if ex - sx >= min_words and alike >= min_alike:
                    out.append((doc, sx + bx, ex + bx, lead, sy + by, ey + by, min(1.0, float(alike))))
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc", "start_word", "end_word", "first_id", "first_start", "first_end", "alike"])

    def passages(matches: DataFrame) -> DataFrame:
        by_doc = matches.select("doc", "lead", "x", "y").repartition("doc").sortWithinPartitions("doc", "lead", "x")
        found = staged(by_doc.mapInArrow(chain, "doc bigint, lead bigint, x array<bigint>, y array<bigint>"), "chains")
        needed = df.sparkSession.sparkContext.broadcast(bitmap(found.select(F.explode(F.array("doc", "lead")).alias("d")), "d"))
        texts = staged(docs.mapInArrow(hashed(needed), "doc bigint, w binary").groupBy("doc").agg(F.first("w").alias("w")), "texts")
        left = found.join(texts, "doc").withColumn("bx", begun("x")).select("doc", "lead", "x", "y", "bx", around("x", "bx").alias("wx"))
        both = left.join(texts.select(F.col("doc").alias("lead"), "w"), "lead").withColumn("by", begun("y")).select("doc", "lead", "x", "y", "bx", "wx", "by", around("y", "by").alias("wy"))
        return staged(both.mapInArrow(align, "doc bigint, start_word bigint, end_word bigint, first_id bigint, first_start bigint, first_end bigint, alike double"), "passages")

    spans = passages(matches)
    covered = spans.groupBy("doc").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    outside = F.col("spans").isNull() | ~F.exists("spans", lambda s: (s["start_word"] <= F.col("x")) & (F.col("x") < s["end_word"]))
    second = matches.groupBy("h").agg(F.min(F.struct("doc", "x")).alias("second"), F.max("doc").alias("last")).where("last > second.doc")
    second = staged(second.select("h", "second"), "second")  # written, so that both sides of the join are exchanges that can be split
    rest = matches.join(covered, "doc", "left").where(outside).select("doc", "x", "h").join(second, "h").where("doc > second.doc")
    more = passages(rest.select("doc", F.col("second.doc").alias("lead"), "x", F.col("second.x").alias("y")))
    spans = spans.unionByName(more)
    covered = spans.groupBy("doc").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    rest = staged(matches.join(covered, "doc", "left").where(outside).select("h").distinct(), "rest")
    open_ = df.sparkSession.sparkContext.broadcast(bitmap(rest, "h"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            cuts, h, p = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))]), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy().astype(np.int64)
            both, free = holds(wanted.value, h), holds(open_.value, h)
            for i in np.unique(np.searchsorted(cuts, np.flatnonzero(free & both), "right") - 1):
                at = slice(cuts[i], cuts[i + 1])
                found = open_starts(p[at], both[at], free[at] & both[at], k, window, min_words)
                if found:
                    rows.append((b.column(0)[int(i)].as_py(), *map(list, zip(*found, strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["doc", "lo", "hi"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 64):
            d, hs, xs = [], [], []
            for doc, w, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = np.frombuffer(w, np.uint32).astype(np.uint64)
                for s, e in zip(lo, hi, strict=True):
                    part = words[max(0, s) : e + min_words]
                    if len(part) >= min_words:
                        hs.append(window_hashes(part, min_words).view(np.int64))
                        xs.append(np.arange(len(hs[-1])) + max(0, s))
                        d.append(np.full(len(hs[-1]), doc))
            whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (hs, d, xs)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in whole], ["r", "doc", "x"])

    # what parts seen apart hide from both rounds: runs of ``min_words`` words, each with its first holder of all
    near = staged(held.mapInArrow(ranges, "doc bigint, lo array<bigint>, hi array<bigint>").groupBy("doc").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi")), "ranges")
    needed = df.sparkSession.sparkContext.broadcast(bitmap(near, "doc"))
    texts = docs.mapInArrow(hashed(needed), "doc bigint, w binary").groupBy("doc").agg(F.first("w").alias("w"))
    every = staged(texts.join(near, "doc").select("doc", "w", "lo", "hi").mapInArrow(runs, "r bigint, doc bigint, x bigint"), "runs")
    holder = every.groupBy("r").agg(F.min(F.struct("doc", "x")).alias("first"), F.max("doc").alias("last")).where("last > first.doc").select("r", "first")
    uncut = F.col("spans").isNull() | ~F.exists("spans", lambda s: (s["start_word"] <= F.col("x")) & (F.col("x") + min_words <= s["end_word"]))
    again = every.join(holder, "r").where("doc > first.doc").select("doc", F.col("first.doc").alias("lead"), "x", F.col("first.x").alias("y")).join(covered, "doc", "left").where(uncut)
    # neighbouring runs of one holder on one diagonal are one span
    step = again.withColumn("g", F.col("x") - F.row_number().over(W.partitionBy("doc", "lead", F.col("y") - F.col("x")).orderBy("x")))
    exact = step.groupBy("doc", "lead", (F.col("y") - F.col("x")).alias("off"), "g").agg(F.min("x").alias("lo"), (F.max("x") + min_words).alias("hi"))
    exact = exact.select("doc", F.col("lo").alias("start_word"), F.col("hi").alias("end_word"), F.col("lead").alias("first_id"), (F.col("lo") + F.col("off")).alias("first_start"), (F.col("hi") + F.col("off")).alias("first_end"), F.lit(1.0).alias("alike"))
    return spans.unionByName(staged(exact, "exact")).withColumnRenamed("doc", key)


def cut_passages(df: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with the words of their spans cut out of ``text``, blanks between the kept words as they were.

    A document's spans are few (it is one document's), so they are gathered by key. A hot
    document doesn't exist: the key is its id.
    """
    import re

    gathered = spans.groupBy(F.col(key).alias("_m_doc")).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("_m_spans"))
    joined = df.join(gathered, F.col(key) == F.col("_m_doc"), "left").drop("_m_doc")
    word = re.compile(r"[^\x20\x09-\x0D]+")

    @F.pandas_udf("string")
    def cut(texts, lists):
        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            places = [m.span() for m in word.finditer(t)]
            out, at, upto = [], 0, 0
            for r in s:
                lo, hi = max(r["start_word"], upto), min(r["end_word"], len(places))
                if lo < hi:
                    out.append(t[at : places[lo][0]])
                    at = places[hi][0] if hi < len(places) else len(t)
                    upto = hi
            return "".join([*out, t[at:]])

        import pandas as pd

        return pd.Series([one(t, s) for t, s in zip(texts, lists, strict=True)], dtype=object)

    touched = F.when(F.col("_m_spans").isNotNull(), cut(F.col(text), "_m_spans")).otherwise(F.col(text))
    return joined.withColumn(text, touched).drop("_m_spans")
