"""Ordered signals: rows (signal_id, t, value). Windows are cut by place, never by file order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUARTERS = ((0, 4), (0, 1), (1, 2), (2, 3), (3, 4))


def tumbling(df: DataFrame, size: int, *, key: str | None = None, pos: str = "t") -> DataFrame:
    """Adds ``chunk`` = place div size; the last, partial chunk goes."""
    keys = [key] if key else []
    whole = df.groupBy(*keys).agg(F.floor((F.max(pos) + 1) / size).alias("_whole"))
    out = df.withColumn("chunk", F.floor(F.col(pos) / size))
    out = out.join(whole, keys) if keys else out.crossJoin(F.broadcast(whole))
    return out.where(F.col("chunk") < F.col("_whole")).drop("_whole")


def chunk_profile(df: DataFrame, size: int, *, keys: tuple[str, ...] = ("chunk",), pos: str = "t", value: str = "value", label: str | None = None) -> DataFrame:
    """Mean, deviation, 5/50/95 % quantiles, greatest and least of a chunk and its quarters: 35 columns, one aggregate."""
    cuts = [0, size // 4, size // 2, 3 * size // 4, size]
    place = F.pmod(F.col(pos), F.lit(size))
    aggs: list[Column] = []
    for lo, hi in QUARTERS:
        v = F.col(value) if (lo, hi) == (0, 4) else F.when((place >= cuts[lo]) & (place < cuts[hi]), F.col(value))
        name = f"{25 * lo}_{25 * hi}"
        aggs += [F.avg(v).alias(f"mean_{name}"), F.stddev_samp(v).alias(f"std_{name}"), F.max(v).alias(f"max_{name}"), F.min(v).alias(f"min_{name}")]
        aggs += [F.percentile(v, F.lit(q)).alias(f"q{int(100 * q):02d}_{name}") for q in (0.05, 0.5, 0.95)]
    if label:
        aggs.append(F.max_by(label, pos).alias(label))
    return df.groupBy(*keys).agg(*aggs)


def describe(value: Column, prefix: str = "") -> list[Column]:
    """Five quantiles, mean of absolutes, mean and deviation as aggregate columns."""
    q = [F.percentile(value, F.lit(p)).alias(f"{prefix}q{int(100 * p)}") for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    return [*q, F.avg(F.abs(value)).alias(f"{prefix}abs_mean"), F.avg(value).alias(f"{prefix}mean"), F.stddev_samp(value).alias(f"{prefix}std")]


def smooth(df: DataFrame, width: int, *, key: str = "signal_id") -> DataFrame:
    """Trailing mean over up to ``width`` rows, and the residual."""
    mean = F.avg("value").over(W.partitionBy(key).orderBy("t").rowsBetween(-(width - 1), 0))
    return df.withColumn("smooth", mean).withColumn("residual", F.col("value") - F.col("smooth"))


def scale_difference(df: DataFrame, k: int, *, keys: tuple[str, ...] = ("signal_id", "chunk"), pos: str = "t") -> DataFrame:
    """Absolute differences of every k-th value, from the first on, of the k-row trailing mean (null until k rows), in each chunk."""
    w = W.partitionBy(*keys).orderBy(pos)
    span = w.rowsBetween(-(k - 1), 0)
    mean = F.when(F.count("value").over(span) == k, F.avg("value").over(span))
    kept = df.withColumns({"_mean": mean, "_at": F.row_number().over(w) - 1}).where(F.col("_at") % k == 0)
    return kept.withColumn("diff", F.abs(F.col("_mean") - F.lag("_mean").over(w))).drop("_mean", "_at")


def _next_higher(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest higher values to the left (-1: none) and to the right (n: none), with a falling stack."""
    n = len(x)
    left, right = np.full(n, -1), np.full(n, n)
    stack: list[int] = []
    for i, v in enumerate(x.tolist()):
        while stack and x[stack[-1]] < v:
            right[stack.pop()] = i
        # equal values stay on the stack: the nearest higher one is below all of them
        left[i] = stack[-1] if stack and x[stack[-1]] > v else left[stack[-1]] if stack else -1
        stack.append(i)
    return left, right


def find_peaks(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of local maxima (middle of a plateau) that rise ``threshold`` above both neighbours; prominence; width at half of it."""
    n = len(x)
    if n < 3:
        return np.zeros(0, int), np.zeros(0), np.zeros(0)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
    ends = np.concatenate([starts[1:], [n]]) - 1
    level = x[starts]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    at = (starts[inner] + ends[inner]) // 2
    rise = np.minimum(x[at] - x[at - 1], x[at] - x[at + 1])
    at = at[rise >= threshold]
    prominence, width = np.zeros(len(at)), np.zeros(len(at))
    left_of, right_of = _next_higher(x)
    for i, p in enumerate(at):
        lo, hi = left_of[p] + 1, right_of[p]
        prominence[i] = x[p] - max(x[lo : p + 1].min(), x[p:hi].min())
        half = x[p] - prominence[i] / 2
        a = p
        while a > lo and x[a] > half:
            a -= 1
        left = a + (half - x[a]) / (x[a + 1] - x[a]) if x[a] < half else float(a)
        b = p
        while b < hi - 1 and x[b] > half:
            b += 1
        right = b - (half - x[b]) / (x[b - 1] - x[b]) if x[b] < half else float(b)
        width[i] = right - left
    return at, prominence, width


def peaks(df: DataFrame, threshold: float, *, keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """(keys, t, width, height, sign) of peaks and troughs. Prominence needs a scan, so this is a grouped map over one signal."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, t = pdf["value"].to_numpy(float), pdf["t"].to_numpy()
        parts = []
        for sign in (1, -1):
            at, height, width = find_peaks(sign * x, threshold)
            parts.append(pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "t": t[at], "width": width, "height": height, "sign": sign}))
        return pd.concat(parts).sort_values("t")

    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [f"t {df.schema['t'].dataType.simpleString()}, width double, height double, sign int"])
    return df.select(*keys, "t", "value").groupBy(*keys).applyInPandas(one, schema)


def corona_pairs(found: DataFrame, *, distance: int, ratio: float, key: str = "signal_id") -> DataFrame:
    """Neighbouring opposite peaks less than ``distance`` apart whose smaller prominence is over ``ratio`` of the larger."""
    w = W.partitionBy(key).orderBy("t")
    nxt = found.withColumns({"end": F.lead("t").over(w), "_s": F.lead("sign").over(w), "_h": F.lead("height").over(w)})
    alike = F.try_divide(F.least("height", "_h"), F.greatest("height", "_h")) > ratio
    return nxt.where((F.col("_s") == -F.col("sign")) & (F.col("end") - F.col("t") < distance) & alike).select(key, F.col("t").alias("start"), "end")


def remove_corona(df: DataFrame, *, threshold: float, distance: int, ratio: float, cleanup: int, key: str = "signal_id") -> DataFrame:
    """Each corona pair is replaced by a ramp; later pairs see what earlier ones changed, so one signal is one group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        x = pdf["value"].to_numpy(float).copy()
        up, down = find_peaks(x, threshold), find_peaks(-x, threshold)
        at = np.concatenate([up[0], down[0]])
        height = np.concatenate([up[1], down[1]])
        sign = np.concatenate([np.ones(len(up[0])), -np.ones(len(down[0]))])
        order = np.argsort(at, kind="stable")
        at, height, sign = at[order], height[order], sign[order]
        for i in range(len(at) - 1):
            small, large = sorted((height[i], height[i + 1]))
            if sign[i] != sign[i + 1] and at[i + 1] - at[i] < distance and large > 0 and small / large > ratio:
                a, b = max(at[i] - 1, 0), min(at[i + 1] + cleanup, len(x) - 1)
                x[a:b] = np.linspace(x[a], x[b], b - a)
        pdf["value"] = x
        return pdf

    return df.groupBy(key).applyInPandas(one, df.schema)


def peak_stats(df: DataFrame, found: DataFrame, *, keys: tuple[str, ...] = ("signal_id",), widest: float = 100.0) -> DataFrame:
    """Five quantiles of widths (clipped), prominences and gaps, and the count; no peaks: 0, one peak: the gap is the length."""
    keys = list(keys)
    length = df.groupBy(*keys).agg(F.count("*").alias("_len"))
    gaps = found.withColumn("_gap", F.col("t") - F.lag("t").over(W.partitionBy(*keys).orderBy("t")))
    qs = (0.0, 0.25, 0.5, 0.75, 1.0)
    q = lambda c, n: [F.percentile(c, F.lit(p)).alias(f"{n}_q{int(100 * p)}") for p in qs]
    stats = gaps.groupBy(*keys).agg(F.count("*").alias("n_peaks"), *q(F.least(F.col("width"), F.lit(widest)), "width"), *q(F.col("height"), "height"), *q(F.col("_gap").cast("double"), "gap"))
    out = length.join(stats, keys, "left")
    filled = {"n_peaks": F.coalesce("n_peaks", F.lit(0))}
    for p in qs:
        tail = f"q{int(100 * p)}"
        filled |= {f"{n}_{tail}": F.coalesce(f"{n}_{tail}", F.lit(0.0)) for n in ("width", "height")}
        filled[f"gap_{tail}"] = F.when(F.col("n_peaks") == 1, F.col("_len").cast("double")).otherwise(F.coalesce(f"gap_{tail}", F.lit(0.0)))
    return out.withColumns(filled).drop("_len")


def chunk_transform(df: DataFrame, size: int, *, threshold: float = 8.0, key: str = "signal_id") -> DataFrame:
    """72 features of each (signal, step): description, peak statistics, six scales of differences."""
    chunks = df.withColumn("chunk", F.floor(F.col("t") / size))
    keys = (key, "chunk")
    out = chunks.groupBy(*keys).agg(*describe(F.col("value"))).join(peak_stats(chunks, peaks(chunks, threshold, keys=keys), keys=keys), list(keys))
    for k in (1, 2, 4, 8, 16, 32):
        out = out.join(scale_difference(chunks, k, keys=keys).groupBy(*keys).agg(*describe(F.col("diff"), f"d{k}_")), list(keys))
    return out


def sliding_steps(df: DataFrame, length: int, features: list[str], *, order: str, label: str | None = None, keys: tuple[str, ...] = (), block: int = 100_000) -> DataFrame:
    """Arrays of the last ``length`` steps for each step that has as many; the label is the last step's.

    Without keys the steps are dealt to blocks of ``block`` places (``order`` is a place), each with the
    ``length`` - 1 steps before it, so that no task holds all of them.
    """
    if keys:
        w, out = W.partitionBy(*keys), df
    else:
        own = F.floor(F.col(order) / block)
        both = F.when(F.col(order) % block > block - length, F.array(own, own + 1)).otherwise(F.array(own))
        out = df.withColumn("_block", F.explode(both))
        w = W.partitionBy("_block")
    out = out.withColumn("steps", F.collect_list(F.array(*features)).over(w.orderBy(order).rowsBetween(-(length - 1), 0))).where(F.size("steps") == length)
    if not keys:
        out = out.where(F.col("_block") == F.floor(F.col(order) / block))
    return out.select(*keys, order, "steps", *([label] if label else []))


def tail_split(df: DataFrame, *, chunk: str, segment: int, fraction: float) -> DataFrame:
    """Adds ``part``: the last ``int(fraction * segments)`` whole segments, and a partial one after them, validate."""
    n = df.agg((F.floor((F.max(chunk) + 1) / segment)).alias("_n"))
    cut = (F.col("_n") - F.floor(F.col("_n") * fraction)) * segment
    return df.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col(chunk) >= cut, "val").otherwise("train")).drop("_n")


def padded_segments(df: DataFrame, *, chunk: str, segment: int, pad: int) -> DataFrame:
    """Adds ``segment_id``; the last ``pad`` chunks of a segment also belong to the next one."""
    own = F.floor(F.col(chunk) / segment)
    last = df.agg(F.floor(F.max(chunk) / segment).alias("_last"))
    both = F.when((F.col(chunk) % segment >= segment - pad) & (own < F.col("_last")), F.array(own, own + 1)).otherwise(F.array(own))
    return df.crossJoin(F.broadcast(last)).withColumn("segment_id", F.explode(both)).drop("_last")


def max_abs_scale(train: DataFrame, df: DataFrame, columns: list[str], *, of_max: bool = False) -> DataFrame:
    """Columns divided by the training part's greatest absolute (``of_max``: the absolute of the greatest), 1 where that is 0."""
    scale = train.agg(*[(F.abs(F.max(c)) if of_max else F.max(F.abs(F.col(c)))).alias(f"_s_{c}") for c in columns])
    by = {c: F.col(c) / F.coalesce(F.nullif(F.col(f"_s_{c}").cast("double"), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return df.crossJoin(F.broadcast(scale)).withColumns(by).select(*df.columns)


def phase_lead(df: DataFrame, k: int, *, group: str, order: str, value: str) -> DataFrame:
    """Value ``k`` phases on, around the group's cycle."""
    w = W.partitionBy(group).orderBy(order)
    all_ = F.collect_list(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn(f"{value}_lead{k}", F.get(all_, F.pmod(F.row_number().over(w) - 1 + k, F.size(all_))))


def rolled(df: DataFrame, shifts: list[int], *, key: str, pos: str, flip: bool = False) -> DataFrame:
    """Augmentation: a copy of each series for each circular shift, reversed ones too with ``flip``."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    out = df.join(n, key).crossJoin(df.sparkSession.createDataFrame([(s, f) for s in shifts for f in ((False, True) if flip else (False,))], "shift int, flipped boolean"))
    moved = F.pmod(F.col(pos) + F.col("shift"), F.col("_n"))
    return out.withColumn(pos, F.when(F.col("flipped"), F.col("_n") - 1 - moved).otherwise(moved)).drop("_n")


def outlier_votes(df: DataFrame, *, key: str = "signal_id", feature: str = "feature", z: float = 5.0, share: float = 0.3, votes: int = 3) -> DataFrame:
    """Signals that at least ``votes`` of six statistics (over steps) call outliers: more than ``int(share * features)`` features with a z-score over ``z``."""
    v = F.col("value")
    stats = df.groupBy(key, feature).agg(F.avg(v).alias("mean"), F.avg(F.abs(v)).alias("abs_mean"), F.stddev_samp(v).alias("std"), *[F.percentile(v, F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.5, 0.1, 0.9)])
    names = ["mean", "abs_mean", "std", "q50", "q10", "q90"]
    across = stats.groupBy(feature).agg(*[f(n).alias(f"_{p}_{n}") for n in names for f, p in ((F.avg, "a"), (F.stddev_pop, "s"))])
    wide = stats.join(F.broadcast(across), feature)
    far = [F.sum((F.abs(F.try_divide(F.col(n) - F.col(f"_a_{n}"), F.nullif(F.col(f"_s_{n}"), F.lit(0.0)))) > z).cast("int")).alias(n) for n in names]
    per = wide.groupBy(key).agg(F.count("*").alias("_n"), *far)
    cast = sum(((F.coalesce(F.col(n), F.lit(0)) > F.floor(F.col("_n") * share)).cast("int") for n in names), F.lit(0))
    return per.select(key, cast.alias("votes"), (cast >= votes).alias("is_outlier"))


def consensus(df: DataFrame, *, group: str, prediction: str, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("agreed", (F.avg(prediction).over(W.partitionBy(group)) >= threshold).cast("int"))


def whole_pipeline(df: DataFrame, steps: int, length: int, *, threshold: float, distance: int, ratio: float, cleanup: int, width: int) -> DataFrame:
    """Corona pairs out, smoothed signal out, then the chunk features of ``length // steps`` rows; a rest of the length is one more chunk."""
    clean = remove_corona(df, threshold=threshold, distance=distance, ratio=ratio, cleanup=cleanup)
    noise = smooth(clean, width).select("signal_id", "t", F.col("residual").alias("value"))
    return chunk_transform(noise, length // steps, threshold=threshold)


def outlier_grid(df: DataFrame, target: DataFrame, thresholds: list[float], shares: list[float], *, key: str = "signal_id", feature: str = "feature", votes: int = 3) -> DataFrame:
    """(z, share, percent): percent of target 1 among the outliers for each pair of parameters, 0 without any.

    Statistics and z-scores are computed once; the grid is exploded over one row for each key.
    """
    v = F.col("value")
    names = ["mean", "abs_mean", "std", "q50", "q10", "q90"]
    stats = df.groupBy(key, feature).agg(F.avg(v).alias("mean"), F.avg(F.abs(v)).alias("abs_mean"), F.stddev_samp(v).alias("std"), *[F.percentile(v, F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.5, 0.1, 0.9)])
    across = stats.groupBy(feature).agg(*[f(n).alias(f"_{p}_{n}") for n in names for f, p in ((F.avg, "a"), (F.stddev_pop, "s"))])
    far = {n: F.abs(F.try_divide(F.col(n) - F.col(f"_a_{n}"), F.nullif(F.col(f"_s_{n}"), F.lit(0.0)))) for n in names}
    wide = stats.join(F.broadcast(across), feature).select(key, *[c.alias(n) for n, c in far.items()], F.explode(F.array(*[F.lit(float(z)) for z in thresholds])).alias("z"))
    per = wide.groupBy(key, "z").agg(F.count("*").alias("_n"), *[F.count_if(F.col(n) > F.col("z")).alias(n) for n in names])
    per = per.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    cast = sum(((F.col(n) > F.floor(F.col("_n") * F.col("share"))).cast("int") for n in names), F.lit(0))
    out = per.withColumn("_out", cast >= votes).join(target, key)
    return out.groupBy("z", "share").agg(F.coalesce(F.round(100 * F.avg(F.when(F.col("_out"), F.col("target").cast("double"))), 2), F.lit(0.0)).alias("percent"))


def whole_groups(df: DataFrame, group: str, batches: int) -> DataFrame:
    """Adds ``batch``, by hash of the group, so that no measurement is split between batches."""
    return df.withColumn("batch", F.pmod(F.xxhash64(group), F.lit(batches)).cast("int"))
