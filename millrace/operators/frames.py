"""Operators on any table: cleaning, encoding, reshaping, set operations, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with one distinct value, null counted as a value; one aggregate over all of them."""
    if not df.columns:
        return []
    row = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 1]


def drop_quantile_columns(columns: list[str], quantiles: list[str]) -> list[str]:
    return [c for c in columns if not any(c.endswith(q) for q in quantiles)]


def downcast(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"})


def null_shares(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def positional(df: DataFrame, pos: str, size: int, start: int, end: int) -> DataFrame:
    """Rows whose place inside blocks of ``size`` is in [start, end)."""
    return df.where((F.col(pos) % size >= start) & (F.col(pos) % size < end))


def skip_first(df: DataFrame, step: str, n: int, fraction: float) -> DataFrame:
    """Without the first ``int(n * fraction)`` steps; a fraction of exactly one step skips none."""
    last = int(n * fraction) - 1
    return df.where(F.col(step) > last) if last > 0 else df


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Places 0..n-1 in the order of ``order``: rows are dealt to range partitions, and each counts on from the ones before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    # a row for each partition
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    sizes = sizes.select("_p", "_first", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(sizes), "_p").withColumn(name, F.col("_before") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_before")


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Sorted distinct values to 0..n-1. The classes are a table, joined back; nulls stay null."""
    classes = df.where(F.col(column).isNotNull()).select(column).distinct()
    return df.join(numbered(classes, [column], name or f"{column}_enc"), column, "left")


def one_hot(train: DataFrame, test: DataFrame, columns: list[str], *, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Boolean columns for values found in both tables; once ``most`` columns were added no more are.

    A column with more common values than a table can have columns for is an error, not cut short.
    """
    added = 0
    for c in columns:
        if added > most:
            break
        both = [r[0] for r in train.select(c).intersect(test.select(c)).where(F.col(c).isNotNull()).limit(10_001).collect()]
        if len(both) > 10_000:
            raise ValueError(f"{c} has more than 10,000 common values")
        flags = {f"{c}_{v}": F.col(c).eqNullSafe(F.lit(v)) for v in sorted(both)}
        train, test, added = train.withColumns(flags), test.withColumns(flags), added + len(flags)
    return train.drop(*columns), test.drop(*columns)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops a fixed list of columns; a name that isn't there is an error."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.drop(*names)


def checked(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """The same rows; a value that is null, not a number or outside [lo, hi] ends the query."""
    ok = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & F.col(column).between(lo, hi)
    return df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} out of range: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast(df.schema[column].dataType)))


def having(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in another table."""
    return df.join(keys.select(*on), on, "left_semi")


def only_in_first(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).subtract(b.select(*keys))


def side_by_side(parts: list[DataFrame], key: str) -> DataFrame:
    """Columns of several tables put together by their row key; rows are those of the first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "left")
    return out


def first_value(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first value of each group that isn't null, by an explicit order."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def sorted_by(df: DataFrame, keys: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """Total order over several keys, for output only."""
    return df.orderBy(*[F.col(k).desc() if k in descending else F.col(k).asc() for k in keys])


def transposed(df: DataFrame, key: str, columns: list[str], values: list) -> DataFrame:
    """Columns become rows (``field``) and the keys' values columns; the keys' values are given."""
    long = df.select(key, *columns).unpivot([key], columns, "field", "value")
    return long.groupBy("field").pivot(key, values).agg(F.first("value"))


def lookup(df: DataFrame, table: DataFrame, key: str, columns: list[str], *, default: float = -1.0) -> DataFrame:
    """Columns of a small lookup table; a key that it lacks gets ``default``."""
    return df.join(table.select(key, *columns), key, "left").withColumns({c: F.coalesce(c, F.lit(default)) for c in columns})


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Normalised histogram."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(key, "n", (F.col("n") / F.col("_all")).alias("share"))


def matrix(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """Group by two keys, sum, unstack; the columns' values are given, so no extra job looks for them."""
    return df.groupBy(row).pivot(column, values).agg(F.sum(value)).fillna(0.0)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long correlation matrix from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("x"))
    return one.select(F.inline("x"))


def deviation_bands(df: DataFrame, key: str, value: str, *, least: int = 10, bands: tuple[float, ...] = (0.05, 0.1, 0.2)) -> DataFrame:
    """Share of keys (with ``least`` rows at least) whose deviation over maximum is under each band."""
    r = df.groupBy(key).agg(F.count("*").alias("n"), F.stddev_samp(value).alias("s"), F.max(value).alias("m")).where(F.col("n") >= least).select(F.try_divide("s", "m").alias("r"))
    return r.agg(F.count("*").alias("keys"), *[F.avg((F.col("r") < b).cast("double")).alias(f"under_{b:g}".replace(".", "_")) for b in bands])


def symmetric(df: DataFrame, a: str, b: str, flip: list[str] = ()) -> DataFrame:
    """Rows and their mirror images: ends swapped, the ``flip`` columns negated."""
    swapped = [F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else (-F.col(c)).alias(c) if c in flip else F.col(c) for c in df.columns]
    return df.unionByName(df.select(*swapped))


def standardise(df: DataFrame, columns: list[str], *, fill: float = 0.0) -> DataFrame:
    """Population mean 0 and deviation 1, nulls left out and filled after; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))), F.lit(fill)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


def hash_fold(df: DataFrame, key: str, k: int, *, seed: int = 0) -> DataFrame:
    """Deterministic fold of each key, whatever the partitions."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))
