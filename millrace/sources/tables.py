"""Scans and sinks: explicit schemas, pruned columns, partitioned output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet table; only the named columns are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: StructType | str, *, parts: int | None = None, **options) -> DataFrame:
    """CSV, gzip too. A gzip file can't be split, so ``parts`` deals its rows out after the scan."""
    df = spark.read.schema(schema).options(header=True, **options).csv(path)
    return df.repartition(parts) if parts else df


def _counted(df: DataFrame, group: list[str], order: str, name: str, first: int = 0) -> DataFrame:
    """Numbers rows from counts of the parts that ``order`` orders inside ``group``; a row for each part is broadcast."""
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    sizes = marked.groupBy(*group, order).agg(F.count("*").alias("_n"), F.min("_m").alias("_least"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy(order)) - F.col("_n")
    sizes = sizes.select(*group, order, "_least", before.alias("_before"))
    return marked.join(F.broadcast(sizes), [*group, order]).withColumn(name, F.col("_before") + F.col("_m") - F.col("_least") + first).drop("_m", "_least", "_before")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, numbered from 0 in each file."""
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    return _counted(df, ["file"], "_block", "line_no").select("file", "line_no", "value")


def numbered(df: DataFrame, name: str = "pos", first: int = 0) -> DataFrame:
    """Explicit place of each row in the order of the table's partitions, from counts of the partitions."""
    out = _counted(df.withColumns({"_p": F.spark_partition_id(), "_all": F.lit(0)}), ["_all"], "_p", name, first)
    return out.select(name, *df.columns)


def wide_signals(spark: SparkSession, path: str, signals: list[str] | None = None, t: str = "t") -> DataFrame:
    """One column per signal to long (signal_id, t, value); only the wanted columns are scanned."""
    df = spark.read.parquet(path)
    names = signals or [c for c in df.columns if c != t]
    return df.select(t, *names).unpivot([t], names, "signal_id", "value").select(F.col("signal_id").cast("int").alias("signal_id"), t, "value")


def write(df: DataFrame, path: str, *, by: list[str] | None = None, mode: str = "overwrite", kind: str = "parquet", **options) -> None:
    w = df.write.mode(mode).options(**options)
    (w.partitionBy(*by) if by else w).format(kind).save(path)


def write_csv(df: DataFrame, path: str, *, gzip: bool = True) -> None:
    write(df, path, kind="csv", header=True, **({"compression": "gzip"} if gzip else {}))


def append(df: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    """Adds a batch to a table."""
    write(df, path, by=by, mode="append")


def keyed(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """One key of a keyed store."""
    return spark.read.parquet(keyed_store(folder, key))


def keyed_store(folder: str, key: str) -> str:
    """Path of one key of a keyed store: a Parquet folder for each key."""
    return f"{folder.rstrip('/')}/{key}"
