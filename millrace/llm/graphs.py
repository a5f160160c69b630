"""Connected components of a link table, by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (a, b): comp is the smallest node reachable.

    Large-star then small-star until nothing changes. Minima are summed map-side; a node with
    very many neighbours is a skewed join that adaptive execution splits. Every round is
    written to the shared folder, so lineage stays short.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        pairs = edges.join(low, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        edges = staged(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        now = _print(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots).distinct()
