"""Short texts: TF-IDF, vocabulary coverage, neighbours inside (month, category) and features taken from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import tokens
from .frames import label_encode


def tf_idf(df: DataFrame, *, key: str, text: str, min_df: float = 0.0, custom: bool = False, stop: tuple[str, ...] = ()) -> DataFrame:
    """Long (key, term, weight): counts times ln((1 + n) / (1 + df)) + 1, each row scaled to length 1.

    Terms are runs of two or more word characters in lower case, or the custom tokens.
    ``min_df`` below 1 is a share of the rows.
    """
    words = tokens(F.lower(F.col(text)), stop) if custom else F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\w\w+)"), 1)
    tf = df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") >= F.col("n") * min_df)
    idf = idf.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / length).alias("weight"))


def coverage(df: DataFrame, text: str, top: int = 10_000) -> DataFrame:
    """Vocabulary size, and the share of all tokens that the ``top`` most frequent terms make up."""
    c = df.select(F.explode(tokens(F.lower(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    all_ = c.agg(F.count("*").alias("terms"), F.sum("n").alias("tokens"))
    best = c.orderBy(F.desc("n"), "term").limit(top).agg(F.sum("n").alias("covered"))
    return all_.crossJoin(F.broadcast(best)).select("terms", "tokens", (F.col("covered") / F.col("tokens")).alias("coverage"))


def bucket_neighbours(weights: DataFrame, query: DataFrame, pool: DataFrame, *, key: str, buckets: list[str], k: int) -> DataFrame:
    """(buckets, key, nbr, rank, distance): nearest pool items by Euclidean distance of unit TF-IDF rows in the same bucket, itself left out.

    Distances come from shared terms (an equi join on bucket and term): d^2 = 2 - 2 dot. Pairs
    without a shared term are at sqrt(2); only rows with fewer than ``k`` others get them, from the
    bucket's least ids, which always hold enough. Rows without any term take no part.

    Terms that one row of a bucket has alone add to no distance. Rows of a bucket that agree in all
    other terms and weights are one class: classes meet pair by pair, not rows, and a class stands
    for its ``k`` + 1 least ids, of which a row may have to leave out itself.
    """
    part = query.select(*buckets, key, F.lit(True).alias("_q"), F.lit(False).alias("_p")).unionByName(pool.select(*buckets, key, F.lit(False).alias("_q"), F.lit(True).alias("_p")))
    part = part.dropna(subset=[*buckets, key]).groupBy(*buckets, key).agg(F.max("_q").alias("_q"), F.max("_p").alias("_p"))
    v = part.join(weights.select(key, "term", "weight"), key)
    often = v.groupBy(*buckets, "term").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = F.when(F.col("_n").isNotNull(), F.struct("term", "weight"))
    rows = v.join(often, [*buckets, "term"], "left").groupBy(*buckets, key, "_q", "_p").agg(F.array_sort(F.collect_list(shared)).alias("_v"))

    asked = rows.where("_q").groupBy(*buckets, "_v").agg(F.min(key).alias("_a"))
    least = rows.where("_p").select(*buckets, "_v", F.col(key).alias("nbr"))
    held = least.withColumn("_i", F.row_number().over(W.partitionBy(*buckets, "_v").orderBy("nbr"))).where(F.col("_i") <= k + 1)
    held = held.groupBy(*buckets, "_v").agg(F.min("nbr").alias("_c"), F.collect_list("nbr").alias("_ids"))
    q = asked.select(*buckets, "_a", F.inline("_v")).withColumnRenamed("weight", "w1")
    p = held.select(*buckets, "_c", F.inline("_v")).withColumnRenamed("weight", "w2")
    dots = q.join(p, [*buckets, "term"]).groupBy(*buckets, "_a", "_c").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    d = dots.select(*buckets, "_a", "_c", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("dot"))).alias("distance"))
    d = d.withColumn("_i", F.row_number().over(W.partitionBy(*buckets, "_a").orderBy("distance", "_c"))).where(F.col("_i") <= k + 1).drop("_i")
    d = d.join(held.select(*buckets, "_c", "_ids"), [*buckets, "_c"]).select(*buckets, "_a", "distance", F.explode("_ids").alias("nbr"))
    near = d.groupBy(*buckets, "_a").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "nbr"))), 1, k + 1).alias("_near"))

    least = least.withColumn("_i", F.row_number().over(W.partitionBy(*buckets).orderBy("nbr"))).where(F.col("_i") <= 2 * k + 1)
    least = least.groupBy(*buckets).agg(F.array_sort(F.collect_list("nbr")).alias("_least"))
    found = F.coalesce("_near", F.array().cast(near.schema["_near"].dataType))
    ids = F.transform(found, lambda x: x["nbr"])
    far = F.transform(F.filter("_least", lambda i: ~F.array_contains(ids, i)), lambda i: F.struct(F.sqrt(F.lit(2.0)).alias("distance"), i.alias("nbr")))
    all_ = asked.join(near, [*buckets, "_a"], "left").join(least, buckets)
    all_ = all_.select(*buckets, "_v", F.when(F.size(found) > k, found).otherwise(F.concat(found, far)).alias("_all"))
    own = rows.where("_q").select(*buckets, key, "_v").join(all_, [*buckets, "_v"])
    own = own.select(*buckets, key, F.posexplode(F.slice(F.filter("_all", lambda x: x["nbr"] != F.col(key)), 1, k)).alias("_i", "_x"))
    return own.select(*buckets, key, "_x.nbr", "_x.distance", (F.col("_i") + 1).alias("rank"))


def neighbour_weights(near: DataFrame, *, keys: list[str], far: float = 0.9) -> DataFrame:
    """Weights 1 - d / max(1, greatest d), summing to 1; all zero: null beyond ``far``, else uniform; a single neighbour weighs 1."""
    w = W.partitionBy(*keys)
    raw = 1 - F.col("distance") / F.greatest(F.lit(1.0), F.max("distance").over(w))
    out = near.withColumn("_raw", raw).withColumns({"_sum": F.sum("_raw").over(w), "_n": F.count("*").over(w)})
    flat = F.when(F.col("distance") > far, F.lit(None)).otherwise(1 / F.col("_n"))
    return out.withColumn("weight", F.when(F.col("_n") == 1, 1.0).when(F.col("_sum") > 0, F.col("_raw") / F.col("_sum")).otherwise(flat)).drop("_raw", "_sum", "_n")


def neighbour_feature(rows: DataFrame, near: DataFrame, facts: DataFrame, *, key: str, value: str, n: int, default: float = -10.0, weighted: bool = False) -> DataFrame:
    """Mean over the first ``n`` neighbours of the neighbour's value in the row's shop, else its month's mean; ``default`` without any.

    ``rows`` have (shop_id, month, key); ``facts`` the same with ``value``; ``near`` (month, key, nbr, rank[, weight]).
    """
    own = facts.select("shop_id", "month", F.col(key).alias("nbr"), F.col(value).alias("_own"))
    mean = facts.groupBy("month", F.col(key).alias("nbr")).agg(F.avg(value).alias("_mean"))
    got = rows.select("shop_id", "month", key).distinct().join(near.where(F.col("rank") <= n), ["month", key]).join(own, ["shop_id", "month", "nbr"], "left").join(mean, ["month", "nbr"], "left")
    v = F.coalesce("_own", "_mean")
    stat = F.try_divide(F.sum(v * F.col("weight")), F.sum(F.when(v.isNotNull(), F.col("weight")))) if weighted else F.avg(v)
    name = f"{n}_neighbour"
    out = got.groupBy("shop_id", "month", key).agg(stat.alias(name))
    return rows.join(out, ["shop_id", "month", key], "left").fillna(default, [name])


def neighbour_assembly(rows: DataFrame, near: DataFrame, facts: DataFrame, *, key: str, values: list[str], ns: tuple[int, ...] = (1, 2, 6), weighted: bool = False) -> DataFrame:
    """:func:`neighbour_feature` for several values and numbers of neighbours, one column for each."""
    out = rows
    for v in values:
        for n in ns:
            out = neighbour_feature(out, near, facts, key=key, value=v, n=n, weighted=weighted).withColumnRenamed(f"{n}_neighbour", f"{n}_neighbour_{v}")
    return out


def reduced(weights: DataFrame, *, key: str, k: int, prefix: str = "text") -> DataFrame:
    """TF-IDF rows reduced to ``k`` principal components: (key, prefix_0 ..). For vocabularies of some thousand terms."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    terms = label_encode(weights, "term", "_i")
    size = terms.agg(F.max("_i") + 1).first()[0] or 0
    cells = terms.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_i").cast("int"), "weight"))).alias("_w"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(int(size) - 1)), lambda i: F.coalesce(F.try_element_at("_w", i), F.lit(0.0)))
    ready = cells.select(key, array_to_vector(dense).alias("_v"))
    got = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready).transform(ready).withColumn("_p", vector_to_array("_p"))
    return got.select(key, *[F.get("_p", F.lit(i)).alias(f"{prefix}_{i}") for i in range(k)])


def text_table(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Table of reduced text columns of a dimension (item, shop or category), named after its text."""
    return reduced(tf_idf(df.select(key, text), key=key, text=text), key=key, k=k, prefix=f"{text}_text")


def bring_text(facts: DataFrame, tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """The first columns of each text table joined to the facts by its key."""
    for key, (table, n) in tables.items():
        facts = facts.join(table.select(key, *[c for c in table.columns if c != key][:n]), key, "left")
    return facts
