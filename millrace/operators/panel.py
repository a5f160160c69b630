"""Demand panel: item x shop x month facts. All functions map DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import month_start, order_statistic, require_columns

KEYS = ["shop_id", "item_id", "month"]
NONE = -10.0


def clean_sales(df: DataFrame, *, max_count: float = 300) -> DataFrame:
    """Negative prices become 0; counts are held in [0, max_count]."""
    return df.withColumns({"price": F.greatest(F.col("price"), F.lit(0.0)), "cnt": F.greatest(F.lit(0.0), F.least(F.lit(float(max_count)), F.col("cnt")))})


def monthly_rollup(df: DataFrame) -> DataFrame:
    require_columns(df, *KEYS, "price", "cnt", "row_id")
    return df.groupBy(*KEYS).agg(F.avg("price").alias("price"), F.sum("cnt").alias("cnt"), F.max("row_id").alias("row_id"))


def bucket_rollup(df: DataFrame, days: int, *, day: str = "day") -> DataFrame:
    """Sums over buckets of ``days`` days."""
    return df.groupBy("shop_id", "item_id", (F.floor(F.col(day) / days) + 1).alias("bucket")).agg(F.sum("cnt").alias("cnt"), F.avg("price").alias("price"))


def densify(monthly: DataFrame, *, base_year: int = 2013) -> DataFrame:
    """Each month's active items x active shops; missing pairs get count 0 and the item's monthly median price.

    The pairs come from an equi join on the month. New ids follow the greatest old one, by
    (month, shop, item), numbered inside each month from the months' counts.
    """
    items = monthly.select("month", "item_id").distinct()
    shops = monthly.select("month", "shop_id").distinct()
    price = monthly.groupBy("month", "item_id").agg(F.percentile("price", F.lit(0.5)).alias("price"))
    new = items.join(shops, "month").join(monthly.select(*KEYS), KEYS, "left_anti").join(price, ["month", "item_id"])
    sizes = new.groupBy("month").agg(F.count("*").alias("n"))
    first = sizes.select("month", (F.sum("n").over(W.orderBy("month")) - F.col("n")).alias("first"))  # a row for each month
    top = monthly.agg(F.coalesce(F.max("row_id"), F.lit(-1)).alias("top"))
    rank = F.row_number().over(W.partitionBy("month").orderBy("shop_id", "item_id"))
    new = new.withColumn("rank", rank).join(F.broadcast(first), "month").crossJoin(F.broadcast(top))
    new = new.select(*KEYS, "price", F.lit(0.0).alias("cnt"), (F.col("top") + F.col("first") + F.col("rank")).alias("row_id"), F.lit(True).alias("is_new"), month_start(F.col("month"), base_year).alias("date"))
    return monthly.select(*KEYS, "price", "cnt", "row_id", F.lit(False).alias("is_new"), month_start(F.col("month"), base_year).alias("date")).unionByName(new)


def sampled_fill(dense: DataFrame, *, zero_share: float, seed: int = 0) -> DataFrame:
    """Of each month's new zero rows as many as give ``zero_share`` of the month's rows, in hash order (repeatable)."""
    real = dense.where("not is_new").groupBy("month").agg(F.count("*").alias("n"))
    pick = F.row_number().over(W.partitionBy("month").orderBy(F.xxhash64(F.lit(seed), *KEYS), *KEYS))
    some = dense.where("is_new").withColumn("k", pick).join(F.broadcast(real), "month").where(F.col("k") <= F.floor(F.col("n") * zero_share / (1 - zero_share)))
    return dense.where("not is_new").unionByName(some.select(*dense.columns))


def trailing_stats(monthly: DataFrame, months: int, quantiles: tuple[float, ...] = (), *, value: str = "cnt") -> DataFrame:
    """Sum, least, greatest and order statistics over the ``months`` months before each row; 0 where there is none."""
    w = W.partitionBy("shop_id", "item_id").orderBy("month").rangeBetween(-months, -1)
    name = f"{value}_{months}m"
    zero = F.lit(0.0)
    out = {f"{name}_sum": F.coalesce(F.sum(value).over(w), zero), f"{name}_min": F.coalesce(F.min(value).over(w), zero), f"{name}_max": F.coalesce(F.max(value).over(w), zero)}
    for q in quantiles:
        out[f"{name}_q{q:g}".replace(".", "_")] = F.coalesce(order_statistic(F.collect_list(value).over(w), q), zero)
    return monthly.withColumns(out)


def month_lag(df: DataFrame, value: str, k: int, *, default: float = NONE) -> DataFrame:
    """Value exactly ``k`` months before; gaps miss."""
    w = W.partitionBy("shop_id", "item_id").orderBy("month").rangeBetween(-k, -k)
    return df.withColumn(f"{value}_lag{k}", F.coalesce(F.max(value).over(w), F.lit(default)))


def shifted_join(df: DataFrame, keys: list[str], value: str, k: int, *, default: float = NONE) -> DataFrame:
    """As :func:`month_lag` by an equi join on month + k."""
    lag = df.select(*keys, (F.col("month") + k).alias("month"), F.col(value).alias(f"{value}_lag{k}"))
    return df.join(lag, [*keys, "month"], "left").fillna(default, [f"{value}_lag{k}"])


def expanding_mean(df: DataFrame, ids: list[str], *, value: str = "cnt", q: float | None = None, name: str | None = None) -> DataFrame:
    """Mean over earlier months of each month's mean (or quantile ``q``) of the id; -10 where there is none."""
    stat = F.avg(value) if q is None else F.percentile(value, F.lit(q))
    per = df.groupBy(*ids, "month").agg(stat.alias("_v"))
    before = W.partitionBy(*ids).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    name = name or "_".join([*ids, "mean" if q is None else f"q{q:g}".replace(".", "_")])
    return df.join(per.select(*ids, "month", F.coalesce(F.avg("_v").over(before), F.lit(NONE)).alias(name)), [*ids, "month"], "left")


def as_of_grid(df: DataFrame, ids: list[str], values: dict[str, Column]) -> DataFrame:
    """For each id and each month of the spine (months present, and the next one): values of the last earlier month."""
    per = df.groupBy(*ids, "month").agg(*[c.alias(n) for n, c in values.items()])
    months = df.select("month").distinct()
    spine = months.unionByName(months.agg((F.max("month") + 1).alias("month")))  # a row for each month
    grid = per.select(*ids).distinct().join(F.broadcast(spine), how="cross").join(per, [*ids, "month"], "left")
    w = W.partitionBy(*ids).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    return grid.select(*ids, "month", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in values])


def price_features(df: DataFrame, sales: DataFrame, *, price: str = "price", category: str | None = None) -> DataFrame:
    """Mean and deviation of the item's price in the last earlier month of trade, and the own price one month ago.

    A single row's deviation is 0, a missing own price the mean, no history -10; with a
    category of prices, ``log1p(x + 10)``'s whole part and remainder are added.
    """
    sold = sales.where("cnt > 0")
    past = as_of_grid(sold, ["item_id"], {"price_avg": F.avg(price), "price_std": F.coalesce(F.stddev_samp(price), F.lit(0.0))})
    own = sold.groupBy("shop_id", "item_id", "month").agg(F.avg(price).alias("price_last")).withColumn("month", F.col("month") + 1)
    out = df.join(past, ["item_id", "month"], "left").join(own, KEYS, "left")
    out = out.withColumns({"price_last": F.coalesce("price_last", "price_avg", F.lit(NONE)), "price_avg": F.coalesce("price_avg", F.lit(NONE)), "price_std": F.coalesce("price_std", F.lit(NONE))})
    if category:
        level = F.log1p(F.col("price_avg") + 10)
        last = F.log1p(F.col("price_last") + 10)
        # the remainder of the mean is taken against the last price's whole part, as callers of old expect
        out = out.withColumns({f"{category}": level.cast("int"), f"{category}_sub": level - last.cast("int")})
    return out


def last_traded_age(df: DataFrame, sales: DataFrame, ids: list[str], *, compat: bool = False, name: str = "age") -> DataFrame:
    """Months since the id last traded; -10 without any. ``compat``: between trades, age from the trade before the last."""
    trade = sales.where("cnt <> 0").select(*ids, "month").distinct()
    by = W.partitionBy(*ids).orderBy("month")
    trade = trade.withColumns({"prev": F.lag("month").over(by), "next": F.lead("month").over(by)})
    if not compat:
        spans = trade.select(*ids, F.col("month").alias("since"), (F.col("month") + 1).alias("lo"), F.col("next").alias("hi"))
    else:
        top = sales.agg(F.max("month").alias("top"))
        spans = trade.crossJoin(F.broadcast(top))
        inner = spans.select(*ids, F.col("prev").alias("since"), F.col("month").alias("lo"), F.least(F.col("next") - 1, F.col("top")).alias("hi"), "top", "next").withColumn("hi", F.coalesce("hi", "top")).where("since is not null").drop("top", "next")
        end = spans.where("next is null").select(*ids, F.col("month").alias("since"), (F.col("top") + 1).alias("lo"), F.lit(None).cast("int").alias("hi"))
        spans = inner.unionByName(end)
    inside = (F.col("month") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("month") <= F.col("hi")))
    keys = df.select(*ids, "month").distinct()
    found = keys.join(spans, ids).where(inside).groupBy(*ids, "month").agg(F.max("since").alias("since"))
    return df.join(found, [*ids, "month"], "left").withColumn(name, F.coalesce(F.col("month") - F.col("since"), F.lit(int(NONE)))).drop("since")


def oldness(df: DataFrame, sales: DataFrame, ids: list[str], *, name: str = "oldness") -> DataFrame:
    """Months since the id's first sale (count > 0), 0 where it has none; and whether this is its first month."""
    first = sales.where("cnt > 0").groupBy(*ids).agg(F.min("month").alias("_first"))
    old = F.coalesce(F.col("month") - F.col("_first"), F.lit(0))
    return df.join(first, ids, "left").withColumns({name: old, f"{name}_is_first": old == 0}).drop("_first")


def active_in_month(df: DataFrame, key: str, month: int) -> DataFrame:
    """Keys whose first month is not after, and whose last not before, the given one."""
    return df.groupBy(key).agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where((F.col("lo") <= month) & (F.col("hi") >= month)).select(key)


def unexpected_pairs(val: DataFrame, sales: DataFrame, month: int) -> DataFrame:
    """Leakage filter: ``flag`` where item and shop have past sales, but the shop none in the item's category."""
    past = sales.where((F.col("month") < month) & (F.col("cnt") > 0))
    seen = lambda keys, n: past.select(*keys).distinct().withColumn(n, F.lit(True))
    out = val.join(seen(["item_id"], "_i"), "item_id", "left").join(seen(["shop_id"], "_s"), "shop_id", "left").join(seen(["shop_id", "category_id"], "_p"), ["shop_id", "category_id"], "left")
    return out.withColumn("flag", F.col("_i").isNotNull() & F.col("_s").isNotNull() & F.col("_p").isNull()).drop("_i", "_s", "_p")


def time_split(df: DataFrame, *, skip: int = 0, order: str = "row_id") -> DataFrame:
    """Adds ``part``: train before the last month less ``skip``, val in it, with one row for each pair; other rows go."""
    last = df.agg((F.max("month") - skip).alias("_last"))
    rank = F.row_number().over(W.partitionBy("item_id", "shop_id", "month").orderBy(order))
    out = df.crossJoin(F.broadcast(last)).withColumn("_rank", rank)
    part = F.when(F.col("month") < F.col("_last"), "train").when((F.col("month") == F.col("_last")) & (F.col("_rank") == 1), "val")
    return out.withColumn("part", part).where("part is not null").drop("_last", "_rank")


def forward_sum(df: DataFrame, days: int = 30) -> DataFrame:
    """Sum over the day and the ``days`` after it, for each shop and item."""
    w = W.partitionBy("shop_id", "item_id").orderBy("day").rangeBetween(0, days)
    return df.withColumn("ahead", F.sum("cnt").over(w))


def months_since_trade(df: DataFrame, keys: list[str], cutoff: int) -> DataFrame:
    last = F.max(F.when((F.col("month") < cutoff) & (F.col("cnt") != 0), F.col("month")))
    return df.groupBy(*keys).agg(F.coalesce(F.lit(cutoff) - last, F.lit(int(NONE))).alias("since"))


def prefix_stats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Running count and running sum, the current row left out; exclusive prefix offsets are the same sum."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"seen": F.row_number().over(w) - 1, "before": F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))})


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Number of the run of equal values."""
    w = W.partitionBy(*keys).orderBy(*order)
    turn = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("_turn", turn).withColumn("island", F.sum("_turn").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_turn")


DURATION_IDS = (["item_id"], ["shop_id"], ["category_id"], ["shop_id", "category_id"], ["shop_id", "item_id"])


def duration_features(df: DataFrame, sales: DataFrame, ids: tuple[list[str], ...] = DURATION_IDS) -> DataFrame:
    """Age since the last trade, and oldness, for each of several ids; trades are rows whose count isn't 0."""
    traded = sales.where("cnt <> 0").withColumn("cnt", F.abs("cnt"))
    for keys in ids:
        name = "_".join(k.removesuffix("_id") for k in keys)
        df = oldness(last_traded_age(df, traded, keys, name=f"{name}_age"), traded, keys, name=f"{name}_oldness")
    return df


def with_future_month(history: DataFrame, test: DataFrame, month: int, features) -> tuple[DataFrame, DataFrame]:
    """Test rows as one more month: ``features`` are computed over both together, then cut apart again. Returns (train, test)."""
    blank = {c: F.lit(None).cast(t) for c, t in history.dtypes if c not in test.columns}
    ahead = test.withColumns(blank | {"month": F.lit(month), "cnt": F.lit(0.0), "price": F.lit(0.0), "is_test": F.lit(True)})
    both = features(history.where(F.col("month") < month).withColumn("is_test", F.lit(False)).unionByName(ahead.select(*history.columns, "is_test")))
    return both.where("not is_test").drop("is_test"), both.where("is_test").drop("is_test")
