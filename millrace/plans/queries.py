"""Queries of the library's own operators over the given tables, each with its SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip, month_ordinal, month_start
from ..operators import evaluation, frames, molecules, panel, signals, text
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {VIEWS.strip()} {sql.strip()}"
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 7) -> DataFrame:
    # + 0.0 turns the negative zero that rounding can leave into zero
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


rounded4 = functools.partial(rounded, digits=4)

VIEWS = """
sales AS (SELECT l_suppkey % 5 AS shop_id, l_partkey % 50 AS item_id, (l_partkey % 50) % 7 AS category_id,
  ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::INTEGER AS month, l_extendedprice AS price, l_quantity AS cnt,
  l_orderkey * 10 + l_linenumber AS row_id, datediff('day', DATE '1992-01-01', l_shipdate::DATE)::INTEGER AS day FROM lineitem),
monthly AS (SELECT shop_id, item_id, month, avg(price) AS price, sum(cnt) AS cnt, max(row_id) AS row_id FROM sales GROUP BY ALL),
atoms AS (SELECT l_orderkey AS mol, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ai,
  ['C','F','H','N','O'][(l_partkey % 5 + 1)::INTEGER] AS atom, l_quantity / 20 AS x, l_discount * 25 AS y, l_tax * 25 AS z FROM lineitem),
el(atom, en, valence, lone_pair, donor, mass) AS (VALUES ('H', 2.1::DOUBLE, 1, 0, 0::DOUBLE, 1::DOUBLE), ('O', 3.44, 6, 2, 0.8, 16), ('C', 2.55, 4, 0, 0, 12), ('N', 3.04, 5, 1, 1, 14), ('F', 3.98, 7, 3, 0.5, 19)),
pairs AS (SELECT p.mol, p.ai AS a0, q.ai AS a1, p.atom AS atom0, q.atom AS atom1, p.x AS x0, p.y AS y0, p.z AS z0, q.x AS x1, q.y AS y1, q.z AS z1,
  sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)) AS distance FROM atoms p JOIN atoms q ON p.mol = q.mol AND p.ai <> q.ai),
bond1(atom0, atom1, bond_type, len, energy) AS (VALUES ('H','C',1::DOUBLE,1.09::DOUBLE,413::DOUBLE), ('H','H',1,0.74,436), ('H','N',1,1.01,391), ('H','O',1,0.96,459), ('H','F',1,0.92,565),
  ('C','N',1,1.47,308), ('C','N',1,1.39,350), ('C','N',1.5,1.37,450), ('C','N',1.5,1.33,450), ('C','N',2,1.27,615), ('C','N',3,1.16,887), ('C','F',1,1.35,205),
  ('C','O',1,1.47,360), ('C','O',1,1.43,360), ('C','O',1,1.36,360), ('C','O',1.5,1.28,650), ('C','O',2,1.23,799), ('C','O',2,1.16,1072), ('C','C',1,1.54,348), ('C','C',1.5,1.39,518), ('C','C',2,1.34,614), ('C','C',3,1.2,839),
  ('N','O',1,1.4,201), ('N','O',1.5,1.25,451), ('N','O',2,1.21,607), ('N','N',1,1.45,167), ('N','N',1.5,1.32,340), ('N','N',2,1.25,418), ('N','N',3,1.1,942), ('N','F',1,1.36,283), ('O','O',1,1.48,142), ('O','O',2,1.21,494), ('O','F',1,1.42,190), ('F','F',1,1.42,155)),
bonds AS (SELECT atom0, atom1, bond_type, len, energy FROM bond1 UNION SELECT atom1, atom0, bond_type, len, energy FROM bond1),
edges1 AS (SELECT mol, a0, a1, distance, bond_type, (x1 - x0) / nullif(distance, 0) AS x, (y1 - y0) / nullif(distance, 0) AS y, (z1 - z0) / nullif(distance, 0) AS z FROM (
  SELECT p.*, b.bond_type, b.len, row_number() OVER (PARTITION BY p.mol, p.a0, p.a1 ORDER BY abs(p.distance - b.len), b.bond_type) AS r FROM pairs p JOIN bonds b USING (atom0, atom1) WHERE p.a0 < p.a1) WHERE r = 1 AND distance <= len * 1.1),
edges AS (SELECT * FROM edges1 UNION ALL SELECT mol, a1, a0, distance, bond_type, -x, -y, -z FROM edges1),
sig AS (SELECT user_id % 20 AS signal_id, (row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1)::BIGINT AS t, value FROM events),
preds AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_totalprice AS truth, o_totalprice * (0.9 + (o_custkey % 20) / 100.0::DOUBLE) AS a, o_totalprice * 1.02 + 100 AS b,
  (o_orderstatus = 'F')::INTEGER AS y, (o_custkey % 100) / 100.0::DOUBLE AS score FROM orders)
"""


def sales(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    return li.select(
        (F.col("l_suppkey") % 5).alias("shop_id"), (F.col("l_partkey") % 50).alias("item_id"), (F.col("l_partkey") % 50 % 7).alias("category_id"), month_ordinal(F.col("l_shipdate"), 1992).alias("month"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("cnt"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).alias("day"),
    )


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return panel.monthly_rollup(sales(spark, d))


def atoms(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"])
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    element = F.element_at(F.array(*[F.lit(a) for a in "CFHNO"]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("mol"), place.cast("long").alias("ai"), element.alias("atom"), (F.col("l_quantity") / 20).alias("x"), (F.col("l_discount") * 25).alias("y"), (F.col("l_tax") * 25).alias("z"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return molecules.both_ways(molecules.find_edges(atoms(spark, d)))


def target_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A pair for each molecule of two atoms or more: its first and last atom."""
    a = atoms(spark, d).groupBy("mol").agg(F.min("ai").alias("a0"), F.max("ai").alias("a1")).where("a0 < a1")
    return a.select(F.col("mol").alias("id"), "mol", "a0", "a1")


TARGETS = "(SELECT mol AS id, mol, min(ai) AS a0, max(ai) AS a1 FROM atoms GROUP BY mol HAVING min(ai) < max(ai))"


def signal(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events", ["event_id", "user_id", "value"])
    key = (F.col("user_id") % 20).alias("signal_id")
    return ev.select(key, "event_id", "value").select("signal_id", (F.row_number().over(W.partitionBy("signal_id").orderBy("event_id")) - 1).cast("long").alias("t"), "value")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("truth"), (F.col("o_totalprice") * (0.9 + F.col("o_custkey") % 20 / 100)).alias("a"), (F.col("o_totalprice") * 1.02 + 100).alias("b"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_custkey") % 100 / 100).alias("score"))


# --- demand panel ---------------------------------------------------------------------


@query("SELECT shop_id, item_id, month, round(price, 7) AS price, cnt, row_id FROM monthly")
def panel_monthly_rollup(spark, d):
    return rounded(monthly(spark, d), "price")


@query("SELECT shop_id, item_id, (day // 7 + 1)::BIGINT AS bucket, sum(cnt) AS cnt, round(avg(price), 7) AS price FROM sales GROUP BY ALL")
def panel_bucket_rollup(spark, d):
    return rounded(panel.bucket_rollup(sales(spark, d), 7), "price")


@query("""SELECT shop_id, item_id, month, round(coalesce(m.price, p.price), 7) AS price, coalesce(cnt, 0) AS cnt, row_id IS NULL AS is_new FROM
(SELECT DISTINCT month, item_id FROM monthly) JOIN (SELECT DISTINCT month, shop_id FROM monthly) USING (month) LEFT JOIN monthly m USING (shop_id, item_id, month)
JOIN (SELECT month, item_id, quantile_cont(price, 0.5) AS price FROM monthly GROUP BY ALL) p USING (month, item_id)""")
def panel_densify(spark, d):
    return rounded(panel.densify(monthly(spark, d), base_year=1992).select("shop_id", "item_id", "month", "price", "cnt", "is_new"), "price")


def _trailing(n: int) -> str:
    w = f"(PARTITION BY shop_id, item_id ORDER BY month RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"coalesce(sum(cnt) OVER {w}, 0) AS cnt_{n}m_sum, coalesce(min(cnt) OVER {w}, 0) AS cnt_{n}m_min, coalesce(max(cnt) OVER {w}, 0) AS cnt_{n}m_max, list_sort(list(cnt) OVER {w}) AS l{n}"


@query(f"""SELECT shop_id, item_id, month, * LIKE 'cnt%m%', coalesce(l4[greatest(1, floor(len(l4) * 0.5)::INTEGER)], 0) AS cnt_4m_q0_5 FROM (SELECT shop_id, item_id, month, {_trailing(1)}, {_trailing(2)}, {_trailing(4)} FROM monthly)""")
def panel_trailing_stats(spark, d):
    out = monthly(spark, d)
    for n, q in ((1, ()), (2, ()), (4, (0.5,))):
        out = panel.trailing_stats(out, n, q)
    return out.drop("price", "cnt", "row_id")


@query("""SELECT m.shop_id, m.item_id, m.month, coalesce(a.cnt, -10) AS cnt_lag2, coalesce(b.cnt, -10) AS cnt_lag5 FROM monthly m
LEFT JOIN monthly a ON a.shop_id = m.shop_id AND a.item_id = m.item_id AND a.month + 2 = m.month LEFT JOIN monthly b ON b.shop_id = m.shop_id AND b.item_id = m.item_id AND b.month + 5 = m.month""")
def panel_month_lags(spark, d):
    return panel.month_lag(panel.month_lag(monthly(spark, d), "cnt", 2), "cnt", 5).select("shop_id", "item_id", "month", "cnt_lag2", "cnt_lag5")


@query("""SELECT m.shop_id, m.item_id, m.month, coalesce(b.price, -10) AS price_lag1 FROM (SELECT shop_id, item_id, month FROM monthly) m
LEFT JOIN (SELECT shop_id, item_id, month + 1 AS month, round(price, 7) AS price FROM monthly) b USING (shop_id, item_id, month)""")
def panel_shifted_join(spark, d):
    return rounded(panel.shifted_join(monthly(spark, d), ["shop_id", "item_id"], "price", 1).select("shop_id", "item_id", "month", "price_lag1"), "price_lag1")


def _expanding(ids: str, stat: str, name: str) -> str:
    return f"(SELECT {ids}, month, round(coalesce(avg(v) OVER (PARTITION BY {ids} ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -10), 9) AS {name} FROM (SELECT {ids}, month, {stat} AS v FROM cm GROUP BY ALL))"


@query(f""", cm AS (SELECT *, item_id % 7 AS category_id FROM monthly) SELECT shop_id, item_id, month, item_id_mean, category_id_mean, shop_id_mean, shop_id_item_id_mean, shop_id_category_id_mean, item_id_q0_9 FROM cm
JOIN {_expanding("item_id", "avg(cnt)", "item_id_mean")} USING (item_id, month) JOIN {_expanding("category_id", "avg(cnt)", "category_id_mean")} USING (category_id, month)
JOIN {_expanding("shop_id", "avg(cnt)", "shop_id_mean")} USING (shop_id, month) JOIN {_expanding("shop_id, item_id", "avg(cnt)", "shop_id_item_id_mean")} USING (shop_id, item_id, month)
JOIN {_expanding("shop_id, category_id", "avg(cnt)", "shop_id_category_id_mean")} USING (shop_id, category_id, month) JOIN {_expanding("item_id", "quantile_cont(cnt, 0.9)", "item_id_q0_9")} USING (item_id, month)""")
def panel_expanding_encodings(spark, d):
    out = monthly(spark, d).withColumn("category_id", F.col("item_id") % 7)
    names = []
    for ids in (["item_id"], ["category_id"], ["shop_id"], ["shop_id", "item_id"], ["shop_id", "category_id"]):
        out = panel.expanding_mean(out, ids)
        names.append("_".join([*ids, "mean"]))
    out = panel.expanding_mean(out, ["item_id"], q=0.9)
    return rounded(out, *names, "item_id_q0_9", digits=9).select("shop_id", "item_id", "month", *names, "item_id_q0_9")


@query(""", per AS (SELECT item_id, month, avg(price) AS a, coalesce(stddev_samp(price), 0) AS s FROM monthly WHERE cnt > 0 GROUP BY ALL)
SELECT m.shop_id, m.item_id, m.month, round(coalesce(p.a, -10), 7) AS price_avg, round(coalesce(p.s, -10), 7) AS price_std, round(coalesce(o.price, p.a, -10), 7) AS price_last FROM monthly m
LEFT JOIN (SELECT x.item_id, x.month, arg_max(per.a, per.month) AS a, arg_max(per.s, per.month) AS s FROM (SELECT DISTINCT item_id, month FROM monthly) x JOIN per ON per.item_id = x.item_id AND per.month < x.month GROUP BY ALL) p ON p.item_id = m.item_id AND p.month = m.month
LEFT JOIN monthly o ON o.shop_id = m.shop_id AND o.item_id = m.item_id AND o.month + 1 = m.month AND o.cnt > 0""")
def panel_price_features(spark, d):
    m = monthly(spark, d)
    return rounded(panel.price_features(m.select("shop_id", "item_id", "month"), m), "price_avg", "price_std", "price_last")


@query("""SELECT shop_id, item_id, month, coalesce(month - (SELECT max(b.month) FROM monthly b WHERE b.item_id = m.item_id AND b.month < m.month), -10) AS age_item,
coalesce(month - lag(month) OVER (PARTITION BY shop_id, item_id ORDER BY month), -10) AS age_pair FROM monthly m""")
def panel_last_traded_age(spark, d):
    m = monthly(spark, d)
    out = panel.last_traded_age(m.select("shop_id", "item_id", "month"), m, ["item_id"], name="age_item")
    return panel.last_traded_age(out, m, ["shop_id", "item_id"], name="age_pair").select("shop_id", "item_id", "month", "age_item", "age_pair")


@query("""SELECT shop_id, item_id, month, month - min(month) OVER (PARTITION BY item_id) AS oldness, month = min(month) OVER (PARTITION BY item_id) AS oldness_is_first,
month - min(month) OVER (PARTITION BY shop_id, item_id) AS pair_oldness FROM monthly""")
def panel_oldness(spark, d):
    m = monthly(spark, d)
    out = panel.oldness(m.select("shop_id", "item_id", "month"), m, ["item_id"])
    return panel.oldness(out, m, ["shop_id", "item_id"], name="pair_oldness").drop("pair_oldness_is_first")


@query("SELECT item_id FROM monthly GROUP BY item_id HAVING min(month) <= 40 AND max(month) >= 40")
def panel_active_items(spark, d):
    return panel.active_in_month(monthly(spark, d), "item_id", 40)


@query(""", h AS (SELECT shop_id, item_id, item_id % 7 AS category_id FROM monthly WHERE month < 3 AND cnt > 0)
SELECT shop_id, item_id, month, item_id IN (SELECT item_id FROM h) AND shop_id IN (SELECT shop_id FROM h) AND NOT EXISTS (SELECT 1 FROM h WHERE h.shop_id = m.shop_id AND h.category_id = m.item_id % 7) AS flag FROM monthly m WHERE month >= 3""")
def panel_leakage_filter(spark, d):
    m = monthly(spark, d).withColumn("category_id", F.col("item_id") % 7)
    return panel.unexpected_pairs(m.where("month >= 3"), m, 3).select("shop_id", "item_id", "month", "flag")


@query("""SELECT shop_id, item_id, month, row_id, part FROM (SELECT *, CASE WHEN month < last THEN 'train' WHEN month = last AND r = 1 THEN 'val' END AS part FROM
(SELECT *, (SELECT max(month) FROM sales) - 1 AS last, row_number() OVER (PARTITION BY item_id, shop_id, month ORDER BY row_id, price, cnt) AS r FROM sales)) WHERE part IS NOT NULL""")
def panel_time_split(spark, d):
    return panel.time_split(sales(spark, d), skip=1).select("shop_id", "item_id", "month", "row_id", "part")


@query("SELECT shop_id, item_id, row_id, sum(cnt) OVER (PARTITION BY shop_id, item_id ORDER BY day RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING) AS ahead FROM sales")
def panel_forward_sum(spark, d):
    return panel.forward_sum(sales(spark, d)).select("shop_id", "item_id", "row_id", "ahead")


@query("SELECT item_id, shop_id, coalesce(60 - max(CASE WHEN month < 60 AND cnt <> 0 THEN month END), -10) AS since FROM monthly GROUP BY ALL")
def panel_months_since_trade(spark, d):
    return panel.months_since_trade(monthly(spark, d), ["item_id", "shop_id"], 60)


@query("""SELECT shop_id, item_id, month, row_number() OVER w - 1 AS seen, coalesce(sum(cnt) OVER (PARTITION BY shop_id, item_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM monthly WINDOW w AS (PARTITION BY shop_id, item_id ORDER BY month)""")
def panel_prefix_stats(spark, d):
    return panel.prefix_stats(monthly(spark, d), ["shop_id", "item_id"], ["month"], "cnt").select("shop_id", "item_id", "month", "seen", "before")


# --- any table ------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS n, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS share FROM lineitem GROUP BY l_returnflag")
def frame_share_of_total(spark, d):
    return frames.share_of_total(table(spark, d, "lineitem", ["l_returnflag"]), "l_returnflag")


@query("SELECT l_linestatus, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS \"A\", coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS \"N\", coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS \"R\" FROM lineitem GROUP BY l_linestatus")
def frame_matrix(spark, d):
    return frames.matrix(table(spark, d, "lineitem", ["l_linestatus", "l_returnflag", "l_quantity"]), "l_linestatus", "l_returnflag", ["A", "N", "R"], "l_quantity")


@query("SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_enc FROM customer")
def frame_label_encode(spark, d):
    return frames.label_encode(table(spark, d, "customer", ["c_custkey", "c_mktsegment"]), "c_mktsegment")


@query("SELECT * FROM (SELECT 'l_quantity' AS a, 'l_quantity' AS b, 1.0::DOUBLE AS r UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', 1.0)")
def frame_correlations(spark, d):
    return rounded(frames.correlations(table(spark, d, "lineitem", ["l_quantity", "l_discount"]), ["l_quantity", "l_discount"]), "r", digits=6)


@query("SELECT count(*) AS keys, round(avg((r < 0.05)::INTEGER), 6) AS under_0_05, round(avg((r < 0.1)::INTEGER), 6) AS under_0_1, round(avg((r < 0.4)::INTEGER), 6) AS under_0_4 FROM (SELECT stddev_samp(price) / max(price) AS r FROM sales GROUP BY item_id HAVING count(*) >= 10)")
def frame_deviation_bands(spark, d):
    return rounded(frames.deviation_bands(sales(spark, d), "item_id", "price", bands=(0.05, 0.1, 0.4)), "under_0_05", "under_0_1", "under_0_4", digits=6)


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 7) AS c_acctbal FROM customer")
def frame_standardise(spark, d):
    return rounded(frames.standardise(table(spark, d, "customer", ["c_custkey", "c_acctbal"]), ["c_acctbal"]), "c_acctbal")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def frame_keep_first(spark, d):
    return frames.keep_first(table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_orderdate"]), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def frame_full_join(spark, d):
    a = table(spark, d, "customer", ["c_nationkey"]).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier", ["s_nationkey"]).groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full").fillna(0, ["customers", "suppliers"])


@query("SELECT p_partkey, least(20, greatest(0, p_size - 15))::DOUBLE AS y, (make_date(1992 + (p_size % 35) // 12, (p_size % 35) % 12 + 1, 1)) AS d FROM part")
def frame_clip_and_dates(spark, d):
    return table(spark, d, "part", ["p_partkey", "p_size"]).select("p_partkey", clip(F.col("p_size") - 15, 0.0, 20.0).alias("y"), month_start(F.col("p_size") % 35, 1992).alias("d"))


# --- signals --------------------------------------------------------------------------


def _profile() -> str:
    cuts, out = [0, 10, 20, 30, 40], []
    for lo, hi in signals.QUARTERS:
        f = "" if (lo, hi) == (0, 4) else f" FILTER (t % 40 >= {cuts[lo]} AND t % 40 < {cuts[hi]})"
        n = f"{25 * lo}_{25 * hi}"
        out += [f"round(avg(value){f}, 7) AS mean_{n}", f"round(stddev_samp(value){f}, 7) AS std_{n}", f"max(value){f} AS max_{n}", f"min(value){f} AS min_{n}"]
        out += [f"round(quantile_cont(value, {q}){f}, 7) AS q{int(100 * q):02d}_{n}" for q in (0.05, 0.5, 0.95)]
    return ", ".join(out)


@query(f"SELECT signal_id, t // 40 AS chunk, {_profile()}, arg_max(t, t) AS last FROM sig WHERE t // 40 < (SELECT (max(s.t) + 1) // 40 FROM sig s WHERE s.signal_id = sig.signal_id) GROUP BY ALL")
def signal_chunk_profile(spark, d):
    chunks = signals.tumbling(signal(spark, d), 40, key="signal_id").withColumn("last", F.col("t"))
    out = signals.chunk_profile(chunks, 40, keys=("signal_id", "chunk"), label="last")
    return rounded(out, *[c for c in out.columns if c[:4] == "mean" or c[:3] == "std" or c[0] == "q"])


@query("SELECT signal_id, t, round(avg(value) OVER w, 7) AS smooth, round(value - avg(value) OVER w, 7) AS residual FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def signal_smooth(spark, d):
    return rounded(signals.smooth(signal(spark, d), 3), "smooth", "residual").drop("value")


@query(""", c AS (SELECT signal_id, t // 64 AS chunk, t, value FROM sig), m AS (SELECT *, avg(value) OVER w AS m, count(*) OVER w AS n, row_number() OVER (PARTITION BY signal_id, chunk ORDER BY t) - 1 AS place FROM c WINDOW w AS (PARTITION BY signal_id, chunk ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT signal_id, chunk, t, round(abs(m - lag(m) OVER (PARTITION BY signal_id, chunk ORDER BY t)), 7) AS diff FROM (SELECT signal_id, chunk, t, CASE WHEN n = 4 THEN m END AS m FROM m WHERE place % 4 = 0)""")
def signal_scale_difference(spark, d):
    chunks = signal(spark, d).withColumn("chunk", F.floor(F.col("t") / 64))
    return rounded(signals.scale_difference(chunks, 4), "diff").select("signal_id", "chunk", "t", "diff")


@query("SELECT signal_id, t, list(value) OVER (PARTITION BY signal_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM sig".replace("SELECT", "SELECT signal_id, t, l[1] AS first, l[5] AS last FROM (SELECT", 1) + ") WHERE len(l) = 5")
def signal_sliding_steps(spark, d):
    out = signals.sliding_steps(signal(spark, d), 5, ["value"], order="t", keys=("signal_id",))
    return out.select("signal_id", "t", F.col("steps")[0][0].alias("first"), F.col("steps")[4][0].alias("last"))


@query("SELECT signal_id, t, value / (SELECT max(abs(value)) FROM sig WHERE t < 100) AS value FROM sig")
def signal_max_abs_scale(spark, d):
    s = signal(spark, d)
    return signals.max_abs_scale(s.where("t < 100"), s, ["value"])


@query("SELECT signal_id, t, coalesce(lead(value, 1) OVER (PARTITION BY t // 3, signal_id ORDER BY t), first_value(value) OVER (PARTITION BY t // 3, signal_id ORDER BY t)) AS value_lead1 FROM sig")
def signal_phase_lead(spark, d):
    s = signal(spark, d).withColumn("grp", F.col("signal_id") * 10_000_000 + F.floor(F.col("t") / 3))
    return signals.phase_lead(s, 1, group="grp", order="t", value="value").select("signal_id", "t", "value_lead1")


@query("SELECT signal_id, t, segment_id FROM (SELECT signal_id, t, t // 50 AS segment_id FROM sig UNION ALL SELECT signal_id, t, t // 50 + 1 FROM sig WHERE t % 50 >= 40 AND t // 50 < (SELECT max(t) // 50 FROM sig))")
def signal_padded_segments(spark, d):
    return signals.padded_segments(signal(spark, d), chunk="t", segment=50, pad=10).select("signal_id", "t", "segment_id")


@query()
def signal_peak_stats(spark, d):
    s = signal(spark, d)
    return signals.peak_stats(s, signals.peaks(s, 20.0))


@query()
def signal_corona_pairs(spark, d):
    return signals.corona_pairs(signals.peaks(signal(spark, d), 20.0), distance=5, ratio=0.4)


@query()
def signal_chunk_transform(spark, d):
    return signals.chunk_transform(signal(spark, d), 128, threshold=20.0)


@query()
def signal_remove_corona(spark, d):
    return signals.remove_corona(signal(spark, d), threshold=20.0, distance=5, ratio=0.4, cleanup=2)


@query(""", f AS (SELECT signal_id, 'f' || (t % 4) AS feature, value FROM sig), s AS (SELECT signal_id, feature, avg(value) AS mean, avg(abs(value)) AS abs_mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90 FROM f GROUP BY ALL),
z AS (SELECT signal_id, """ + ", ".join(f"sum((abs(({n} - avg({n}) OVER w)) / nullif(stddev_pop({n}) OVER w, 0) > 1.5)::INTEGER) AS {n}".replace("sum(", "(") for n in ("mean", "abs_mean", "std", "q50", "q10", "q90")) + """ FROM s WINDOW w AS (PARTITION BY feature)),
v AS (SELECT signal_id, """ + " + ".join(f"(coalesce(sum({n}), 0) > floor(count(*) * 0.3))::INTEGER" for n in ("mean", "abs_mean", "std", "q50", "q10", "q90")) + """ AS votes FROM z GROUP BY signal_id) SELECT signal_id, votes, votes >= 3 AS is_outlier FROM v""")
def signal_outlier_votes(spark, d):
    s = signal(spark, d).withColumn("feature", F.concat(F.lit("f"), (F.col("t") % 4).cast("string")))
    return signals.outlier_votes(s, z=1.5)


# --- molecules ------------------------------------------------------------------------


@query("SELECT mol, a0, a1, round(distance, 4) AS distance, bond_type, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z FROM edges1")
def molecule_edges(spark, d):
    return rounded4(molecules.find_edges(atoms(spark, d)), "distance", "x", "y", "z")


@query("SELECT mol, a0 AS ai, count(*) AS degree FROM edges GROUP BY ALL")
def molecule_degree(spark, d):
    return molecules.degree(edges(spark, d))


@query("""SELECT mol, ai, nbr, min(hop) AS hop FROM (
SELECT mol, a0 AS ai, a1 AS nbr, 1 AS hop FROM edges UNION ALL SELECT e.mol, e.a0, f.a1, 2 FROM edges e JOIN edges f ON e.mol = f.mol AND e.a1 = f.a0
UNION ALL SELECT e.mol, e.a0, g.a1, 3 FROM edges e JOIN edges f ON e.mol = f.mol AND e.a1 = f.a0 JOIN edges g ON f.mol = g.mol AND f.a1 = g.a0) WHERE ai <> nbr GROUP BY ALL""")
def molecule_hop_neighbours(spark, d):
    return molecules.hop_neighbours(edges(spark, d), atoms(spark, d), 3)


@query("""SELECT mol, a0 AS ai, round(sum((p.en - q.en) / nullif(distance, 0)), 4) + 0.0 AS q, round(sum((p.en - q.en) / nullif(pow(distance, 4), 0)), 3) + 0.0 AS q4 FROM edges JOIN (SELECT mol, ai AS a0, en FROM atoms JOIN el USING (atom)) p USING (mol, a0)
JOIN (SELECT mol, ai AS a1, en FROM atoms JOIN el USING (atom)) q USING (mol, a1) GROUP BY ALL""")
def molecule_partial_charge(spark, d):
    return rounded4(rounded4(molecules.partial_charge(edges(spark, d), atoms(spark, d)), "q"), "q4", digits=3)


@query(""", c AS (SELECT mol, a0 AS ai, sum((p.en - q.en) / nullif(distance, 0)) AS q FROM edges JOIN (SELECT mol, ai AS a0, en FROM atoms JOIN el USING (atom)) p USING (mol, a0) JOIN (SELECT mol, ai AS a1, en FROM atoms JOIN el USING (atom)) q USING (mol, a1) GROUP BY ALL)
SELECT p.mol, p.a0 AS ai, round(sum(a.q * b.q / nullif(distance, 0)), 4) + 0.0 AS coulomb, round(sum(a.q * b.q / nullif(distance, 0) * exp(-distance)), 4) + 0.0 AS yukawa FROM pairs p JOIN c a ON a.mol = p.mol AND a.ai = p.a0 JOIN c b ON b.mol = p.mol AND b.ai = p.a1 GROUP BY ALL""")
def molecule_potentials(spark, d):
    a, e = atoms(spark, d), edges(spark, d)
    return rounded4(molecules.potentials(a, molecules.partial_charge(e, a)), "coulomb", "yukawa")


@query("""SELECT mol, a0 AS ai, format('C{}F{}H{}N{}O{}', count(*) FILTER (b.atom = 'C'), count(*) FILTER (b.atom = 'F'), count(*) FILTER (b.atom = 'H'), count(*) FILTER (b.atom = 'N'), count(*) FILTER (b.atom = 'O')) AS composition
FROM edges JOIN (SELECT mol, ai AS a1, atom FROM atoms) b USING (mol, a1) GROUP BY ALL""")
def molecule_bond_composition(spark, d):
    return molecules.bond_composition(edges(spark, d), atoms(spark, d))


@query("""SELECT mol, a0 AS ai, count(*) FILTER (distance < 2) AS n_0_2, coalesce(sum(valence) FILTER (distance < 2), 0)::BIGINT AS valence_0_2, coalesce(sum(lone_pair) FILTER (distance < 2), 0)::BIGINT AS lone_pair_0_2,
count(*) FILTER (distance >= 2 AND distance < 5) AS n_2_5, coalesce(sum(valence) FILTER (distance >= 2 AND distance < 5), 0)::BIGINT AS valence_2_5, coalesce(sum(lone_pair) FILTER (distance >= 2 AND distance < 5), 0)::BIGINT AS lone_pair_2_5
FROM pairs JOIN (SELECT atom AS atom1, valence, lone_pair FROM el) USING (atom1) GROUP BY ALL""")
def molecule_bands(spark, d):
    return molecules.bands(atoms(spark, d))


@query("""SELECT mol, count(*) AS n_atoms, count(*) FILTER (atom = 'C') AS n_c, CASE WHEN count(*) FILTER (atom = 'C') > 0 THEN (2 * count(*) FILTER (atom = 'C') + 2 + count(*) FILTER (atom = 'N') - count(*) FILTER (atom = 'F') - count(*) FILTER (atom = 'H')) / 2 ELSE -10 END AS unsaturation,
round(max(x) - min(x), 4) AS range_x, round(quantile_cont(y, 0.5) - min(y), 4) AS q50_y FROM atoms GROUP BY mol""")
def molecule_shape(spark, d):
    out = molecules.molecule_shape(atoms(spark, d))
    return rounded4(out, "range_x", "q50_y").select("mol", "n_atoms", F.col("n_C").alias("n_c"), "unsaturation", "range_x", "q50_y")


@query(f"""SELECT id, round(sqrt(pow((p.x + q.x) / 2 - c.x, 2) + pow((p.y + q.y) / 2 - c.y, 2) + pow((p.z + q.z) / 2 - c.z, 2)), 7) AS centre_mid FROM {TARGETS} t JOIN atoms p ON p.mol = t.mol AND p.ai = t.a0 JOIN atoms q ON q.mol = t.mol AND q.ai = t.a1
JOIN (SELECT mol, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM atoms GROUP BY mol) c ON c.mol = t.mol""")
def molecule_centre(spark, d):
    return rounded4(molecules.centre_features(target_pairs(spark, d), atoms(spark, d)), "centre_mid", digits=7).select("id", "centre_mid")


@query("""SELECT mol, ai, round(avg(c), 3) + 0.0 AS cos_avg, round(var_pop(c), 3) + 0.0 AS cos_var FROM (SELECT e.mol, e.a0 AS ai, (e.x * f.x + e.y * f.y + e.z * f.z) / nullif(sqrt(e.x * e.x + e.y * e.y + e.z * e.z) * sqrt(f.x * f.x + f.y * f.y + f.z * f.z), 0) AS c
FROM edges e JOIN edges f ON e.mol = f.mol AND e.a0 = f.a0 AND e.a1 < f.a1) GROUP BY ALL""")
def molecule_angles(spark, d):
    return rounded4(molecules.angle_stats(edges(spark, d)), "cos_avg", "cos_var", digits=3).select("mol", "ai", "cos_avg", "cos_var")


@query(f"""SELECT id, coalesce(n, 0) AS near_n, round(coalesce(m, -10), 4) + 0.0 AS near_mean FROM {TARGETS} LEFT JOIN (SELECT t.id, count(*) AS n, avg(e.distance) AS m FROM {TARGETS} t JOIN edges e ON e.mol = t.mol AND e.a0 = t.a0 AND e.a1 <> t.a1 GROUP BY t.id) USING (id)""")
def molecule_neighbour_lengths(spark, d):
    pairs, e = target_pairs(spark, d), edges(spark, d)
    n = pairs.join(e.select("mol", "a0", F.col("a1").alias("nbr")), ["mol", "a0"]).where("nbr <> a1").groupBy("id").agg(F.count("*").alias("near_n"))
    got = molecules.neighbour_features(pairs, e, atoms(spark, d), 0).select("id", F.col("d_mean_0").alias("near_mean"))
    return rounded4(got.join(n, "id", "left").fillna(0, ["near_n"]), "near_mean").select("id", "near_n", "near_mean")


@query()
def molecule_hull(spark, d):
    return molecules.hull(atoms(spark, d))


# --- text -----------------------------------------------------------------------------


@query(""", t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '(\\w\\w+)', 1)) AS term FROM part), tf AS (SELECT p_partkey, term, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term)
SELECT p_partkey, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY p_partkey)), 4) AS weight FROM tf JOIN idf USING (term)""")
def text_tf_idf(spark, d):
    return rounded4(text.tf_idf(table(spark, d, "part", ["p_partkey", "p_name"]), key="p_partkey", text="p_name"), "weight")


@query(""", c AS (SELECT t AS term, count(*) AS n FROM (SELECT unnest(list_transform(regexp_split_to_array(lower(p_name), '[ \\-/:]'), lambda x: regexp_replace(x, '[(*"./)]', '', 'g'))) AS t FROM part) WHERE t <> '' GROUP BY t)
SELECT count(*) AS terms, sum(n)::BIGINT AS tokens, (SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, term LIMIT 5))::DOUBLE / sum(n)::DOUBLE AS coverage FROM c""")
def text_coverage(spark, d):
    return text.coverage(table(spark, d, "part", ["p_name"]), "p_name", 5)


# --- evaluation -----------------------------------------------------------------------


@query("SELECT round(avg(ln(mae)), 4) AS score FROM (SELECT avg(abs(truth - a)) AS mae FROM preds GROUP BY kind)")
def eval_log_mae(spark, d):
    return rounded4(evaluation.log_mae(predictions(spark, d), "kind", "truth", "a"), "score")


@query("""SELECT tp, tn, fp, fn, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 4) + 0.0 AS mcc FROM
(SELECT count(*) FILTER (y = 1 AND p) AS tp, count(*) FILTER (y = 0 AND NOT p) AS tn, count(*) FILTER (y = 0 AND p) AS fp, count(*) FILTER (y = 1 AND NOT p) AS fn FROM (SELECT y, score > 0.5 AS p FROM preds))""")
def eval_mcc(spark, d):
    return rounded4(evaluation.mcc(predictions(spark, d).withColumn("p", (F.col("score") > 0.5).cast("int")), "y", "p"), "mcc")


@query("""SELECT threshold, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 4) + 0.0 AS mcc FROM (SELECT threshold, (count(*) FILTER (y = 1 AND score > threshold))::DOUBLE AS tp, (count(*) FILTER (y = 0 AND score <= threshold))::DOUBLE AS tn,
(count(*) FILTER (y = 0 AND score > threshold))::DOUBLE AS fp, (count(*) FILTER (y = 1 AND score <= threshold))::DOUBLE AS fn FROM preds, (VALUES (0.255::DOUBLE), (0.505), (0.755)) g(threshold) GROUP BY threshold)""")
def eval_threshold_grid(spark, d):
    return rounded4(evaluation.mcc_by_threshold(predictions(spark, d), "y", "score", [0.255, 0.505, 0.755]), "mcc")


@query("SELECT kind, round(avg(e) / 1e6, 4) AS mean, round(sum(e) / (SELECT sum((truth - a) * (truth - a)) FROM preds), 6) AS share FROM (SELECT kind, (truth - a) * (truth - a) AS e FROM preds) GROUP BY kind")
def eval_group_error(spark, d):
    out = evaluation.group_error(predictions(spark, d), "kind", "truth", "a").withColumn("mean", F.col("mean") / 1e6)
    return rounded4(rounded4(out, "mean"), "share", digits=6).select("kind", "mean", "share")


@query("SELECT arg_min(alpha, mae) AS alpha, round(min(mae), 3) AS mae FROM (SELECT alpha, avg(abs(truth - alpha * a - (1 - alpha) * b)) AS mae FROM preds, (SELECT i / 10.0::DOUBLE AS alpha FROM range(11) r(i)) GROUP BY alpha)")
def eval_best_blend(spark, d):
    return rounded4(evaluation.best_blend(predictions(spark, d), "truth", "a", "b", step=0.1), "mae", digits=3)


@query("SELECT kind, (avg(y) > 0.5)::INTEGER AS vote FROM preds GROUP BY kind")
def eval_majority(spark, d):
    return evaluation.majority(predictions(spark, d), "kind", "y")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Densified panel with trailing statistics, lags and encodings."""
    dense = panel.densify(monthly(spark, d), base_year=1992)
    return panel.expanding_mean(panel.month_lag(panel.trailing_stats(dense, 4, (0.5,)), "cnt", 3), ["item_id"])


from . import more as _more  # noqa: E402, F401  (registers its queries)
