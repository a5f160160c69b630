"""Operators on small fixtures with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.columns import cross, month_ordinal, normal_component, tokens, vector
from millrace.operators import evaluation, frames, molecules, panel, signals, text


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def panel_rows(seed: int, n: int = 160):
    """Distinct (month, shop, item) with a count and a price, by month; some counts are 0."""
    r = np.random.default_rng(seed)
    keys = sorted({(int(m), int(s), int(i)) for m, s, i in zip(r.integers(3, 15, n), r.integers(0, 3, n), r.integers(0, 5, n), strict=True)})
    return [(k, *key, float(r.integers(0, 6)), float(r.integers(5, 90))) for k, key in enumerate(keys)]


PANEL = "row_id long, month int, shop_id int, item_id int, cnt double, price double"


def test_trailing_stats(spark):
    data = panel_rows(1)
    out = panel.trailing_stats(spark.createDataFrame(data, PANEL), 4, (1.0,)).collect()
    assert len(out) == len(data)
    for r in out:
        past = [c for _, m, s, i, c, _ in data if (s, i) == (r.shop_id, r.item_id) and r.month - 4 <= m < r.month]
        assert (r.cnt_4m_sum, r.cnt_4m_min, r.cnt_4m_max, r.cnt_4m_q1) == (sum(past), min(past, default=0), max(past, default=0), max(past, default=0))


def test_expanding_mean(spark):
    data = panel_rows(2)
    for r in panel.expanding_mean(spark.createDataFrame(data, PANEL), ["item_id"]).collect():
        by_month = {}
        for _, m, _, i, c, _ in data:
            if i == r.item_id and m < r.month:
                by_month.setdefault(m, []).append(c)
        assert r.item_id_mean == pytest.approx(np.mean([np.mean(v) for v in by_month.values()]) if by_month else -10)


def test_densify(spark):
    data = panel_rows(3)
    out = panel.densify(spark.createDataFrame(data, PANEL)).collect()
    shops, items = ({(m, x[at]) for x in data for m in [x[1]]} for at in (2, 3))
    want = {(m, s, i) for m, s in shops for n, i in items if m == n}
    assert {(r.month, r.shop_id, r.item_id) for r in out} == want and len(out) == len(want)
    new = sorted((r for r in out if r.is_new), key=lambda r: (r.month, r.shop_id, r.item_id))
    assert [r.row_id for r in new] == list(range(len(data), len(want)))
    for r in new:
        assert r.cnt == 0 and r.price == np.median([x[5] for x in data if (x[1], x[3]) == (r.month, r.item_id)])


def test_price_features(spark):
    data = panel_rows(4)
    df = spark.createDataFrame(data, PANEL)
    for r in panel.price_features(df.drop("price", "cnt"), df).collect():
        past = [x for x in data if x[3] == r.item_id and x[1] < r.month and x[4] > 0]
        last = [x[5] for x in past if x[1] == max(y[1] for y in past)]
        own = [x[5] for x in past if x[1] == r.month - 1 and x[2] == r.shop_id]
        mean, std = (np.mean(last), np.std(last, ddof=1) if len(last) > 1 else 0.0) if last else (-10, -10)
        assert (r.price_avg, r.price_std, r.price_last) == pytest.approx((mean, std, own[0] if own else mean))


def test_ages(spark):
    months = spark.createDataFrame([(0, i) for i in range(2, 14)], "item_id int, month int")
    at = [3, 4, 8, 12]
    trades = spark.createDataFrame([(0, m, 2.0) for m in at], "item_id int, month int, cnt double")
    got = rows(panel.last_traded_age(months, trades, ["item_id"]).orderBy("month"), "month", "age")
    assert got == [(m, m - max(x for x in at if x < m) if min(at) < m else -10) for m in range(2, 14)]
    # as callers of old expect: between trades, from the trade before the last
    old = dict(rows(panel.last_traded_age(months, trades, ["item_id"], compat=True), "month", "age"))
    assert old == {2: -10, 3: -10, **{m: m - 3 for m in range(4, 8)}, **{m: m - 4 for m in range(8, 12)}, 12: 4, 13: 1}


def test_activity_split_and_lag(spark):
    df = spark.createDataFrame([(7, 2), (7, 6), (8, 4), (9, 5), (9, 9)], "item_id int, month int")
    for m in range(1, 11):
        assert sorted(r[0] for r in panel.active_in_month(df, "item_id", m).collect()) == [i for i, lo, hi in ((7, 2, 6), (8, 4, 4), (9, 5, 9)) if lo <= m <= hi]
    x = spark.createDataFrame([(4, 9, 20, 10), (4, 9, 20, 11), (5, 9, 20, 12), (4, 9, 18, 13)], "shop_id int, item_id int, month int, row_id int")
    assert sorted(rows(panel.time_split(x), "row_id", "part")) == [(10, "val"), (12, "val"), (13, "train")]
    data = panel_rows(5)
    count = {x[1:4]: x[4] for x in data}
    for r in panel.month_lag(spark.createDataFrame(data, PANEL), "cnt", 2).collect():
        assert r.cnt_lag2 == count.get((r.month - 2, r.shop_id, r.item_id), -10)
    d = spark.sql("select date'2013-12-31' d union all select date'2014-02-01'")
    assert sorted(r[0] for r in d.select(month_ordinal(F.col("d"), 2013)).collect()) == [11, 13]


def test_peaks(spark):
    r = np.random.default_rng(6)
    for _ in range(20):
        x = r.integers(-20, 20, 80).astype(float)
        at, height, width = signals.find_peaks(x, 5.0)
        want = []
        i = 1
        while i < len(x) - 1:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[i - 1] < x[i] > x[j + 1]:
                p = (i + j) // 2
                if min(x[p] - x[p - 1], x[p] - x[p + 1]) >= 5:
                    lo = max([k for k in range(p) if x[k] > x[p]], default=-1)
                    hi = min([k for k in range(p + 1, len(x)) if x[k] > x[p]], default=len(x))
                    want.append((p, x[p] - max(x[lo + 1 : p + 1].min(), x[p:hi].min())))
            i = j + 1
        assert list(zip(at.tolist(), height.tolist(), strict=True)) == want and (width > 0).all()


def test_corona(spark):
    v = [0, 2, 22, 1, -21, 0, 3, 1, 2, 30, 2, 1, 2, -9, 2]
    df = spark.createDataFrame([(4, i, float(x)) for i, x in enumerate(v)], "signal_id int, t int, value double")
    found = signals.peaks(df, 8.0).orderBy("t")
    assert rows(found, "t", "sign") == [(2, 1), (4, -1), (9, 1), (13, -1)]
    assert rows(signals.corona_pairs(found, distance=4, ratio=0.5), "start", "end") == [(2, 4)]
    out = [r[0] for r in rows(signals.remove_corona(df, threshold=8.0, distance=4, ratio=0.5, cleanup=2).orderBy("t"), "value")]
    assert out == pytest.approx([v[0], *np.linspace(2, 3, 5), *v[6:]])


def test_scale_difference_and_steps(spark):
    df = spark.createDataFrame([(0, 0, i, float(i * i)) for i in range(10)], "signal_id int, chunk int, t int, value double")
    assert [r[0] for r in rows(signals.scale_difference(df, 4).orderBy("t"), "diff")] == [None, None, 36.0]
    steps = signals.sliding_steps(df, 3, ["value"], order="t", keys=("signal_id",)).orderBy("t")
    assert steps.count() == 8 and steps.first().steps == [[0.0], [1.0], [4.0]]
    rolled = signals.rolled(df, [0, 1, 2], key="signal_id", pos="t", flip=True)
    assert rolled.count() == 60


def test_geometry(spark):
    v = spark.createDataFrame([(2.0, 1.0, 1.0, 2.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "px double, py double, pz double, qx double, qy double, qz double")
    out = v.select(*[c.alias(n) for c, n in zip(normal_component(vector("p"), vector("q")), "abc", strict=True)], *[c.alias(n) for c, n in zip(cross(vector("p"), vector("q")), "def", strict=True)]).collect()
    assert [round(x, 9) for x in out[0]] == [0, 1, 1, 0, 2, -2] and all(abs(x) < 1e-12 for x in out[1])
    methane = [("C", 0, 0, 0), ("H", 0.63, 0.63, 0.63), ("H", -0.63, -0.63, 0.63), ("H", -0.63, 0.63, -0.63), ("H", 0.63, -0.63, -0.63)]
    atoms = spark.createDataFrame([("m", i, a, float(x), float(y), float(z)) for i, (a, x, y, z) in enumerate(methane)], "mol string, ai int, atom string, x double, y double, z double")
    edges = molecules.both_ways(molecules.find_edges(atoms))
    assert sorted(rows(molecules.degree(edges), "ai", "degree")) == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 1)]
    assert rows(molecules.bond_composition(edges, atoms).where("ai = 0"), "composition") == [("C0F0H4N0O0",)]
    cos = molecules.angle_stats(edges).where("ai = 0").first()
    assert math.isclose(cos.cos_avg, -1 / 3, abs_tol=1e-9) and cos.cos_var < 1e-12
    pairs = spark.createDataFrame([(7, "m", 1, 2)], "id int, mol string, a0 int, a1 int")
    assert rows(molecules.shortest_paths(edges, pairs), "path") == [([1, 0, 2],)]
    assert sorted(rows(molecules.hop_neighbours(edges, atoms, 5).where("ai = 1"), "nbr", "hop")) == [(0, 1), (2, 2), (3, 2), (4, 2)]
    h = molecules.hull(atoms).first()
    assert math.isclose(h.volume, 8 * 0.63**3 / 3, rel_tol=1e-6)
    ring = spark.createDataFrame([("r", i, (i + 1) % 6, 1.5) for i in range(6)], "mol string, a0 int, a1 int, bond_type double")
    ring = ring.unionByName(ring.select("mol", F.col("a1").alias("a0"), F.col("a0").alias("a1"), "bond_type"))
    cycles = molecules.cycles(ring)
    assert [len(r.nodes) for r in cycles.collect()] == [6]
    assert molecules.aromatic_atoms(cycles, ring).count() == 6


def test_text(spark):
    df = spark.createDataFrame([(0, "Red ball-game (new)"), (1, "red car"), (2, "blue car")], "id int, name string")
    assert df.orderBy("id").select(tokens(F.lower("name"))).first()[0] == ["red", "ball", "game", "new"]
    w = text.tf_idf(df, key="id", text="name")
    assert all(math.isclose(r[0], 1) for r in w.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight"))).select(F.col("sum((weight * weight))")).collect())
    pool = df.select("id", F.lit(0).alias("b"))
    near = text.bucket_neighbours(w, pool, pool, key="id", buckets=["b"], k=2)
    assert {(r.id, r.nbr) for r in near.where("rank = 1").collect()} == {(0, 1), (1, 2), (2, 1)}
    sums = text.neighbour_weights(near, keys=["b", "id"]).groupBy("id").agg(F.sum("weight").alias("s")).collect()
    assert all(r.s is None or math.isclose(r.s, 1) for r in sums)


def rows_made(node):
    """Rows that each step of an executed plan gave."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return rows_made(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return rows_made(node.plan())
    metric, children = node.metrics().get("numOutputRows"), node.children()
    return ([metric.get().value()] if metric.isDefined() else []) + [n for i in range(children.size()) for n in rows_made(children.apply(i))]


def test_neighbours_of_equal_texts(spark):
    """Equal texts meet as one class, not pair by pair; the rows are those of all pairs."""
    r = np.random.default_rng(3)
    data = [(i, int(r.integers(3)), " ".join(r.choice(["red", "old", "new", "car", "rod"], int(r.integers(0, 4)))) + f" x{i}" * int(r.integers(2))) for i in range(90)] + [(90, 3, "lone"), (91, 3, "odd"), (92, 4, "self")]
    df = spark.createDataFrame(data, "id int, b int, name string")
    w = text.tf_idf(df, key="id", text="name")
    vec, bucket = {}, {i: b for i, b, _ in data}
    for x in w.collect():
        vec.setdefault(x.id, {})[x.term] = x.weight
    got = {}
    for x in text.bucket_neighbours(w, df.where("id % 2 = 0"), df.where("id % 3 > 0 or id > 89"), key="id", buckets=["b"], k=3).collect():
        got.setdefault(x.id, []).append((x.rank, x.nbr, x.distance))
    for i, v in vec.items():
        if i % 2 == 0:
            want = sorted((round(math.sqrt(max(0, 2 - 2 * sum(c * vec[j].get(t, 0) for t, c in v.items()))), 6), j) for j in vec if j != i and bucket[j] == bucket[i] and (j % 3 or j > 89))[:3]
            assert [round(x[2], 6) for x in sorted(got.pop(i, []))] == [x[0] for x in want]
    assert not got

    same = spark.range(4000).select("id", F.lit(0).alias("b"), F.lit("hot bolt").alias("name"))
    near = text.bucket_neighbours(text.tf_idf(same, key="id", text="name"), same, same, key="id", buckets=["b"], k=3)
    assert len(near.collect()) == 12000
    assert max(rows_made(near._jdf.queryExecution().executedPlan())) < 100_000  # all pairs are 16 million


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.6)], "y int, s double")
    got = {r.threshold: r.mcc for r in evaluation.mcc_by_threshold(df, "y", "s", [0.5, 0.7]).collect()}
    assert math.isclose(got[0.7], 1.0) and math.isclose(got[0.5], 1 / math.sqrt(3))
    grid = [(i / 99, 0.8 if i == 10 else 0.75 if i == 55 else 0.6) for i in range(100)]
    assert evaluation.walk_thresholds(grid, 0.0) == grid[10][0]
    b = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, 2.0, 0.0)], "t double, a double, b double")
    assert evaluation.best_blend(b, "t", "a", "b").first().alpha == 1.0
    p = spark.range(200).withColumn("row_id", F.col("id")).withColumn("v", F.col("id"))
    shuffled = evaluation.permuted(p, "v")
    assert sorted(r.v for r in shuffled.collect()) == list(range(200)) and shuffled.where("v <> id").count() > 100


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 5.0), (1, None, 7.0), (1, "a", 9.0)], "a int, b string, c double")
    assert frames.constant_columns(df) == ["a"]
    z = [r.c for r in frames.standardise(df, ["c"]).orderBy("c").collect()]
    assert math.isclose(sum(z), 0, abs_tol=1e-12) and math.isclose(float(np.std(z)), 1)
    a, b = frames.one_hot(df, df, ["b"])
    assert a.columns == b.columns == ["a", "c", "b_a"]
    x = spark.createDataFrame([("r", "q", 1.0)], "a0 string, a1 string, x double")
    assert sorted(rows(frames.symmetric(x, "a0", "a1", ["x"]), "a0", "a1", "x")) == [("q", "r", -1.0), ("r", "q", 1.0)]


def test_sources(spark, tmp_path):
    from millrace.sources import tables

    df = spark.createDataFrame([(i, f"a{i % 3}", i / 2) for i in range(50)], "k int, name string, v double")
    tables.write_csv(df, f"{tmp_path}/c")
    back = tables.csv(spark, f"{tmp_path}/c", "k int, name string, v double", parts=3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect())) and back.rdd.getNumPartitions() == 3
    tables.write(df, f"{tmp_path}/p", by=["name"])
    tables.append(df, f"{tmp_path}/p", by=["name"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 100
    tables.write(df, tables.keyed_store(f"{tmp_path}/store", "x"))
    assert tables.keyed(spark, f"{tmp_path}/store", "x").count() == 50
    (tmp_path / "t").mkdir()
    for f in range(3):
        (tmp_path / "t" / f"{f}.txt").write_text("".join(f"{f} {i}\n" for i in range(200)))
    got = tables.lines(spark, f"{tmp_path}/t").collect()
    assert len(got) == 600 and all(r.value == f"{r.file[-5]} {r.line_no}" for r in got)
    assert [r.pos for r in tables.numbered(df.repartition(4), first=1).orderBy("pos").collect()] == list(range(1, 51))
    wide = spark.createDataFrame([(t, t * 1.0, t * 2.0, t * 3.0) for t in range(4)], "t int, `0` double, `1` double, `2` double")
    wide.write.parquet(f"{tmp_path}/w")
    long = tables.wide_signals(spark, f"{tmp_path}/w", ["0", "2"])
    assert sorted(map(tuple, long.collect())) == sorted((s, t, t * (s + 1.0)) for t in range(4) for s in (0, 2))


def test_models(spark, tmp_path):
    r = np.random.default_rng(7)
    x = r.standard_normal((120, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(2 * a), float(b - 1), "k" if i % 2 else "m") for i, (a, b) in enumerate(x)], "row_id int, a double, b double, y1 double, y2 double, kind string")
    models = evaluation.fit_contributions(df, ["a", "b"], ["y1", "y2"])
    out = evaluation.summed_contributions(models, df, ["a", "b"]).collect()
    assert all(abs(r.prediction - (2 * r.a + r.b - 1)) < 1e-4 for r in out)
    evaluation.save_model(models["y1"], f"{tmp_path}/m")
    assert np.allclose(evaluation.load_model(f"{tmp_path}/m").coefficients.toArray(), models["y1"].coefficients.toArray())
    assert evaluation.drop_unhelpful(df, ["a", "b", "kind"], lambda _, cs: 1.0 * ("a" in cs) + 0.5 * ("b" in cs)) == ["a", "b"]
    trees = evaluation.fit_by_type(df, "kind", ["a", "b"], "y1", maxIter=2)
    assert set(trees) == {"k", "m"}
    assert evaluation.adversarial_auc(df.where("a < 0"), df.where("a >= 0"), ["a"], maxIter=2) > 0.9
    assert evaluation.rolling_origin(df.withColumn("month", F.col("row_id") % 6), [2, 3], lambda a, b: float(a.count() - b.count())) == [(2, 20.0), (3, 40.0)]
    said = []
    assert evaluation.timed("step", said.append)(lambda: 5)() == 5 and said[0].startswith("step: ")
    cells = spark.createDataFrame([(i, j, 9.0 if (i < 4) == (j < 3) else 0.1) for i in range(8) for j in range(6)], "i int, j int, v double")
    left, right = evaluation.biclusters(cells, "i", "j", "v", 2)
    assert left[0] == left[3] != left[4] == left[7] and right[0] == right[2] == left[0] and right[3] == left[4]


def test_frames_with_errors(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 7.0), (3, None)], "k int, v double")
    with pytest.raises(Exception, match="out of range"):
        frames.checked(df, "v", 0, 10).collect()
    with pytest.raises(ValueError, match="missing"):
        frames.without(df, ["x"])
    many = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    assert [r.n for r in frames.numbered(many, ["x"], "n").orderBy("x").collect()] == list(range(1000))
    steps = spark.range(60).select(F.col("id").alias("t"), (F.col("id") * 1.0).alias("v"))
    got = signals.sliding_steps(steps, 4, ["v"], order="t", block=7).orderBy("t").collect()
    assert [(r.t, [x[0] for x in r.steps]) for r in got] == [(t, [float(t - 3 + i) for i in range(4)]) for t in range(3, 60)]


def test_rings_and_bond_codes(spark):
    ring = [(0, i, (i + 1) % 6, 1.5) for i in range(6)]
    e = spark.createDataFrame(ring + [(m, b, a, t) for m, a, b, t in ring], "mol long, a0 long, a1 long, bond_type double")
    found = molecules.aromatic_atoms(molecules.cycles(e), e)
    assert sorted((r.ai, r.rings) for r in found.collect()) == [(i, 1) for i in range(6)]
    code = spark.range(1).select(*[molecules.bond_code(F.lit(a), F.lit(b)).alias(a + b) for a in "CFHNO" for b in "CFHNO" if a <= b]).first()
    assert list(code) == list(range(15))
