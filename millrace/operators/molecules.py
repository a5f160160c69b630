"""Spatial graphs: atoms (mol, ai, atom, x, y, z), edges (mol, a0, a1, ...) and target pairs (id, mol, a0, a1).

Every join is an equi join inside a molecule, so all of an operator's work stays with the
molecule's partition and molecules are small.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import cosine, cross, dot, norm, vector
from .frames import symmetric

# Element, electronegativity, outer electrons, free pairs, free pairs as weights of donation, mass.
ELEMENTS = [
    ("H", 2.1, 1, 0, 0.0, 1.0),
    ("O", 3.44, 6, 2, 0.8, 16.0),
    ("C", 2.55, 4, 0, 0.0, 12.0),
    ("N", 3.04, 5, 1, 1.0, 14.0),
    ("F", 3.98, 7, 3, 0.5, 19.0),
]

# Element, element, bond order, standard length, standard energy.
BONDS = [
    ("H", "C", 1.0, 1.09, 413.0),
    ("H", "H", 1.0, 0.74, 436.0),
    ("H", "N", 1.0, 1.01, 391.0),
    ("H", "O", 1.0, 0.96, 459.0),
    ("H", "F", 1.0, 0.92, 565.0),
    ("C", "N", 1.0, 1.47, 308.0),
    ("C", "N", 1.0, 1.39, 350.0),
    ("C", "N", 1.5, 1.37, 450.0),
    ("C", "N", 1.5, 1.33, 450.0),
    ("C", "N", 2.0, 1.27, 615.0),
    ("C", "N", 3.0, 1.16, 887.0),
    ("C", "F", 1.0, 1.35, 205.0),
    ("C", "O", 1.0, 1.47, 360.0),
    ("C", "O", 1.0, 1.43, 360.0),
    ("C", "O", 1.0, 1.36, 360.0),
    ("C", "O", 1.5, 1.28, 650.0),
    ("C", "O", 2.0, 1.23, 799.0),
    ("C", "O", 2.0, 1.16, 1072.0),
    ("C", "C", 1.0, 1.54, 348.0),
    ("C", "C", 1.5, 1.39, 518.0),
    ("C", "C", 2.0, 1.34, 614.0),
    ("C", "C", 3.0, 1.2, 839.0),
    ("N", "O", 1.0, 1.4, 201.0),
    ("N", "O", 1.5, 1.25, 451.0),
    ("N", "O", 2.0, 1.21, 607.0),
    ("N", "N", 1.0, 1.45, 167.0),
    ("N", "N", 1.5, 1.32, 340.0),
    ("N", "N", 2.0, 1.25, 418.0),
    ("N", "N", 3.0, 1.1, 942.0),
    ("N", "F", 1.0, 1.36, 283.0),
    ("O", "O", 1.0, 1.48, 142.0),
    ("O", "O", 2.0, 1.21, 494.0),
    ("O", "F", 1.0, 1.42, 190.0),
    ("F", "F", 1.0, 1.42, 155.0),
]


def element_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ELEMENTS, "atom string, en double, valence int, lone_pair int, donor double, mass double")


def bond_table(spark: SparkSession) -> DataFrame:
    """Standard bonds both ways round, with the difference of electronegativity."""
    df = spark.createDataFrame(BONDS, "atom0 string, atom1 string, bond_type double, standard_length double, standard_energy double")
    both = symmetric(df, "atom0", "atom1").distinct()
    en = {e[0]: e[1] for e in ELEMENTS}
    of = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in en.items() for x in kv]), c)
    return both.withColumn("en_diff", of(F.col("atom1")) - of(F.col("atom0")))


def lengths_by_pair(spark: SparkSession) -> DataFrame:
    """(atom0, atom1, options): the standard lengths of each ordered pair of elements with their orders."""
    return bond_table(spark).groupBy("atom0", "atom1").agg(F.collect_list(F.struct("standard_length", "bond_type")).alias("options"))


def with_ends(pairs: DataFrame, atoms: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of both end atoms, with suffixes 0 and 1."""
    for e in "01":
        side = atoms.select("mol", F.col("ai").alias(f"a{e}"), *[F.col(c).alias(f"{c}{e}") for c in columns])
        pairs = pairs.join(side, ["mol", f"a{e}"], "left")
    return pairs


def pairs_of(atoms: DataFrame) -> DataFrame:
    """All ordered pairs of different atoms of a molecule, with their distance."""
    a = atoms.select("mol", *[F.col(c).alias(f"{c}0") for c in ("ai", "atom", "x", "y", "z")]).withColumnRenamed("ai0", "a0")
    b = atoms.select("mol", *[F.col(c).alias(f"{c}1") for c in ("ai", "atom", "x", "y", "z")]).withColumnRenamed("ai1", "a1")
    return a.join(b, "mol").where("a0 <> a1").withColumn("distance", norm([F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]))


def find_edges(atoms: DataFrame, factor: float = 1.1) -> DataFrame:
    """Edges (a0 < a1): the nearest standard length of the two elements, kept if the distance is within ``factor`` of it.

    The lengths of an element pair come as one array with a broadcast row, so that the choice is
    an expression and no aggregate over the pairs.
    """
    near = pairs_of(atoms).where("a0 < a1").join(F.broadcast(lengths_by_pair(atoms.sparkSession)), ["atom0", "atom1"])
    off = F.transform("options", lambda o: F.struct(F.abs(F.col("distance") - o["standard_length"]).alias("off"), o["bond_type"].alias("bond_type"), o["standard_length"].alias("length")))
    found = near.withColumn("_best", F.array_min(off)).where(F.col("distance") <= F.col("_best.length") * factor)
    unit = [F.try_divide(F.col(f"{c}1") - F.col(f"{c}0"), F.col("distance")).alias(c) for c in "xyz"]
    return found.select("mol", "a0", "a1", "distance", F.col("_best.bond_type").alias("bond_type"), *unit)


def both_ways(edges: DataFrame) -> DataFrame:
    return symmetric(edges, "a0", "a1", ["x", "y", "z"])


def hop_neighbours(edges: DataFrame, starts: DataFrame, hops: int = 5) -> DataFrame:
    """(mol, ai, nbr, hop): atoms at shortest distance 1..hops; frontier joins without what was visited."""
    step = edges.select("mol", F.col("a0").alias("nbr"), F.col("a1").alias("to"))
    front = starts.select("mol", "ai", F.col("ai").alias("nbr")).distinct()
    seen, out = front, None
    for k in range(1, hops + 1):
        front = front.join(step, ["mol", "nbr"]).select("mol", "ai", F.col("to").alias("nbr")).distinct().join(seen, ["mol", "ai", "nbr"], "left_anti")
        got = front.withColumn("hop", F.lit(k))
        out, seen = got if out is None else out.unionByName(got), seen.unionByName(front)
    return out


def shortest_paths(edges: DataFrame, pairs: DataFrame, longest: int = 10) -> DataFrame:
    """(id, path): the shortest path of up to ``longest`` nodes, of equal ones the least in order of nodes. A grouped map over one molecule."""

    def one(key: tuple, e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(e.a0, e.a1, strict=True):
            near.setdefault(int(a), []).append(int(b))
        for v in near.values():
            v.sort()
        out = []
        for row in p.itertuples():
            paths, seen, found = [[int(row.a0)]], {int(row.a0)}, None
            while paths and found is None and len(paths[0]) < longest:
                longer = []
                for path in paths:
                    for n in near.get(path[-1], []):
                        if n == row.a1 and found is None:
                            found = [*path, n]
                        if n not in seen:
                            seen.add(n)
                            longer.append([*path, n])
                paths = longer
            if found:
                out.append((row.id, found))
        return pd.DataFrame(out, columns=["id", "path"])

    return edges.groupBy("mol").cogroup(pairs.select("id", "mol", "a0", "a1").groupBy("mol")).applyInPandas(one, f"id {pairs.schema['id'].dataType.simpleString()}, path array<int>")


def cycles(edges: DataFrame, longest: int = 10) -> DataFrame:
    """(mol, nodes): simple cycles found depth first from the least node, one for each set of nodes. A grouped map over one molecule."""
    kind = edges.schema["mol"].dataType.simpleString()

    def one(e: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(e.a0, e.a1, strict=True):
            near.setdefault(int(a), []).append(int(b))
        found: dict[frozenset[int], list[int]] = {}
        for root in sorted(near):
            stack = [[root]]
            while stack:
                path = stack.pop()
                for n in sorted(near[path[-1]], reverse=True):
                    if n == root and len(path) > 2:
                        found.setdefault(frozenset(path), path)
                    elif n > root and n not in path and len(path) < longest:
                        stack.append([*path, n])
        return pd.DataFrame([(e.mol.iloc[0], p) for p in found.values()], columns=["mol", "nodes"])

    return edges.groupBy("mol").applyInPandas(one, f"mol {kind}, nodes array<int>")


def cycle_features(pairs: DataFrame, rings: DataFrame, paths: DataFrame, *, default: float = 100.0) -> DataFrame:
    """Mean ring length of the molecule, and whether the ends' neighbours along the path are in a ring; without a path they aren't."""
    mean = rings.groupBy("mol").agg(F.avg(F.size("nodes")).alias("ring_mean"), F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("_in"))
    out = pairs.join(mean, "mol", "left").join(paths.select("id", F.get("path", 1).alias("_n0"), F.get("path", F.size("path") - 2).alias("_n1")), "id", "left")
    inside = lambda c: F.coalesce(F.array_contains("_in", F.col(c)), F.lit(False))
    return out.withColumns({"ring_mean": F.coalesce("ring_mean", F.lit(default)), "near_ring0": inside("_n0"), "near_ring1": inside("_n1")}).drop("_in", "_n0", "_n1")


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("mol", F.col("a0").alias("ai")).agg(F.count("*").alias("degree"))


def neighbour_features(pairs: DataFrame, edges: DataFrame, atoms: DataFrame, end: int) -> DataFrame:
    """Over the bonds of one end (without the other end): electronegativity vectors along and across the pair, lengths, angles, pairs of free electrons.

    ``edges`` go both ways; ``pairs`` have (id, mol, a0, a1). Across is the norm of the sum less its part along.
    """
    at, other = f"a{end}", f"a{1 - end}"
    el = F.broadcast(element_table(atoms.sparkSession).select("atom", "en", F.col("donor").alias("lone_pair")))
    facts = atoms.join(el, "atom", "left").select("mol", "ai", "x", "y", "z", "en", "lone_pair")
    axis = with_ends(pairs.select("id", "mol", "a0", "a1"), facts, ["x", "y", "z", "en"])
    length = norm([F.col(f"{c}{1 - end}") - F.col(f"{c}{end}") for c in "xyz"])
    axis = axis.select("id", "mol", at, other, F.col(f"en{end}").alias("en_at"), *[F.try_divide(F.col(f"{c}{1 - end}") - F.col(f"{c}{end}"), length).alias(f"u{c}") for c in "xyz"])
    bonds = edges.select("mol", F.col("a0").alias(at), F.col("a1").alias("nbr"), "distance", "x", "y", "z")
    near = axis.join(bonds, ["mol", at]).where(F.col("nbr") != F.col(other)).join(facts.select("mol", F.col("ai").alias("nbr"), F.col("en").alias("en_nbr"), "lone_pair"), ["mol", "nbr"], "left")
    cos = cosine(vector(""), vector("u"))
    pull = F.col("en_nbr") - F.col("en_at")
    near = near.withColumns({"_cos": cos, "_pull": pull})
    sums = near.groupBy("id").agg(
        *[F.sum(F.col("en_nbr") * F.col(c)).alias(f"s{c}") for c in "xyz"], *[F.first(f"u{c}").alias(f"u{c}") for c in "xyz"],
        F.sum("_pull").alias("en_diff"), F.sum("lone_pair").alias("lone_pairs"), F.min("distance").alias("d_min"), F.max("distance").alias("d_max"), F.avg("distance").alias("d_mean"), F.coalesce(F.stddev_samp("distance"), F.lit(0.0)).alias("d_std"),
        F.min("_cos").alias("cos_min"), F.max("_cos").alias("cos_max"), F.avg("_cos").alias("cos_mean"), F.coalesce(F.stddev_samp("_cos"), F.lit(0.0)).alias("cos_std"),
    )
    along = dot(vector("s"), vector("u"))
    sums = sums.withColumns({"along": along, "across": norm(vector("s")) - F.abs(along)}).drop(*[f"{p}{c}" for p in "su" for c in "xyz"])
    zero, none = ["along", "across", "en_diff", "lone_pairs"], ["d_min", "d_max", "d_mean", "d_std", "cos_min", "cos_max", "cos_mean", "cos_std"]
    out = pairs.select("id").join(sums, "id", "left").fillna(0, zero).fillna(-10.0, none)
    return out.select("id", *[F.col(c).alias(f"{c}_{end}") for c in zero + none])


def partial_charge(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Sums over an atom's bonds of the electronegativity difference by distance, and by its fourth power."""
    el = F.broadcast(element_table(atoms.sparkSession).select("atom", "en"))
    e = with_ends(edges, atoms.join(el, "atom", "left"), ["en"])
    diff = F.col("en0") - F.col("en1")
    return e.groupBy("mol", F.col("a0").alias("ai")).agg(F.sum(F.try_divide(diff, F.col("distance"))).alias("q"), F.sum(F.try_divide(diff, F.pow("distance", F.lit(4.0)))).alias("q4"))


def potentials(atoms: DataFrame, charges: DataFrame) -> DataFrame:
    """Coulomb and Yukawa sums of each atom over the molecule's other atoms."""
    p = pairs_of(atoms).select("mol", "a0", "a1", "distance")
    q = charges.select("mol", "ai", "q")
    p = p.join(q.select("mol", F.col("ai").alias("a0"), F.col("q").alias("q0")), ["mol", "a0"]).join(q.select("mol", F.col("ai").alias("a1"), F.col("q").alias("q1")), ["mol", "a1"])
    c = F.try_divide(F.col("q0") * F.col("q1"), F.col("distance"))
    return p.groupBy("mol", F.col("a0").alias("ai")).agg(F.sum(c).alias("coulomb"), F.sum(c * F.exp(-F.col("distance"))).alias("yukawa"))


def induced_vector(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Sum over bonds of unit vector times electronegativity difference by distance, and its norm."""
    el = F.broadcast(element_table(atoms.sparkSession).select("atom", "en"))
    e = with_ends(edges, atoms.join(el, "atom", "left"), ["en"])
    w = F.try_divide(F.col("en1") - F.col("en0"), F.col("distance"))
    out = e.groupBy("mol", F.col("a0").alias("ai")).agg(*[F.sum(F.col(c) * w).alias(f"i{c}") for c in "xyz"])
    return out.withColumn("induced", norm(vector("i")))


def hetero_within(edges: DataFrame, atoms: DataFrame, k: int) -> DataFrame:
    """Atoms other than C and H reached by exactly k steps of adjacency, those of k-2 steps (1 for k = 2, 3) and the atom itself left out."""
    step = edges.select("mol", F.col("a0").alias("nbr"), F.col("a1").alias("to"))
    power = {1: edges.select("mol", F.col("a0").alias("ai"), F.col("a1").alias("nbr")).distinct()}
    for i in range(2, k + 1):
        power[i] = power[i - 1].join(step, ["mol", "nbr"]).select("mol", "ai", F.col("to").alias("nbr")).distinct()
    left = power[k].where("ai <> nbr").join(power[max(1, k - 2)], ["mol", "ai", "nbr"], "left_anti")
    hetero = atoms.where(~F.col("atom").isin("C", "H")).select("mol", F.col("ai").alias("nbr"))
    return left.join(hetero, ["mol", "nbr"]).groupBy("mol", "ai").agg(F.count("*").alias(f"hetero_{k}"))


def bond_composition(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Counts of neighbours by element as one text, such as C1F0H3N0O0."""
    near = edges.join(atoms.select("mol", F.col("ai").alias("a1"), "atom"), ["mol", "a1"])
    counts = near.groupBy("mol", F.col("a0").alias("ai")).agg(*[F.count_if(F.col("atom") == a).alias(a) for a in "CFHNO"])
    return counts.select("mol", "ai", F.format_string("C%dF%dH%dN%dO%d", *"CFHNO").alias("composition"))


def conical_regions(pairs: DataFrame, atoms: DataFrame, *, cutoff: float = 6.0, prop: str = "en") -> DataFrame:
    """Sums of a property by squared distance from the pair's middle, in seven regions by ``int(4 cos)`` to its axis."""
    facts = atoms.join(F.broadcast(element_table(atoms.sparkSession)), "atom", "left")
    p = with_ends(pairs.select("id", "mol", "a0", "a1"), facts, ["x", "y", "z"])
    o = facts.select("mol", F.col("ai").alias("ao"), *[F.col(c).alias(f"o{c}") for c in "xyz"], prop)
    all_ = p.join(o, "mol").where("ao <> a0 and ao <> a1")
    off = [F.col(f"o{c}") - (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xyz"]
    axis = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    all_ = all_.withColumns({"_d": norm(off), "_bin": (cosine(off, axis) * 4).cast("int")}).where(F.col("_d") <= cutoff)
    w = F.try_divide(F.col(prop).cast("double"), F.col("_d") * F.col("_d"))
    regions = all_.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.col("_bin") == b, w)), F.lit(0.0)).alias(f"region_{b + 3}") for b in range(-3, 4)])
    return pairs.select("id").join(regions, "id", "left").fillna(0.0)


def bands(atoms: DataFrame, limits: tuple[float, ...] = (0.0, 2.0, 5.0)) -> DataFrame:
    """Counts and sums of valence and free pairs of atoms in distance bands."""
    el = F.broadcast(element_table(atoms.sparkSession).select(F.col("atom").alias("atom1"), "valence", "lone_pair"))
    p = pairs_of(atoms).join(el, "atom1", "left")
    aggs = []
    for lo, hi in zip(limits, limits[1:], strict=False):
        inside = (F.col("distance") >= lo) & (F.col("distance") < hi)
        n = f"{lo:g}_{hi:g}"
        aggs += [F.count_if(inside).alias(f"n_{n}"), *[F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(f"{c}_{n}") for c in ("valence", "lone_pair")]]
    return p.groupBy("mol", F.col("a0").alias("ai")).agg(*aggs)


def nearest_atoms(atoms: DataFrame, k: int = 3) -> DataFrame:
    """Inverse distances of the k nearest atoms, farthest first, 0 where there are fewer; and the cosines between them."""
    r = F.row_number().over(W.partitionBy("mol", "a0").orderBy("distance", "a1"))
    near = pairs_of(atoms).withColumn("r", r).where(F.col("r") <= k)
    wide = near.groupBy("mol", F.col("a0").alias("ai")).pivot("r", list(range(1, k + 1))).agg(F.first(F.try_divide(F.lit(1.0), F.col("distance"))))
    for i in range(1, k + 1):
        wide = wide.withColumnRenamed(str(i), f"inv_{k - i}")
    off = lambda e: near.select("mol", "a0", F.col("r").alias(f"r{e}"), *[(F.col(f"{c}1") - F.col(f"{c}0")).alias(f"{e}{c}") for c in "xyz"])
    both = off("p").join(off("q"), ["mol", "a0"]).where("rp < rq").withColumn("_cos", cosine(vector("p"), vector("q")))
    cos = both.groupBy("mol", F.col("a0").alias("ai")).agg(*[F.max(F.when((F.col("rp") == i) & (F.col("rq") == j), F.col("_cos"))).alias(f"cos_{i}{j}") for i in range(1, k + 1) for j in range(i + 1, k + 1)])
    return wide.join(cos, ["mol", "ai"], "left").fillna(0.0)


def molecule_shape(atoms: DataFrame) -> DataFrame:
    """Element counts, unsaturation (and its share; -10 without carbon), ranges, order statistics and ratios of the axes."""
    count = [F.count_if(F.col("atom") == a).alias(f"n_{a}") for a in "CFHNO"]
    axis = []
    for c in "xyz":
        axis += [(F.max(c) - F.min(c)).alias(f"range_{c}"), F.min(c).alias(f"min_{c}"), (F.percentile(c, F.lit(0.1)) - F.min(c)).alias(f"q10_{c}"), (F.percentile(c, F.lit(0.5)) - F.min(c)).alias(f"q50_{c}"), F.avg(c).alias(f"mid_{c}")]
    out = atoms.groupBy("mol").agg(F.count("*").alias("n_atoms"), *count, *axis)
    free = (2 * F.col("n_C") + 2 + F.col("n_N") - F.col("n_F") - F.col("n_H")) / 2
    ranges = [F.col(f"range_{c}") for c in "xyz"]
    return out.withColumns({"unsaturation": F.when(F.col("n_C") > 0, free).otherwise(-10.0), "unsaturation_share": F.when(F.col("n_C") > 0, free / F.col("n_C")).otherwise(-10.0), "flatness": F.try_divide(F.least(*ranges), F.greatest(*ranges))})


def hull(atoms: DataFrame) -> DataFrame:
    """Volume and area of each molecule's convex hull, both 0 where it has none. A grouped map: brute force over triples of few atoms."""
    from itertools import combinations

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "z"]].to_numpy(float)
        volume = area = 0.0
        mid = p.mean(axis=0)
        flat: dict[tuple, list[np.ndarray]] = {}
        for i, j, k in combinations(range(len(p)), 3):
            n = np.cross(p[j] - p[i], p[k] - p[i])
            size = np.linalg.norm(n)
            if size < 1e-12:
                continue
            n = n / size
            side = (p - p[i]) @ n
            if side.max() > 1e-9 and side.min() < -1e-9:
                continue
            n = -n if side.max() > 1e-9 else n
            flat[tuple(np.round([*n, n @ p[i]], 6))] = [n, p[np.abs(side) <= 1e-9]]
        if len(flat) > 3:
            for n, q in flat.values():
                c = q.mean(axis=0)
                u = (q[0] - c) / max(np.linalg.norm(q[0] - c), 1e-12)
                v = np.cross(n, u)
                order = np.argsort(np.arctan2((q - c) @ v, (q - c) @ u))
                ring = q[order]
                s = sum(np.linalg.norm(np.cross(ring[t] - c, ring[(t + 1) % len(ring)] - c)) / 2 for t in range(len(ring)))
                area += s
                volume += s * abs((c - mid) @ n) / 3
        return pd.DataFrame({"mol": [pdf["mol"].iloc[0]], "volume": [volume], "area": [area]})

    return atoms.groupBy("mol").applyInPandas(one, f"mol {atoms.schema['mol'].dataType.simpleString()}, volume double, area double")


def centre_features(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """Distance of both ends and of the middle from the molecule's centre; place of the middle in the box, 100 where it is flat."""
    box = atoms.groupBy("mol").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.avg, "m"), (F.min, "lo"), (F.max, "hi"))])
    p = with_ends(pairs.select("id", "mol", "a0", "a1"), atoms, ["x", "y", "z"]).join(box, "mol")
    mid = [(F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xyz"]
    centre = [F.col(f"m_{c}") for c in "xyz"]
    far = lambda v: norm([a - b for a, b in zip(v, centre, strict=True)])
    box_share = [F.coalesce(F.abs(F.try_divide(m - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")) - 0.5), F.lit(100.0)).alias(f"box_{c}") for m, c in zip(mid, "xyz", strict=True)]
    return p.select("id", far([F.col(f"{c}0") for c in "xyz"]).alias("centre0"), far([F.col(f"{c}1") for c in "xyz"]).alias("centre1"), far(mid).alias("centre_mid"), *box_share)


def angle_stats(edges: DataFrame) -> DataFrame:
    """Mean, population variance, least and greatest cosine between each two bonds of an atom."""
    b = edges.select("mol", F.col("a0").alias("ai"), F.col("a1").alias("p"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    c = edges.select("mol", F.col("a0").alias("ai"), F.col("a1").alias("q"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    both = b.join(c, ["mol", "ai"]).where("p < q").withColumn("_cos", cosine(vector("p"), vector("q")))
    return both.groupBy("mol", "ai").agg(F.avg("_cos").alias("cos_avg"), F.var_pop("_cos").alias("cos_var"), F.min("_cos").alias("cos_min"), F.max("_cos").alias("cos_max"))


def path_angles(paths: DataFrame, pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """Cosines at the first and last inner node, dihedral cosine (the first angle for 3-node paths), their double-angle forms; -10 where there is none."""
    named = pairs.select("id", "mol").join(paths.withColumn("n", F.size("path")), "id")
    spots = {"p": F.get("path", 0), "q": F.get("path", 1), "r": F.get("path", F.col("n") - 2), "s": F.get("path", F.col("n") - 1)}
    for k, at in spots.items():
        named = named.withColumn(f"{k}i", at).join(atoms.select("mol", F.col("ai").alias(f"{k}i"), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), ["mol", f"{k}i"], "left")
    line = lambda a, b: [F.col(f"{b}{c}") - F.col(f"{a}{c}") for c in "xyz"]
    first, last = cosine(line("q", "p"), line("q", "s") if False else line("q", "r")), cosine(line("r", "s"), line("r", "q"))
    three = cosine(line("q", "p"), line("q", "s"))
    plane = cosine(cross(line("p", "q"), line("q", "r")), cross(line("q", "r"), line("r", "s")))
    a1 = F.when(F.col("n") == 3, three).when(F.col("n") > 3, first)
    a2 = F.when(F.col("n") == 3, three).when(F.col("n") > 3, last)
    di = F.when(F.col("n") == 3, three).when(F.col("n") > 3, plane)
    out = named.select("id", (F.col("n") - 2).alias("inner"), a1.alias("angle_1"), a2.alias("angle_2"), di.alias("dihedral"))
    out = out.withColumns({f"{c}_double": 2 * F.col(c) * F.col(c) - 1 for c in ("angle_1", "angle_2", "dihedral")})
    return out.fillna(-10.0)


def pi_donor(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """For each atom: electronegativity differences and free pairs of its non-hydrogen bonds, pairs weighted 1, 1/2, 2 by bond order 1, 1.5, 2."""
    el = F.broadcast(element_table(atoms.sparkSession).select("atom", "en", F.col("donor").alias("lone_pair")))
    e = with_ends(edges, atoms.join(el, "atom", "left"), ["atom", "en", "lone_pair"]).where("atom1 <> 'H'")
    w = F.when(F.col("bond_type") == 1.5, 0.5).when(F.col("bond_type") >= 2, 2.0).otherwise(1.0)
    return e.groupBy("mol", F.col("a0").alias("ai")).agg(F.sum(F.col("en1") - F.col("en0")).alias("pi_en"), F.sum(F.col("lone_pair1") * w).alias("pi_pairs"))


def offset_neighbours(pairs: DataFrame, atoms: DataFrame, offsets: tuple[int, ...] = (-3, -2, -1, 1, 2, 3)) -> DataFrame:
    """Atoms by place in the molecule's list around each end: mean distance, counts of H and C."""
    p = with_ends(pairs.select("id", "mol", "a0", "a1"), atoms, ["x", "y", "z"])
    p = p.withColumn("_off", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("ao", F.col("a0") + F.col("_off"))
    o = atoms.select("mol", F.col("ai").alias("ao"), "atom", *[F.col(c).alias(f"o{c}") for c in "xyz"])
    d = norm([F.col(f"o{c}") - F.col(f"{c}0") for c in "xyz"])
    got = p.join(o, ["mol", "ao"]).groupBy("id").agg(F.avg(d).alias("near_mean"), F.count_if(F.col("atom") == "H").alias("near_H"), F.count_if(F.col("atom") == "C").alias("near_C"))
    return pairs.select("id").join(got, "id", "left").fillna(100.0, ["near_mean"]).fillna(0)


def length_neighbours(pairs: DataFrame, atoms: DataFrame, end: int, factor: float = 1.05) -> DataFrame:
    """Other atoms within ``factor`` of a standard bond length of one end: count, bond orders and electronegativity differences."""
    el = F.broadcast(element_table(atoms.sparkSession).select("atom", "en"))
    near = pairs_of(atoms).join(F.broadcast(bond_table(atoms.sparkSession)), ["atom0", "atom1"]).where(F.col("distance") <= F.col("standard_length") * factor)
    near = near.drop("en_diff").join(el.select(F.col("atom").alias("atom0"), F.col("en").alias("en0")), "atom0").join(el.select(F.col("atom").alias("atom1"), F.col("en").alias("en1")), "atom1")
    near = near.select("mol", F.col("a0").alias(f"a{end}"), F.col("a1").alias("nbr"), "bond_type", (F.col("en1") - F.col("en0")).alias("d"))
    got = pairs.select("id", "mol", "a0", "a1").join(near, ["mol", f"a{end}"]).where("nbr <> a0 and nbr <> a1")
    agg = got.groupBy("id").agg(F.count_distinct("nbr").alias(f"nbrs_{end}"), F.max("bond_type").alias(f"order_max_{end}"), F.avg("bond_type").alias(f"order_mean_{end}"), F.max("d").alias(f"en_max_{end}"), F.min("d").alias(f"en_min_{end}"), F.avg("d").alias(f"en_mean_{end}"))
    return pairs.select("id").join(agg, "id", "left").fillna(0)


def aromatic_atoms(rings: DataFrame, edges: DataFrame, order: float = 1.5) -> DataFrame:
    """(mol, ai, rings): atoms of rings whose every bond has the aromatic order."""
    turn = rings.withColumn("_ring", F.monotonically_increasing_id()).select("mol", "_ring", "nodes", F.posexplode("nodes").alias("i", "a0"))
    turn = turn.withColumn("a1", F.get("nodes", F.pmod(F.col("i") + 1, F.size("nodes"))))
    ok = turn.join(edges.where(F.col("bond_type") == order).select("mol", "a0", "a1"), ["mol", "a0", "a1"]).groupBy("mol", "_ring").agg(F.count("*").alias("k"), F.first(F.size("nodes")).alias("n"), F.first("nodes").alias("nodes"))
    return ok.where("k = n").select("mol", F.explode("nodes").alias("ai")).groupBy("mol", "ai").agg(F.count("*").alias("rings"))


def bond_code(a: Column, b: Column) -> Column:
    """Number of the unordered pair of elements, 0 to 14, in alphabetical order."""
    names = "CFHNO"
    table = {f"{x}{y}": i for i, (x, y) in enumerate((x, y) for k, x in enumerate(names) for y in names[k:])}
    key = F.concat(F.least(a, b), F.greatest(a, b))
    return reduce(lambda acc, kv: F.when(key == kv[0], kv[1]).otherwise(acc), table.items(), F.lit(None).cast("int"))
