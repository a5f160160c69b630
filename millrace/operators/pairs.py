"""Features of target pairs (id, mol, a0, a1) and their paths, assembled from the graph operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cosine, dot, norm
from . import molecules
from .frames import standardise

#: Columns of :func:`molecules.neighbour_features` by what fills them where an end has no other bond.
ZERO = ["along", "across", "en_diff", "lone_pairs"]
NONE = ["d_min", "d_max", "d_mean", "d_std", "cos_min", "cos_max", "cos_mean", "cos_std"]
HYBRIDS = [(3, 3), (4, 4), (2, 2), (4, 2), (4, 3), (3, 2)]


def both_ends(pairs: DataFrame, edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Neighbour features of both ends and their differences along the pair."""
    out = molecules.neighbour_features(pairs, edges, atoms, 0).join(molecules.neighbour_features(pairs, edges, atoms, 1), "id")
    return out.withColumns({f"{c}_diff": F.col(f"{c}_1") - F.col(f"{c}_0") for c in ("along", "across", "en_diff")})


def end_facts(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """Electronegativity and free pairs of both ends, and their differences."""
    el = F.broadcast(molecules.element_table(atoms.sparkSession).select("atom", "en", "donor"))
    out = molecules.with_ends(pairs.select("id", "mol", "a0", "a1"), atoms.join(el, "atom", "left"), ["en", "donor"])
    return out.select("id", "en0", "en1", "donor0", "donor1", (F.col("en1") - F.col("en0")).alias("en_gap"), (F.col("donor1") - F.col("donor0")).alias("donor_gap"))


def edge_pull(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Electronegativity difference of each edge by its length and by the length's square."""
    el = F.broadcast(molecules.element_table(atoms.sparkSession).select("atom", "en"))
    e = molecules.with_ends(edges.select("mol", "a0", "a1", "distance"), atoms.join(el, "atom", "left"), ["en"])
    gap = F.col("en1") - F.col("en0")
    return e.select("mol", "a0", "a1", F.try_divide(gap, F.col("distance")).alias("pull"), F.try_divide(gap, F.col("distance") * F.col("distance")).alias("pull_2"))


def path_neighbour_features(pairs: DataFrame, paths: DataFrame, edges: DataFrame, atoms: DataFrame, k: int = 1) -> DataFrame:
    """:func:`both_ends` of the first ``k`` bonds of the path from each end; paths need ``k`` + 2 atoms."""
    n = F.size("path")
    long = pairs.select("id", "mol").join(paths.where(n >= k + 2), "id")
    out = pairs.select("id")
    for end, (at, to) in enumerate(((F.get("path", F.lit(0)), F.get("path", F.lit(k))), (F.get("path", n - 1), F.get("path", n - 1 - k)))):
        got = both_ends(long.select("id", "mol", at.cast("long").alias("a0"), to.cast("long").alias("a1")), edges, atoms)
        out = out.join(got.select("id", *[F.col(c).alias(f"near{k}_end{end}_{c}") for c in got.columns if c != "id"]), "id", "left")
    zero = [c for c in out.columns if c != "id" and (c.endswith("_diff") or any(f"_{z}_" in c for z in ZERO))]
    return out.fillna(0.0, zero).fillna(-10.0)


def hop_features(pairs: DataFrame, edges: DataFrame, atoms: DataFrame, hops: int = 5) -> DataFrame:
    """For both ends: neighbour features of (end, atom) averaged over the non-hydrogen atoms at each hop, a column set for each hop."""
    ends = pairs.select("mol", F.col("a0").alias("ai")).unionByName(pairs.select("mol", F.col("a1").alias("ai"))).distinct()
    heavy = atoms.where("atom <> 'H'").select("mol", F.col("ai").alias("nbr"))
    near = molecules.hop_neighbours(edges, ends, hops).join(heavy, ["mol", "nbr"])
    near = near.select(F.struct("mol", "ai", "nbr").alias("id"), "mol", F.col("ai").alias("a0"), F.col("nbr").alias("a1"), "hop")
    got = both_ends(near.drop("hop"), edges, atoms).join(near.select("id", "mol", F.col("a0").alias("ai"), "hop"), "id")
    columns = [c for c in got.columns if c not in ("id", "mol", "ai", "hop")]
    wide = got.groupBy("mol", "ai").pivot("hop", list(range(1, hops + 1))).agg(*[F.avg(c).alias(c) for c in columns])
    out = pairs.select("id", "mol", "a0", "a1")
    for e in "01":
        out = out.join(wide.select("mol", F.col("ai").alias(f"a{e}"), *[F.col(f"{h}_{c}").alias(f"hop{h}_{c}_end{e}") for h in range(1, hops + 1) for c in columns]), ["mol", f"a{e}"], "left")
    return out.drop("mol", "a0", "a1").fillna(-10.0)


def donor_by_hop(pairs: DataFrame, edges: DataFrame, atoms: DataFrame, hops: int = 2) -> DataFrame:
    """Donation sums of each end (hop 0) and over the atoms at each further hop."""
    own = molecules.pi_donor(edges, atoms)
    ends = pairs.select("mol", F.col("a0").alias("ai")).unionByName(pairs.select("mol", F.col("a1").alias("ai"))).distinct()
    reach = ends.select("mol", "ai", F.col("ai").alias("nbr"), F.lit(0).alias("hop")).unionByName(molecules.hop_neighbours(edges, ends, hops))
    wide = reach.join(own.select("mol", F.col("ai").alias("nbr"), (F.col("pi_pairs") + F.col("pi_en")).alias("d")), ["mol", "nbr"]).groupBy("mol", "ai").pivot("hop", list(range(hops + 1))).agg(F.sum("d"))
    out = pairs.select("id", "mol", "a0", "a1")
    for e in "01":
        out = out.join(wide.select("mol", F.col("ai").alias(f"a{e}"), *[F.col(str(h)).alias(f"donor{h}_end{e}") for h in range(hops + 1)]), ["mol", f"a{e}"], "left")
    return out.drop("mol", "a0", "a1").fillna(0.0)


def path_edges(paths: DataFrame, pairs: DataFrame, edges: DataFrame, k: int = 0) -> DataFrame:
    """(id, x_0 .. z_1, turn): the edges path[k]-path[k+1] and path[k+1]-path[k+2], and the cosine between them."""
    at = lambda i: F.get("path", F.lit(k + i)).cast("long")
    out = pairs.select("id", "mol").join(paths.where(F.size("path") >= k + 3), "id").select("id", "mol", at(0).alias("p"), at(1).alias("q"), at(2).alias("r"))
    side = lambda a, b, i: edges.select("mol", F.col("a0").alias(a), F.col("a1").alias(b), *[F.col(c).alias(f"{c}_{i}") for c in "xyz"])
    out = out.join(side("p", "q", 0), ["mol", "p", "q"], "left").join(side("q", "r", 1), ["mol", "q", "r"], "left")
    step = lambda i: [F.col(f"{c}_{i}") for c in "xyz"]
    return out.select("id", *step(0), *step(1), cosine(step(0), step(1)).alias("turn"))


def inner_atoms(pairs: DataFrame, paths: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the first and last atom inside the path; -10 where there is none."""
    n = F.size("path")
    long = pairs.select("id", "mol").join(paths.where(n > 2).select("id", F.get("path", F.lit(1)).cast("long").alias("a0"), F.get("path", n - 2).cast("long").alias("a1")), "id")
    got = molecules.with_ends(long, facts, columns).select("id", *[F.col(f"{c}{e}").alias(f"inner{e}_{c}") for e in "01" for c in columns])
    return pairs.select("id").join(got, "id", "left").fillna(-10.0)


def carbon_bridge(pairs: DataFrame, paths: DataFrame, edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """For paths with two inner atoms: whether both are carbon, the pair of their degrees as a class, the cis distance.

    The class is the place in ``HYBRIDS`` of the two degrees in either order, else -1. The cis
    distance, for two carbons of three bonds, is that between one end's mirror image, in the plane
    across the middle of the inner bond, and the other end; else -1.
    """
    four = paths.where(F.size("path") == 4).select("id", *[F.get("path", F.lit(i)).cast("long").alias(n) for i, n in enumerate("pqrs")])
    out = pairs.select("id", "mol").join(four, "id")
    deg = molecules.degree(edges)
    facts = atoms.join(deg, ["mol", "ai"], "left").fillna(0, ["degree"])
    for n in "pqrs":
        out = out.join(facts.select("mol", F.col("ai").alias(n), F.col("atom").alias(f"{n}_atom"), F.col("degree").alias(f"{n}_degree"), *[F.col(c).alias(f"{n}{c}") for c in "xyz"]), ["mol", n], "left")
    carbon = (F.col("q_atom") == "C") & (F.col("r_atom") == "C")
    high, low = F.greatest("q_degree", "r_degree"), F.least("q_degree", "r_degree")
    kind = reduce(lambda acc, iv: acc.when(carbon & (high == iv[1][0]) & (low == iv[1][1]), iv[0]), enumerate(HYBRIDS), F.when(F.lit(False), -1)).otherwise(-1)
    at = lambda n: [F.col(f"{n}{c}") for c in "xyz"]
    axis = [b - a for a, b in zip(at("q"), at("r"), strict=True)]
    unit = [F.try_divide(a, norm(axis)) for a in axis]
    middle = [(a + b) / 2 for a, b in zip(at("q"), at("r"), strict=True)]
    shift = dot([m - p for m, p in zip(middle, at("p"), strict=True)], unit)
    image = [p + 2 * shift * u for p, u in zip(at("p"), unit, strict=True)]
    cis = norm([a - b for a, b in zip(image, at("s"), strict=True)])
    out = out.select("id", carbon.alias("carbons"), kind.alias("hybrid"), cis.alias("_cis"))
    out = out.withColumn("cis_distance", F.when(F.col("hybrid") == 0, F.col("_cis")).otherwise(-1.0)).drop("_cis")
    got = pairs.select("id").join(out, "id", "left")
    return got.withColumns({"carbons": F.coalesce("carbons", F.lit(False)), "hybrid": F.coalesce("hybrid", F.lit(-1)), "cis_distance": F.coalesce("cis_distance", F.lit(-1.0))})


def bond_deviation(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """Distance against the element pair's mean standard length, and the mean energy by powers of that ratio."""
    means = molecules.bond_table(atoms.sparkSession).groupBy("atom0", "atom1").agg(F.avg("standard_length").alias("length"), F.avg("standard_energy").alias("energy"))
    p = molecules.with_ends(pairs.select("id", "mol", "a0", "a1"), atoms, ["atom", "x", "y", "z"]).join(F.broadcast(means), ["atom0", "atom1"], "left")
    p = p.withColumn("_d", norm([F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"])).withColumn("length_ratio", F.col("_d") / F.col("length"))
    energies = [F.try_divide(F.col("energy"), F.pow("length_ratio", F.lit(float(k)))).alias(f"energy_{k}") for k in (1, 2, 4, 6)]
    return p.select("id", "length_ratio", (F.col("_d") - F.col("length")).alias("length_gap"), *energies)


def with_bond_data(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """Edges with the mean standard length and energy of their elements and order."""
    means = molecules.bond_table(atoms.sparkSession).groupBy("atom0", "atom1", "bond_type").agg(F.avg("standard_length").alias("standard_length"), F.avg("standard_energy").alias("standard_energy"))
    return molecules.with_ends(edges, atoms, ["atom"]).join(F.broadcast(means), ["atom0", "atom1", "bond_type"], "left")


def edges_of_bonds(bonds: DataFrame, atoms: DataFrame) -> DataFrame:
    """Edges from given bonds (mol, a0, a1, order, aromatic): order 1.5 if aromatic, unit vector from the atoms' places."""
    e = molecules.with_ends(bonds, atoms, ["x", "y", "z"])
    d = norm([F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"])
    e = e.withColumn("distance", d)
    return e.select("mol", "a0", "a1", "distance", F.when(F.col("aromatic"), 1.5).otherwise(F.col("order").cast("double")).alias("bond_type"), *[F.try_divide(F.col(f"{c}1") - F.col(f"{c}0"), F.col("distance")).alias(c) for c in "xyz"])


def distance_powers(pairs: DataFrame, atoms: DataFrame) -> DataFrame:
    """Distance of the ends, its square and inverse, the inverse rounded to a tenth and what rounding leaves."""
    p = molecules.with_ends(pairs.select("id", "mol", "a0", "a1"), atoms, ["x", "y", "z"])
    p = p.withColumn("distance", norm([F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]))
    inverse = F.try_divide(F.lit(1.0), F.col("distance"))
    return p.select("id", "distance", (F.col("distance") * F.col("distance")).alias("distance_2"), inverse.alias("inverse"), F.round(inverse, 1).alias("inverse_round"), (inverse - F.round(inverse, 1)).alias("inverse_rest"))


def swapped(pairs: DataFrame, columns: list[str], *, kind: str = "atom") -> DataFrame:
    """Augmentation: pairs of unequal ``kind`` again with their ends' columns swapped, ids above the greatest old one."""
    top = pairs.agg(F.max("id").alias("_top"))
    flip = {f"{c}{e}": F.col(f"{c}{1 - e}") for c in columns for e in (0, 1)}
    new = pairs.where(F.col(f"{kind}0") != F.col(f"{kind}1")).crossJoin(F.broadcast(top))
    new = new.select(*[flip.get(c, F.col("id") + F.col("_top") + 1 if c == "id" else F.col(c)).alias(c) for c in pairs.columns])
    return pairs.unionByName(new)


def end_targets(pairs: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """Targets of single atoms (mol, ai, columns), standardised over all atoms, joined to both ends."""
    return molecules.with_ends(pairs.select("id", "mol", "a0", "a1"), standardise(targets, columns), columns)


def padded_matrix(edges: DataFrame, value: str, size: int) -> DataFrame:
    """(mol, matrix): ``size`` x ``size`` values of the edges row by row, 0 where there is none; edges beyond ``size`` atoms are an error."""
    place = F.when((F.col("a0") < size) & (F.col("a1") < size), F.col("a0") * size + F.col("a1")).otherwise(F.raise_error(F.lit("more atoms than size")).cast("long"))
    cells = edges.groupBy("mol").agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("k"), F.col(value).cast("double").alias("v")))).alias("_cells"))
    at = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.try_element_at("_cells", i), F.lit(0.0)))
    return cells.select("mol", at.alias("matrix"))


def graph_tables(atoms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs of a graph network: atoms with one column for each element and standardised numbers, edges (both ways) with theirs."""
    el = F.broadcast(molecules.element_table(atoms.sparkSession))
    numbers = ["en", "valence", "donor", "mass", "degree", "q"]
    full = atoms.join(el, "atom", "left").join(molecules.degree(edges), ["mol", "ai"], "left").join(molecules.partial_charge(edges, atoms).select("mol", "ai", "q"), ["mol", "ai"], "left")
    full = full.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers})
    nodes = standardise(full.select("mol", "ai", *[(F.col("atom") == e).cast("double").alias(f"is_{e}") for e in "CFHNO"], *numbers), numbers)
    links = with_bond_data(edges, atoms).select("mol", "a0", "a1", F.col("bond_type"), "distance", "standard_length", "standard_energy")
    return nodes, standardise(links, ["distance", "standard_length", "standard_energy"])


def assemble(pairs: DataFrame, atoms: DataFrame, edges: DataFrame, paths: DataFrame, rings: DataFrame) -> DataFrame:
    """All features of a pair, one row each: molecule, potentials, rings, distances, atom types, neighbours, bonds, places."""
    charges = molecules.partial_charge(edges, atoms)
    potential = molecules.potentials(atoms, charges)
    kinds = molecules.bond_composition(edges, atoms)
    out = pairs.select("id", "mol", "a0", "a1").join(molecules.molecule_shape(atoms), "mol", "left")
    out = molecules.with_ends(out, potential, ["coulomb", "yukawa"])
    out = molecules.with_ends(out, kinds, ["composition"])
    parts = [
        molecules.cycle_features(pairs.select("id", "mol", "a0", "a1"), rings, paths).drop("mol", "a0", "a1"), molecules.centre_features(pairs, atoms), distance_powers(pairs, atoms),
        both_ends(pairs, edges, atoms), path_neighbour_features(pairs, paths, edges, atoms), carbon_bridge(pairs, paths, edges, atoms), bond_deviation(pairs, atoms), molecules.offset_neighbours(pairs, atoms),
    ]
    return reduce(lambda a, b: a.join(b, "id", "left"), parts, out)


def plane_distance(point: list[Column], on: list[Column], normal: list[Column]) -> Column:
    """Signed distance of a point from the plane through ``on`` across ``normal``."""
    return F.try_divide(dot([p - q for p, q in zip(point, on, strict=True)], normal), norm(normal))
