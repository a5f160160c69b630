"""Further queries: pairs along paths, assembled features, and small operators of every module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import base_name, box_area, discretised, extension, first_token
from ..operators import evaluation, frames, molecules, pairs, panel, signals, text
from ..sources import tables
from ..sources.tables import table
from .queries import TARGETS, atoms, edges, monthly, predictions, query, rounded, sales, signal, target_pairs

#: Shortest paths of the target pairs, as SQL.
PATHS = f""", walk AS (SELECT id, mol, a1, [a0] AS path FROM {TARGETS} UNION ALL SELECT w.id, w.mol, w.a1, list_append(w.path, e.a1) FROM walk w JOIN edges e ON e.mol = w.mol AND e.a0 = w.path[-1]
  WHERE NOT list_contains(w.path, e.a1) AND w.path[-1] <> w.a1 AND len(w.path) < 10),
paths AS (SELECT id, mol, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(path), path) AS r FROM walk WHERE path[-1] = a1) WHERE r = 1)"""
FACTS = ", facts AS (SELECT * FROM atoms JOIN el USING (atom))"


def paths_of(spark, d) -> DataFrame:
    return molecules.shortest_paths(edges(spark, d), target_pairs(spark, d))


def _cos(a: list[str], b: list[str]) -> str:
    dot = lambda p, q: "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(p, q, strict=True)) + ")"
    return f"({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0))"


def _line(a: str, b: str) -> list[str]:
    return [f"{b}.{c} - {a}.{c}" for c in "xyz"]


def _near(source: str, end: int) -> str:
    """SQL of the neighbour features of one end of the pairs (id, mol, a0, a1) in ``source``."""
    at, to = f"a{end}", f"a{1 - end}"
    return f"""(SELECT id, coalesce(along, 0) AS along, coalesce(across, 0) AS across, coalesce(en_diff, 0) AS en_diff, coalesce(lone_pairs, 0) AS lone_pairs, coalesce(d_min, -10) AS d_min, coalesce(d_max, -10) AS d_max, coalesce(d_mean, -10) AS d_mean, coalesce(d_std, -10) AS d_std,
  coalesce(cos_min, -10) AS cos_min, coalesce(cos_max, -10) AS cos_max, coalesce(cos_mean, -10) AS cos_mean, coalesce(cos_std, -10) AS cos_std FROM {source} LEFT JOIN (
  SELECT id, sx * ux + sy * uy + sz * uz AS along, sqrt(sx * sx + sy * sy + sz * sz) - abs(sx * ux + sy * uy + sz * uz) AS across, * EXCLUDE (id, sx, sy, sz, ux, uy, uz) FROM (
  SELECT id, sum(en_nbr * x) AS sx, sum(en_nbr * y) AS sy, sum(en_nbr * z) AS sz, first(ux) AS ux, first(uy) AS uy, first(uz) AS uz, sum(en_nbr - en_at) AS en_diff, sum(donor) AS lone_pairs, min(distance) AS d_min, max(distance) AS d_max, avg(distance) AS d_mean,
  coalesce(stddev_samp(distance), 0) AS d_std, min(c) AS cos_min, max(c) AS cos_max, avg(c) AS cos_mean, coalesce(stddev_samp(c), 0) AS cos_std FROM (
  SELECT s.id, e.distance, e.x, e.y, e.z, n.en AS en_nbr, n.donor, p.en AS en_at, {", ".join(f"(q.{c} - p.{c}) / nullif(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)), 0) AS u{c}" for c in "xyz")}, {_cos(["e.x", "e.y", "e.z"], _line("p", "q"))} AS c
  FROM {source} s JOIN facts p ON p.mol = s.mol AND p.ai = s.{at} JOIN facts q ON q.mol = s.mol AND q.ai = s.{to} JOIN edges e ON e.mol = s.mol AND e.a0 = s.{at} AND e.a1 <> s.{to} JOIN facts n ON n.mol = s.mol AND n.ai = e.a1) GROUP BY id)) USING (id))"""


NEAR = [*pairs.ZERO, *pairs.NONE]


@query(f"{FACTS}, t AS {TARGETS}, n0 AS {_near('t', 0)}, n1 AS {_near('t', 1)} SELECT id, {', '.join(f'round(n{e}.{c}, 5) + 0.0 AS {c}_{e}' for e in '01' for c in NEAR)} FROM n0 JOIN n1 USING (id)")
def molecule_both_ends(spark, d):
    out = pairs.both_ends(target_pairs(spark, d), edges(spark, d), atoms(spark, d)).drop("along_diff", "across_diff", "en_diff_diff")
    return rounded(out, *[c for c in out.columns if c != "id"], digits=5)


def _path_near(k: int, end: int) -> str:
    ends = f"path[1] AS a0, path[{1 + k}] AS a1" if end == 0 else f"path[-1] AS a0, path[-{1 + k}] AS a1"
    return f"p{k}{end} AS (SELECT id, mol, {ends} FROM paths WHERE len(path) >= {k + 2})"


@query(f"""{FACTS}{PATHS}, {", ".join(_path_near(k, e) for k in (1, 2) for e in (0, 1))}, t AS {TARGETS} SELECT t.id, {", ".join(f"round(coalesce(n{k}{e}.{c}, {0 if c in pairs.ZERO else -10}), 5) + 0.0 AS {c}_{k}{e}" for k in (1, 2) for e in (0, 1) for c in NEAR)} FROM t
{" ".join(f"LEFT JOIN {_near(f'p{k}{e}', 0)} n{k}{e} ON n{k}{e}.id = t.id" for k in (1, 2) for e in (0, 1))}""")
def molecule_path_neighbours(spark, d):
    p, e, a, ways = target_pairs(spark, d), edges(spark, d), atoms(spark, d), paths_of(spark, d)
    out = p.select("id")
    for k in (1, 2):
        got = pairs.path_neighbour_features(p, ways, e, a, k)
        out = out.join(got.select("id", *[F.col(f"near{k}_end{end}_{c}_0").alias(f"{c}_{k}{end}") for end in (0, 1) for c in NEAR]), "id")
    return rounded(out, *[c for c in out.columns if c != "id"], digits=5)


HOPS = """, hops AS (SELECT mol, ai, nbr, min(hop) AS hop FROM (SELECT mol, a0 AS ai, a1 AS nbr, 1 AS hop FROM edges UNION ALL SELECT e.mol, e.a0, f.a1, 2 FROM edges e JOIN edges f ON e.mol = f.mol AND e.a1 = f.a0) WHERE ai <> nbr GROUP BY ALL)"""


@query(f"""{FACTS}{HOPS}, hp AS (SELECT row_number() OVER (ORDER BY h.mol, h.ai, h.nbr) AS id, h.mol, h.ai AS a0, h.nbr AS a1, h.hop FROM hops h JOIN atoms n ON n.mol = h.mol AND n.ai = h.nbr WHERE n.atom <> 'H'),
hf AS (SELECT hp.mol, hp.a0 AS ai, hp.hop, avg(n.d_mean) AS d_mean, avg(n.lone_pairs) AS lone_pairs, avg(m.cos_max) AS cos_max FROM hp JOIN {_near("hp", 0)} n USING (id) JOIN {_near("hp", 1)} m USING (id) GROUP BY ALL)
SELECT t.id, {", ".join(f"round(coalesce(h{h}{e}.{c}, -10), 5) + 0.0 AS hop{h}_{c}_end{e}" for h in (1, 2) for e in (0, 1) for c in ("d_mean", "lone_pairs", "cos_max"))} FROM {TARGETS} t
{" ".join(f"LEFT JOIN hf h{h}{e} ON h{h}{e}.mol = t.mol AND h{h}{e}.ai = t.a{e} AND h{h}{e}.hop = {h}" for h in (1, 2) for e in (0, 1))}""")
def molecule_hop_features(spark, d):
    out = pairs.hop_features(target_pairs(spark, d), edges(spark, d), atoms(spark, d), 2)
    columns = {f"hop{h}_{c}_end{e}": f"hop{h}_{c}_{s}_end{e}" for h in (1, 2) for e in (0, 1) for c, s in (("d_mean", 0), ("lone_pairs", 0), ("cos_max", 1))}
    return rounded(out.select("id", *[F.col(v).alias(k) for k, v in columns.items()]), *columns, digits=5)


DONOR = ", own AS (SELECT e.mol, e.a0 AS ai, sum(n.donor * CASE WHEN bond_type = 1.5 THEN 0.5 WHEN bond_type >= 2 THEN 2 ELSE 1 END) AS pi_pairs, sum(n.en - p.en) AS pi_en FROM edges e JOIN facts p ON p.mol = e.mol AND p.ai = e.a0 JOIN facts n ON n.mol = e.mol AND n.ai = e.a1 WHERE n.atom <> 'H' GROUP BY ALL)"


@query(f"{FACTS}{DONOR} SELECT mol, ai, round(pi_en, 4) + 0.0 AS pi_en, round(pi_pairs, 4) AS pi_pairs FROM own")
def molecule_pi_donor(spark, d):
    return rounded(molecules.pi_donor(edges(spark, d), atoms(spark, d)), "pi_en", "pi_pairs", digits=4)


@query(f"""{FACTS}{DONOR}{HOPS}, r AS (SELECT mol, ai, ai AS nbr, 0 AS hop FROM atoms UNION ALL SELECT mol, ai, nbr, hop FROM hops), s AS (SELECT r.mol, r.ai, r.hop, sum(pi_pairs + pi_en) AS v FROM r JOIN own ON own.mol = r.mol AND own.ai = r.nbr GROUP BY ALL)
SELECT t.id, {", ".join(f"round(coalesce(s{h}{e}.v, 0), 4) + 0.0 AS donor{h}_end{e}" for h in (0, 1, 2) for e in (0, 1))} FROM {TARGETS} t {" ".join(f"LEFT JOIN s s{h}{e} ON s{h}{e}.mol = t.mol AND s{h}{e}.ai = t.a{e} AND s{h}{e}.hop = {h}" for h in (0, 1, 2) for e in (0, 1))}""")
def molecule_donor_by_hop(spark, d):
    out = pairs.donor_by_hop(target_pairs(spark, d), edges(spark, d), atoms(spark, d))
    return rounded(out, *[c for c in out.columns if c != "id"], digits=4)


@query(f"{FACTS} SELECT id, p.en AS en0, q.en AS en1, p.donor AS donor0, q.donor AS donor1, round(q.en - p.en, 7) + 0.0 AS en_gap, round(q.donor - p.donor, 7) + 0.0 AS donor_gap FROM {TARGETS} t JOIN facts p ON p.mol = t.mol AND p.ai = t.a0 JOIN facts q ON q.mol = t.mol AND q.ai = t.a1")
def molecule_end_facts(spark, d):
    return rounded(pairs.end_facts(target_pairs(spark, d), atoms(spark, d)), "en_gap", "donor_gap")


@query(f"{FACTS} SELECT e.mol, e.a0, e.a1, round((q.en - p.en) / nullif(distance, 0), 4) + 0.0 AS pull, round((q.en - p.en) / nullif(distance * distance, 0), 4) + 0.0 AS pull_2 FROM edges e JOIN facts p ON p.mol = e.mol AND p.ai = e.a0 JOIN facts q ON q.mol = e.mol AND q.ai = e.a1")
def molecule_edge_pull(spark, d):
    return rounded(pairs.edge_pull(edges(spark, d), atoms(spark, d)), "pull", "pull_2", digits=4)


@query(f"""{PATHS} SELECT p.id, {", ".join(f"round(e.{c}, 4) + 0.0 AS {c}_0, round(f.{c}, 4) + 0.0 AS {c}_1" for c in "xyz")}, round({_cos(["e.x", "e.y", "e.z"], ["f.x", "f.y", "f.z"])}, 3) + 0.0 AS turn FROM paths p
LEFT JOIN edges e ON e.mol = p.mol AND e.a0 = path[1] AND e.a1 = path[2] LEFT JOIN edges f ON f.mol = p.mol AND f.a0 = path[2] AND f.a1 = path[3] WHERE len(path) >= 3""")
def molecule_path_edges(spark, d):
    out = pairs.path_edges(paths_of(spark, d), target_pairs(spark, d), edges(spark, d))
    return rounded(rounded(out, *[c for c in out.columns if c not in ("id", "turn")], digits=4), "turn", digits=3)


@query(f"""{FACTS}{PATHS} SELECT t.id, coalesce(a.en, -10) AS inner0_en, coalesce(a.mass, -10) AS inner0_mass, coalesce(b.en, -10) AS inner1_en, coalesce(b.mass, -10) AS inner1_mass FROM {TARGETS} t LEFT JOIN (SELECT * FROM paths WHERE len(path) > 2) p USING (id)
LEFT JOIN facts a ON a.mol = p.mol AND a.ai = path[2] LEFT JOIN facts b ON b.mol = p.mol AND b.ai = path[-2]""")
def molecule_inner_atoms(spark, d):
    facts = atoms(spark, d).join(F.broadcast(molecules.element_table(spark)), "atom")
    return pairs.inner_atoms(target_pairs(spark, d), paths_of(spark, d), facts, ["en", "mass"])


@query(f"""{PATHS}, deg AS (SELECT mol, a0 AS ai, count(*) AS degree FROM edges GROUP BY ALL), b AS (SELECT w.id, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, r.x AS rx, r.y AS ry, r.z AS rz, s.x AS sx, s.y AS sy, s.z AS sz, q.atom = 'C' AND r.atom = 'C' AS cc,
  greatest(coalesce(dq.degree, 0), coalesce(dr.degree, 0)) * 10 + least(coalesce(dq.degree, 0), coalesce(dr.degree, 0)) AS code FROM paths w JOIN atoms p ON p.mol = w.mol AND p.ai = path[1] JOIN atoms q ON q.mol = w.mol AND q.ai = path[2] JOIN atoms r ON r.mol = w.mol AND r.ai = path[3] JOIN atoms s ON s.mol = w.mol AND s.ai = path[4]
  LEFT JOIN deg dq ON dq.mol = w.mol AND dq.ai = path[2] LEFT JOIN deg dr ON dr.mol = w.mol AND dr.ai = path[3] WHERE len(path) = 4),
m AS (SELECT *, CASE WHEN cc THEN CASE code WHEN 33 THEN 0 WHEN 44 THEN 1 WHEN 22 THEN 2 WHEN 42 THEN 3 WHEN 43 THEN 4 WHEN 32 THEN 5 ELSE -1 END ELSE -1 END AS hybrid, sqrt((rx - qx) * (rx - qx) + (ry - qy) * (ry - qy) + (rz - qz) * (rz - qz)) AS len FROM b),
s2 AS (SELECT *, (((qx + rx) / 2 - px) * (rx - qx) + ((qy + ry) / 2 - py) * (ry - qy) + ((qz + rz) / 2 - pz) * (rz - qz)) / nullif(len * len, 0) AS k FROM m)
SELECT t.id, coalesce(cc, false) AS carbons, coalesce(hybrid, -1)::INTEGER AS hybrid, round(CASE WHEN hybrid = 0 THEN sqrt(pow(px + 2 * k * (rx - qx) - sx, 2) + pow(py + 2 * k * (ry - qy) - sy, 2) + pow(pz + 2 * k * (rz - qz) - sz, 2)) ELSE -1 END, 4) AS cis_distance FROM {TARGETS} t LEFT JOIN s2 USING (id)""")
def molecule_carbon_bridge(spark, d):
    return rounded(pairs.carbon_bridge(target_pairs(spark, d), paths_of(spark, d), edges(spark, d), atoms(spark, d)), "cis_distance", digits=4)


@query(f"""{FACTS}, b AS (SELECT atom0, atom1, avg(len) AS len, avg(energy) AS energy FROM bonds GROUP BY ALL), r AS (SELECT t.id, p.distance, p.distance / b.len AS f, b.len, b.energy FROM {TARGETS} t JOIN pairs p ON p.mol = t.mol AND p.a0 = t.a0 AND p.a1 = t.a1 LEFT JOIN b USING (atom0, atom1))
SELECT id, round(f, 9) AS length_ratio, round(distance - len, 9) + 0.0 AS length_gap, {", ".join(f"round(energy / nullif(pow(f, {k}), 0), 4) AS energy_{k}" for k in (1, 2))} FROM r""")
def molecule_bond_deviation(spark, d):
    out = pairs.bond_deviation(target_pairs(spark, d), atoms(spark, d)).drop("energy_4", "energy_6")
    return rounded(rounded(out, "length_ratio", "length_gap", digits=9), "energy_1", "energy_2", digits=4)


@query("""SELECT e.mol, e.a0, e.a1, e.bond_type, round(b.len, 5) AS standard_length, round(b.energy, 3) AS standard_energy FROM edges e JOIN atoms p ON p.mol = e.mol AND p.ai = e.a0 JOIN atoms q ON q.mol = e.mol AND q.ai = e.a1
LEFT JOIN (SELECT atom0, atom1, bond_type, avg(len) AS len, avg(energy) AS energy FROM bonds GROUP BY ALL) b ON b.atom0 = p.atom AND b.atom1 = q.atom AND b.bond_type = e.bond_type""")
def molecule_bond_data(spark, d):
    out = pairs.with_bond_data(edges(spark, d), atoms(spark, d)).select("mol", "a0", "a1", "bond_type", "standard_length", "standard_energy")
    return rounded(rounded(out, "standard_length", digits=5), "standard_energy", digits=3)


@query("SELECT mol, a0, a1, CASE WHEN (mol + a0) % 3 = 0 THEN 1.5 ELSE 1 + (a0 + a1) % 2 END::DOUBLE AS bond_type, round(distance, 4) AS distance, " + ", ".join(f"round(({c}1 - {c}0) / nullif(distance, 0), 4) + 0.0 AS {c}" for c in "xyz") + " FROM pairs WHERE a1 = a0 + 1")
def molecule_given_bonds(spark, d):
    a = atoms(spark, d)
    bonds = a.select("mol", F.col("ai").alias("a0")).join(a.select("mol", F.col("ai").alias("a1")), "mol").where("a1 = a0 + 1")
    bonds = bonds.withColumns({"order": 1 + (F.col("a0") + F.col("a1")) % 2, "aromatic": (F.col("mol") + F.col("a0")) % 3 == 0})
    return rounded(pairs.edges_of_bonds(bonds, a), "distance", "x", "y", "z", digits=4)


@query(f"SELECT id, round(distance, 5) AS distance, round(distance * distance, 4) AS distance_2, round(1 / nullif(distance, 0), 5) AS inverse FROM {TARGETS} t JOIN pairs p ON p.mol = t.mol AND p.a0 = t.a0 AND p.a1 = t.a1")
def molecule_distance_powers(spark, d):
    out = pairs.distance_powers(target_pairs(spark, d), atoms(spark, d)).select("id", "distance", "distance_2", "inverse")
    return rounded(rounded(out, "distance", "inverse", digits=5), "distance_2", digits=4)


SWAP = f"(SELECT t.id, t.a0, t.a1, p.atom AS atom0, q.atom AS atom1, p.x AS x0, q.x AS x1 FROM {TARGETS} t JOIN atoms p ON p.mol = t.mol AND p.ai = t.a0 JOIN atoms q ON q.mol = t.mol AND q.ai = t.a1)"


@query(f", s AS {SWAP} SELECT * FROM s UNION ALL SELECT id + (SELECT max(id) FROM s) + 1, a1, a0, atom1, atom0, x1, x0 FROM s WHERE atom0 <> atom1")
def molecule_swapped_pairs(spark, d):
    p = molecules.with_ends(target_pairs(spark, d), atoms(spark, d), ["atom", "x"]).select("id", "a0", "a1", "atom0", "atom1", "x0", "x1")
    return pairs.swapped(p, ["a", "atom", "x"])


@query(f", s AS (SELECT mol, ai, (x - avg(x) OVER ()) / nullif(stddev_pop(x) OVER (), 0) AS x FROM atoms) SELECT t.id, t.mol, t.a0, t.a1, round(p.x, 5) + 0.0 AS x0, round(q.x, 5) + 0.0 AS x1 FROM {TARGETS} t JOIN s p ON p.mol = t.mol AND p.ai = t.a0 JOIN s q ON q.mol = t.mol AND q.ai = t.a1")
def molecule_end_targets(spark, d):
    return rounded(pairs.end_targets(target_pairs(spark, d), atoms(spark, d).select("mol", "ai", "x"), ["x"]), "x0", "x1", digits=5)


@query("SELECT mol, list_transform(range(1024), lambda i: coalesce(list_sum(list_transform(list_filter(c, lambda s: s.k = i), lambda s: s.v)), 0)) AS matrix FROM (SELECT mol, list({'k': a0 * 32 + a1, 'v': bond_type}) AS c FROM edges GROUP BY mol)")
def molecule_padded_matrix(spark, d):
    return pairs.padded_matrix(edges(spark, d), "bond_type", 32)


@query(f"""{FACTS}, deg AS (SELECT mol, a0 AS ai, count(*) AS degree FROM edges GROUP BY ALL), n AS (SELECT mol, ai, {", ".join(f"(atom = '{e}')::INTEGER::DOUBLE AS is_{e}" for e in "CFHNO")}, en, mass, coalesce(degree, 0)::DOUBLE AS degree FROM facts LEFT JOIN deg USING (mol, ai))
SELECT mol, ai, {", ".join(f"is_{e}" for e in "CFHNO")}, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) + 0.0 AS {c}" for c in ("en", "mass", "degree"))} FROM n""")
def molecule_graph_nodes(spark, d):
    nodes = pairs.graph_tables(atoms(spark, d), edges(spark, d))[0].drop("valence", "donor", "q")
    return rounded(nodes, "en", "mass", "degree", digits=5)


@query("""SELECT mol, a0, a1, bond_type, round((distance - avg(distance) OVER ()) / stddev_pop(distance) OVER (), 4) + 0.0 AS distance FROM edges""")
def molecule_graph_edges(spark, d):
    return rounded(pairs.graph_tables(atoms(spark, d), edges(spark, d))[1].select("mol", "a0", "a1", "bond_type", "distance"), "distance", digits=4)


@query()
def molecule_assembled(spark, d):
    """All features of each pair; its parts have SQL of their own."""
    e = edges(spark, d)
    return pairs.assemble(target_pairs(spark, d), atoms(spark, d), e, paths_of(spark, d), molecules.cycles(e))


@query(f"""{FACTS} SELECT mol, a0 AS ai, {", ".join(f"round(sum(e.{c} * (q.en - p.en) / nullif(distance, 0)), 3) + 0.0 AS i{c}" for c in "xyz")} FROM edges e JOIN (SELECT mol, ai AS a0, en FROM facts) p USING (mol, a0) JOIN (SELECT mol, ai AS a1, en FROM facts) q USING (mol, a1) GROUP BY ALL""")
def molecule_induced_vector(spark, d):
    return rounded(molecules.induced_vector(edges(spark, d), atoms(spark, d)).drop("induced"), "ix", "iy", "iz", digits=3)


@query(f"""SELECT t.id, round(coalesce(avg(sqrt((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y) + (o.z - p.z) * (o.z - p.z))), 100), 5) AS near_mean, count(*) FILTER (o.atom = 'H') AS "near_H", count(*) FILTER (o.atom = 'C') AS "near_C" FROM {TARGETS} t JOIN atoms p ON p.mol = t.mol AND p.ai = t.a0
LEFT JOIN atoms o ON o.mol = t.mol AND o.ai <> t.a0 AND abs(o.ai - t.a0) <= 3 GROUP BY t.id""")
def molecule_offset_neighbours(spark, d):
    return rounded(molecules.offset_neighbours(target_pairs(spark, d), atoms(spark, d)), "near_mean", digits=5)


@query(f"""{FACTS}, n AS (SELECT t.id, p.a1 AS nbr, b.bond_type, q.en - f.en AS d FROM {TARGETS} t JOIN pairs p ON p.mol = t.mol AND p.a0 = t.a0 AND p.a1 <> t.a1 JOIN bonds b ON b.atom0 = p.atom0 AND b.atom1 = p.atom1 JOIN facts f ON f.mol = p.mol AND f.ai = p.a0 JOIN facts q ON q.mol = p.mol AND q.ai = p.a1 WHERE p.distance <= b.len * 1.05)
SELECT t.id, count(DISTINCT nbr) AS nbrs_0, coalesce(max(bond_type), 0) AS order_max_0, round(coalesce(avg(bond_type), 0), 5) AS order_mean_0, round(coalesce(max(d), 0), 5) + 0.0 AS en_max_0, round(coalesce(min(d), 0), 5) + 0.0 AS en_min_0, round(coalesce(avg(d), 0), 5) + 0.0 AS en_mean_0 FROM {TARGETS} t LEFT JOIN n USING (id) GROUP BY t.id""")
def molecule_length_neighbours(spark, d):
    return rounded(molecules.length_neighbours(target_pairs(spark, d), atoms(spark, d), 0), "order_mean_0", "en_max_0", "en_min_0", "en_mean_0", digits=5)


RINGS = """, turn AS (SELECT mol, [a0] AS path FROM (SELECT DISTINCT mol, a0 FROM edges) UNION ALL SELECT w.mol, list_append(w.path, e.a1) FROM turn w JOIN edges e ON e.mol = w.mol AND e.a0 = w.path[-1] WHERE e.a1 > w.path[1] AND NOT list_contains(w.path, e.a1) AND len(w.path) < 10),
rings AS (SELECT DISTINCT t.mol, list_sort(path) AS nodes FROM turn t JOIN edges e ON e.mol = t.mol AND e.a0 = t.path[-1] AND e.a1 = t.path[1] WHERE len(path) > 2)"""


@query(f"""{PATHS}{RINGS}, m AS (SELECT mol, avg(len(nodes)) AS n, flatten(list(nodes)) AS inside FROM rings GROUP BY mol) SELECT t.id, t.mol, t.a0, t.a1, round(coalesce(n, 100), 5) AS ring_mean, coalesce(list_contains(inside, path[2]), false) AS near_ring0, coalesce(list_contains(inside, path[-2]), false) AS near_ring1
FROM {TARGETS} t LEFT JOIN m USING (mol) LEFT JOIN (SELECT id, path FROM paths) USING (id)""")
def molecule_cycles(spark, d):
    return rounded(molecules.cycle_features(target_pairs(spark, d), molecules.cycles(edges(spark, d)), paths_of(spark, d)), "ring_mean", digits=5)


@query(f"""{PATHS}, w AS (SELECT id, len(path) AS n, p, q, r, s FROM paths LEFT JOIN (SELECT mol, ai, {{'x': x, 'y': y, 'z': z}} AS p FROM atoms) a ON a.mol = paths.mol AND a.ai = path[1] LEFT JOIN (SELECT mol, ai, {{'x': x, 'y': y, 'z': z}} AS q FROM atoms) b ON b.mol = paths.mol AND b.ai = path[2]
LEFT JOIN (SELECT mol, ai, {{'x': x, 'y': y, 'z': z}} AS r FROM atoms) c ON c.mol = paths.mol AND c.ai = path[-2] LEFT JOIN (SELECT mol, ai, {{'x': x, 'y': y, 'z': z}} AS s FROM atoms) e ON e.mol = paths.mol AND e.ai = path[-1])
SELECT id, n - 2 AS inner, round(coalesce(CASE WHEN n = 3 THEN {_cos(_line("q", "p"), _line("q", "s"))} WHEN n > 3 THEN {_cos(_line("q", "p"), _line("q", "r"))} END, -10), 4) + 0.0 AS angle_1, round(coalesce(CASE WHEN n = 3 THEN {_cos(_line("q", "p"), _line("q", "s"))} WHEN n > 3 THEN {_cos(_line("r", "s"), _line("r", "q"))} END, -10), 4) + 0.0 AS angle_2 FROM w""")
def molecule_paths(spark, d):
    out = molecules.path_angles(paths_of(spark, d), target_pairs(spark, d), atoms(spark, d)).select("id", F.col("inner").cast("bigint").alias("inner"), "angle_1", "angle_2")
    return rounded(out, "angle_1", "angle_2", digits=4)


@query("""SELECT mol, a0 AS ai, """ + ", ".join(f"round(coalesce(max(1 / nullif(distance, 0)) FILTER (r = {r}), 0), 5) AS inv_{3 - r}" for r in (1, 2, 3)) + """ FROM (SELECT *, row_number() OVER (PARTITION BY mol, a0 ORDER BY distance, a1) AS r FROM pairs) WHERE r <= 3 GROUP BY ALL""")
def molecule_nearest_atoms(spark, d):
    out = molecules.nearest_atoms(atoms(spark, d)).select("mol", "ai", "inv_2", "inv_1", "inv_0")
    return rounded(out, "inv_2", "inv_1", "inv_0", digits=5)


def _power(k: int) -> str:
    return "w1 AS (SELECT DISTINCT mol, a0 AS ai, a1 AS nbr FROM edges)" + "".join(f", w{i} AS (SELECT DISTINCT w.mol, w.ai, e.a1 AS nbr FROM w{i - 1} w JOIN edges e ON e.mol = w.mol AND e.a0 = w.nbr)" for i in range(2, k + 1))


@query(f", {_power(5)}" + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT w.mol, w.ai, {k} AS k, count(*) AS hetero FROM w{k} w JOIN atoms a ON a.mol = w.mol AND a.ai = w.nbr LEFT JOIN w{max(1, k - 2)} v ON v.mol = w.mol AND v.ai = w.ai AND v.nbr = w.nbr WHERE w.ai <> w.nbr AND a.atom NOT IN ('C', 'H') AND v.mol IS NULL GROUP BY ALL" for k in range(2, 6)) + ")")
def molecule_hetero_within(spark, d):
    e, a = edges(spark, d), atoms(spark, d)
    parts = [molecules.hetero_within(e, a, k).select("mol", "ai", F.lit(k).alias("k"), F.col(f"hetero_{k}").alias("hetero")) for k in range(2, 6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MID = [f"(o.{c} - (p.{c} + q.{c}) / 2)" for c in "xyz"]
FAR = f"sqrt({' + '.join(f'{m} * {m}' for m in MID)})"


@query(f"""{FACTS}, o AS (SELECT t.id, o.en / nullif({FAR} * {FAR}, 0) AS w, trunc(4 * {_cos(MID, _line("p", "q"))})::INTEGER AS bin FROM {TARGETS} t JOIN facts p ON p.mol = t.mol AND p.ai = t.a0 JOIN facts q ON q.mol = t.mol AND q.ai = t.a1 JOIN facts o ON o.mol = t.mol AND o.ai <> t.a0 AND o.ai <> t.a1 WHERE {FAR} <= 6)
SELECT id, round(coalesce(sum(w) FILTER (bin BETWEEN -3 AND 3), 0), 3) AS total, round(coalesce(sum(w) FILTER (bin = 0), 0), 3) AS region_3 FROM {TARGETS} LEFT JOIN o USING (id) GROUP BY id""")
def molecule_conical_regions(spark, d):
    out = molecules.conical_regions(target_pairs(spark, d), atoms(spark, d))
    total = sum((F.col(f"region_{i}") for i in range(7)), F.lit(0.0))
    return rounded(out.select("id", total.alias("total"), "region_3"), "total", "region_3", digits=3)


# --- panel ----------------------------------------------------------------------------


def _duration(ids: str, name: str) -> str:
    keys = " AND ".join(f"b.{i} = m.{i}" for i in ids.split(", "))
    return f"coalesce(month - (SELECT max(b.month) FROM cm b WHERE {keys} AND b.month < m.month AND b.cnt <> 0), -10) AS {name}_age, coalesce(month - min(month) FILTER (cnt <> 0) OVER (PARTITION BY {ids}), 0) AS {name}_oldness"


@query(f""", cm AS (SELECT *, item_id % 7 AS category_id FROM monthly) SELECT shop_id, item_id, month, {", ".join(_duration(*x) for x in (("item_id", "item"), ("shop_id", "shop"), ("category_id", "category"), ("shop_id, category_id", "shop_category"), ("shop_id, item_id", "shop_item")))} FROM cm m""")
def panel_durations(spark, d):
    m = monthly(spark, d).withColumn("category_id", (F.col("item_id") % 7).cast("int"))
    out = panel.duration_features(m, m)
    return out.select("shop_id", "item_id", "month", *[c for c in out.columns if c.endswith(("_age", "_oldness"))])


@query(""", test AS (SELECT DISTINCT shop_id, item_id FROM monthly WHERE month >= 60) SELECT t.shop_id, t.item_id, 80 AS month, coalesce(m.cnt, -10) AS cnt_lag1 FROM test t LEFT JOIN monthly m ON m.shop_id = t.shop_id AND m.item_id = t.item_id AND m.month = 79""")
def panel_future_month(spark, d):
    m = monthly(spark, d)
    test = m.where("month >= 60").select("shop_id", "item_id").distinct()
    return panel.with_future_month(m, test, 80, lambda x: panel.month_lag(x, "cnt", 1))[1].select("shop_id", "item_id", "month", "cnt_lag1")


@query("SELECT shop_id, item_id, month, island FROM (SELECT *, sum(turn) OVER (PARTITION BY shop_id, item_id ORDER BY month) AS island FROM (SELECT shop_id, item_id, month, CASE WHEN (cnt > 30) IS DISTINCT FROM lag(cnt > 30) OVER (PARTITION BY shop_id, item_id ORDER BY month) THEN 1 ELSE 0 END AS turn FROM monthly))")
def panel_islands(spark, d):
    return panel.islands(monthly(spark, d).withColumn("high", F.col("cnt") > 30), ["shop_id", "item_id"], ["month"], "high").select("shop_id", "item_id", "month", "island")


@query("SELECT shop_id, item_id, month, greatest(price - 1000, 0) AS price, least(cnt, 20) AS cnt FROM monthly")
def panel_clean_sales(spark, d):
    return panel.clean_sales(monthly(spark, d).withColumn("price", F.col("price") - 1000).select("shop_id", "item_id", "month", "price", "cnt"), max_count=20)


@query("SELECT month, count(*) AS n FROM monthly GROUP BY month UNION ALL SELECT -1, count(*) FROM monthly")
def panel_sampled_fill(spark, d):
    """Rows of each month, doubled where ``zero_share`` is a half and enough new pairs exist, less the new ones."""
    dense = panel.sampled_fill(panel.densify(monthly(spark, d), base_year=1992), zero_share=0.5).where("not is_new")
    per = dense.groupBy("month").agg(F.count("*").alias("n"))
    return per.unionByName(dense.agg(F.lit(-1).alias("month"), F.count("*").alias("n")))


# --- tables ---------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice >= 150000 THEN 2 ELSE 1 END AS class, o_totalprice >= 150000 AS high, o_totalprice < 50000 AS low FROM orders")
def frame_recoded(spark, d):
    c = discretised(F.col("o_totalprice"), 50000, 150000)
    return table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).withColumns({"class": c, "high": c == 2, "low": c == 0})


@query("SELECT s_suppkey, CASE split_part(s_name, ' ', 1) WHEN 'Supplier' THEN 'S' ELSE split_part(s_name, ' ', 1) END AS token, coalesce(lon, -1) AS lon, coalesce(lat, -1) AS lat FROM supplier LEFT JOIN (SELECT n_nationkey AS s_nationkey, n_nationkey * 3.5::DOUBLE AS lon, n_regionkey * 2.0::DOUBLE AS lat FROM nation WHERE n_nationkey % 2 = 0) USING (s_nationkey)")
def frame_lookup(spark, d):
    places = table(spark, d, "nation", ["n_nationkey", "n_regionkey"]).where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") * 3.5).alias("lon"), (F.col("n_regionkey") * 2.0).alias("lat"))
    out = frames.lookup(table(spark, d, "supplier", ["s_suppkey", "s_name", "s_nationkey"]), places, "s_nationkey", ["lon", "lat"])
    return out.select("s_suppkey", first_token(F.col("s_name"), {"Supplier": "S"}).alias("token"), "lon", "lat")


@query("SELECT n_nationkey, round(2 * 6371 * asin(sin(radians(n_nationkey + 1) / 2) * cos(radians(n_nationkey + n_regionkey + 1.0))) * radians(2) * 6371, 3) AS area FROM nation")
def frame_box_area(spark, d):
    n = table(spark, d, "nation", ["n_nationkey", "n_regionkey"])
    south = (F.col("n_nationkey") + F.col("n_regionkey")).cast("double")
    return rounded(n.select("n_nationkey", box_area(south, south + 2, F.lit(0.0), F.col("n_nationkey") + 1.0).alias("area")), "area", digits=3)


@query(r"SELECT page_id, regexp_extract(url, '([^/]*?)(\.[^./]*)?$', 1) AS base, regexp_extract(url, '\.([^./]*)$', 1) AS kind FROM pages")
def frame_file_names(spark, d):
    return table(spark, d, "pages", ["page_id", "url"]).select("page_id", base_name(F.col("url")).alias("base"), extension(F.col("url")).alias("kind"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def frame_semi_join(spark, d):
    f = table(spark, d, "orders", ["o_custkey", "o_orderstatus"]).where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return frames.having(table(spark, d, "customer", ["c_custkey", "c_nationkey"]), f, ["c_custkey"])


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
def frame_only_in_first(spark, d):
    li = table(spark, d, "lineitem", ["l_partkey", "l_quantity"])
    return frames.only_in_first(li.where("l_quantity > 49"), li.where("l_quantity < 5"), ["l_partkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def frame_anti_join(spark, d):
    f = table(spark, d, "orders", ["o_custkey", "o_orderstatus"]).where("o_orderstatus = 'F'")
    return table(spark, d, "customer", ["c_custkey"]).join(f, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus <> 'P') AS price FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def frame_first_value(spark, d):
    o = table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"]).withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return frames.first_value(o, ["o_custkey"], "price", "o_orderkey")


@query("SELECT c_custkey, n, total FROM (SELECT c_custkey FROM customer) LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey) LEFT JOIN (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) USING (c_custkey)")
def frame_side_by_side(spark, d):
    o = table(spark, d, "orders", ["o_custkey", "o_totalprice"]).withColumnRenamed("o_custkey", "c_custkey")
    parts = [table(spark, d, "customer", ["c_custkey"]), o.groupBy("c_custkey").agg(F.count("*").alias("n")), o.groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))]
    return frames.side_by_side(parts, "c_custkey")


@query("SELECT field, max(value) FILTER (n_regionkey = 0) AS \"0\", max(value) FILTER (n_regionkey = 1) AS \"1\" FROM (SELECT n_regionkey, unnest(['n', 'top']) AS field, unnest([count(*), max(n_nationkey)]) AS value FROM nation GROUP BY 1) GROUP BY field")
def frame_transposed(spark, d):
    per = table(spark, d, "nation", ["n_nationkey", "n_regionkey"]).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("n_nationkey").cast("long").alias("top"))
    return frames.transposed(per, "n_regionkey", ["n", "top"], [0, 1])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN -100000 AND 100000")
def frame_checked(spark, d):
    return frames.checked(frames.without(table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_name"]), ["c_name"]), "c_acctbal", -100000, 100000)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def frame_sorted(spark, d):
    return frames.sorted_by(table(spark, d, "orders", ["o_orderkey", "o_orderdate"]), ["o_orderdate", "o_orderkey"], ("o_orderdate",)).select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders")
def frame_numbered(spark, d):
    return frames.numbered(table(spark, d, "orders", ["o_orderkey", "o_orderdate"]), ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS \"c_mktsegment_BUILDING\", c_mktsegment = 'MACHINERY' AS \"c_mktsegment_MACHINERY\" FROM customer WHERE c_custkey % 2 = 0")
def frame_one_hot(spark, d):
    c = table(spark, d, "customer", ["c_custkey", "c_mktsegment"])
    got = frames.one_hot(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY')"), ["c_mktsegment"])
    return got[0]


@query("SELECT avg((c_acctbal < 0)::INTEGER)::DOUBLE AS c_acctbal, 0.0::DOUBLE AS c_custkey FROM customer")
def frame_null_shares(spark, d):
    return frames.null_shares(table(spark, d, "customer", ["c_custkey", "c_acctbal"]).withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))))


@query("SELECT 'same' AS name")
def frame_constant_columns(spark, d):
    df = table(spark, d, "customer", ["c_custkey", "c_mktsegment"]).withColumn("same", F.lit(1))
    return spark.createDataFrame([(c,) for c in frames.constant_columns(df)], "name string")


@query("SELECT signal_id, t, value FROM sig WHERE t % 100 >= 10 AND t % 100 < 30 AND t > 49")
def frame_positional(spark, d):
    return frames.skip_first(frames.positional(signal(spark, d), "t", 100, 10, 30), "t", 100, 0.5)


@query("SELECT o_orderkey, o_totalprice::FLOAT AS o_totalprice FROM orders")
def frame_downcast(spark, d):
    return frames.downcast(table(spark, d, "orders", ["o_orderkey", "o_totalprice"]))


@query("SELECT o_orderpriority, fold, n FROM (SELECT o_orderpriority, count(*) AS m FROM orders GROUP BY 1) p, (SELECT 0 AS fold UNION ALL SELECT 1) f, LATERAL (SELECT true AS n) x")
def frame_stratified_fold(spark, d):
    """Whether each of two folds holds half of every priority, to within the number of hash blocks."""
    got = evaluation.stratified_fold(table(spark, d, "orders", ["o_orderkey", "o_orderpriority"]), "o_orderkey", "o_orderpriority", 2).groupBy("o_orderpriority", "fold").agg(F.count("*").alias("k"))
    return got.withColumn("all", F.sum("k").over(W.partitionBy("o_orderpriority"))).select("o_orderpriority", "fold", (F.abs(2 * F.col("k") - F.col("all")) <= 128).alias("n"))


# --- signals --------------------------------------------------------------------------


@query("SELECT signal_id, t, round(avg(value) OVER (PARTITION BY signal_id, t // 40 ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 7) AS mean FROM sig WHERE t // 40 < (SELECT (max(s.t) + 1) // 40 FROM sig s WHERE s.signal_id = sig.signal_id)")
def signal_tumbling(spark, d):
    out = signals.tumbling(signal(spark, d), 40, key="signal_id")
    return rounded(out.withColumn("mean", F.avg("value").over(W.partitionBy("signal_id", "chunk"))).select("signal_id", "t", "mean"), "mean")


@query("SELECT signal_id, t, CASE WHEN t // 50 >= (n - floor(n * 0.25)) * 1 THEN 'val' ELSE 'train' END AS part FROM sig, (SELECT (max(t // 50) + 1) AS n FROM sig)")
def signal_tail_split(spark, d):
    s = signal(spark, d).withColumn("chunk", F.floor(F.col("t") / 50))
    return signals.tail_split(s, chunk="chunk", segment=1, fraction=0.25).select("signal_id", "t", "part")


@query("SELECT signal_id, shift, (t + shift) % n AS t, value FROM sig JOIN (SELECT signal_id, count(*) AS n FROM sig GROUP BY 1) USING (signal_id), (SELECT 3 AS shift UNION ALL SELECT 7)")
def signal_rolled(spark, d):
    return signals.rolled(signal(spark, d), [3, 7], key="signal_id", pos="t").select("signal_id", "shift", "t", "value")


@query("SELECT signal_id, t, ((avg((value > 50)::INTEGER) OVER (PARTITION BY signal_id, t // 3)) >= 0.5)::INTEGER AS agreed FROM sig")
def signal_consensus(spark, d):
    s = signal(spark, d).withColumns({"g": F.concat_ws(":", "signal_id", F.floor(F.col("t") / 3)), "p": (F.col("value") > 50).cast("double")})
    return signals.consensus(s, group="g", prediction="p").select("signal_id", "t", "agreed")


GRID = """, f AS (SELECT signal_id, 'f' || (t % 4) AS feature, value FROM sig), s AS (SELECT signal_id, feature, avg(value) AS mean, avg(abs(value)) AS abs_mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90 FROM f GROUP BY ALL),
zs AS (SELECT signal_id, """ + ", ".join(f"abs(({n} - avg({n}) OVER w) / nullif(stddev_pop({n}) OVER w, 0)) AS {n}" for n in ("mean", "abs_mean", "std", "q50", "q10", "q90")) + """ FROM s WINDOW w AS (PARTITION BY feature)),
g AS (SELECT signal_id, z, share, (""" + " + ".join(f"((count(*) FILTER ({n} > z)) > floor(count(*) * share))::INTEGER" for n in ("mean", "abs_mean", "std", "q50", "q10", "q90")) + """) >= 2 AS out FROM zs, (SELECT unnest([0.5, 1.0, 1.5])::DOUBLE AS z) a, (SELECT unnest([0.3, 0.6])::DOUBLE AS share) b GROUP BY signal_id, z, share)"""


@query(f"{GRID} SELECT z, share, coalesce(round(100 * avg(CASE WHEN out THEN (signal_id % 3 = 0)::INTEGER END), 2), 0) AS percent FROM g GROUP BY ALL")
def signal_outlier_grid(spark, d):
    s = signal(spark, d)
    f = s.select("signal_id", F.concat(F.lit("f"), F.col("t") % 4).alias("feature"), "value")
    target = s.select("signal_id").distinct().withColumn("target", (F.col("signal_id") % 3 == 0).cast("int"))
    return signals.outlier_grid(f, target, [0.5, 1.0, 1.5], [0.3, 0.6], votes=2)


@query()
def signal_whole_pipeline(spark, d):
    return signals.whole_pipeline(signal(spark, d), 4, 512, threshold=20.0, distance=5, ratio=0.4, cleanup=2, width=3)


@query("SELECT signal_id, count(*) AS n, 1 AS batches FROM sig GROUP BY 1")
def signal_whole_groups(spark, d):
    return signals.whole_groups(signal(spark, d), "signal_id", 4).groupBy("signal_id").agg(F.count("*").alias("n"), F.count_distinct("batch").cast("int").alias("batches"))


# --- text and evaluation --------------------------------------------------------------

WEIGHTS = r""", t AS (SELECT p_partkey, p_brand, unnest(regexp_extract_all(lower(p_name || ' ' || p_partkey), '(\w\w+)', 1)) AS term FROM part), tf AS (SELECT p_partkey, p_brand, term, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term), wt AS (SELECT p_partkey, p_brand, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY p_partkey)) AS weight FROM tf JOIN idf USING (term)),
dots AS (SELECT a.p_brand, a.p_partkey, b.p_partkey AS nbr, sum(a.weight * b.weight) AS dot FROM wt a JOIN wt b ON a.p_brand = b.p_brand AND a.term = b.term AND a.p_partkey <> b.p_partkey GROUP BY ALL),
cand AS (SELECT a.p_brand, a.p_partkey, b.p_partkey AS nbr, round(sqrt(greatest(0, 2 - 2 * coalesce(dot, 0))), 6) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey LEFT JOIN dots ON dots.p_partkey = a.p_partkey AND dots.nbr = b.p_partkey)"""


@query(f"{WEIGHTS} SELECT p_brand, p_partkey, rank, distance FROM (SELECT p_brand, p_partkey, distance, row_number() OVER (PARTITION BY p_partkey ORDER BY distance) AS rank FROM cand) WHERE rank <= 3")
def text_neighbours(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_brand"])
    w = text.tf_idf(part.select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("p_name")), key="p_partkey", text="p_name")
    pool = part.select("p_partkey", "p_brand")
    near = text.bucket_neighbours(w, pool, pool, key="p_partkey", buckets=["p_brand"], k=3)
    return rounded(near.select("p_brand", "p_partkey", "rank", "distance"), "distance", digits=6)


def _item_near(spark) -> DataFrame:
    """Neighbours of the items, by number: item + 1 and item + 2 of 50, for every month."""
    return spark.range(50).select(F.col("id").alias("item_id")).withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("nbr", (F.col("item_id") + F.col("rank")) % 50)


@query(", near AS (SELECT i AS item_id, r AS rank, (i + r) % 50 AS nbr FROM range(50) a(i), range(1, 3) b(r)), v AS (SELECT m.shop_id, m.month, m.item_id, n.rank, coalesce(o.cnt, g.cnt) AS v FROM monthly m JOIN near n USING (item_id) LEFT JOIN monthly o ON o.shop_id = m.shop_id AND o.month = m.month AND o.item_id = n.nbr LEFT JOIN (SELECT month, item_id, avg(cnt) AS cnt FROM monthly GROUP BY ALL) g ON g.month = m.month AND g.item_id = n.nbr) SELECT shop_id, month, item_id, round(coalesce(avg(v) FILTER (rank = 1), -10), 6) AS \"1_neighbour_cnt\", round(coalesce(avg(v), -10), 6) AS \"2_neighbour_cnt\" FROM v GROUP BY ALL")
def text_neighbour_assembly(spark, d):
    m = monthly(spark, d)
    near = m.select("month", "item_id").distinct().join(_item_near(spark), "item_id")
    out = text.neighbour_assembly(m.select("shop_id", "month", "item_id"), near, m, key="item_id", values=["cnt"], ns=(1, 2))
    return rounded(out, "1_neighbour_cnt", "2_neighbour_cnt", digits=6)


@query()
def text_reduced(spark, d):
    part = table(spark, d, "part", ["p_partkey", "p_name"])
    return text.bring_text(part.select("p_partkey"), {"p_partkey": (text.text_table(part, "p_partkey", "p_name", 3), 2)})


@query("SELECT id, round(CASE WHEN avg_d <= 5 THEN (0.4 * a + 0.4 * b + 0.2 * c) / 1.0 ELSE ((CASE WHEN da / avg_d < 1.2 THEN 0.4 * a ELSE 0 END) + (CASE WHEN db / avg_d < 1.2 THEN 0.4 * b ELSE 0 END) + (CASE WHEN dc / avg_d < 1.2 THEN 0.2 * c ELSE 0 END)) / nullif((CASE WHEN da / avg_d < 1.2 THEN 0.4 ELSE 0 END) + (CASE WHEN db / avg_d < 1.2 THEN 0.4 ELSE 0 END) + (CASE WHEN dc / avg_d < 1.2 THEN 0.2 ELSE 0 END), 0) END, 6) AS blend FROM (SELECT *, (da + db + dc) / 3 AS avg_d FROM (SELECT id, a, b, truth * 0.5 AS c, (abs(a - b) + abs(a - truth * 0.5)) / 2 AS da, (abs(b - a) + abs(b - truth * 0.5)) / 2 AS db, (abs(truth * 0.5 - a) + abs(truth * 0.5 - b)) / 2 AS dc FROM preds))")
def eval_robust_blend(spark, d):
    p = predictions(spark, d).withColumn("c", F.col("truth") * 0.5)
    return rounded(evaluation.robust_blend(p, ["a", "b", "c"], [0.4, 0.4, 0.2], ratio=1.2).select("id", "blend"), "blend", digits=6)


@query("SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM (VALUES ('x', 0.5::DOUBLE), ('y', 0.7), ('z', 0.5)) v(feature, importance)")
def eval_ranked_importance(spark, d):
    return evaluation.ranked_importance(spark, {"z": 0.5, "y": 0.7, "x": 0.5})


@query("SELECT count(*) AS n, sum(id)::BIGINT AS ids, round(sum(a), 2) AS a FROM preds")
def eval_permuted(spark, d):
    """A shuffled column keeps its values."""
    out = evaluation.permuted(predictions(spark, d).select("id", "a"), "a", key="id")
    return out.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.round(F.sum("a"), 2).alias("a"))


@query("SELECT count(*) AS n, (sum(o_orderkey))::BIGINT AS keys, 0 AS first, count(*) - 1 AS last FROM orders")
def source_numbered(spark, d):
    out = tables.numbered(table(spark, d, "orders", ["o_orderkey"]))
    return out.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.min("pos").cast("int").alias("first"), F.max("pos").alias("last"))


@query("SELECT shop_id, item_id, month, cnt FROM monthly WHERE cnt > 100")
def panel_large_sales(spark, d):
    return panel.monthly_rollup(sales(spark, d)).where("cnt > 100").select("shop_id", "item_id", "month", "cnt")
