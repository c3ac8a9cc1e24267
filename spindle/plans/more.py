"""Further registered queries and their SQL: sets, charges, guides, traces, curves."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import bonding, curves, dynamics, elastic, electrostatics, fields, graph, selection, sequence, volume
from ..structure import Structure
from .queries import BF, CORE, FIL, MAC, MOD, ORACLES, P3, PD2, PWIDE, QUERIES, S3, WIDE, _sets, el, group, query, rounded
from .testtables import duck, orders_structure, points_structure, table

Q = selection

# Sets --------------------------------------------------------------------------------------


@query(S3 + f""", w AS (SELECT *, CASE WHEN lag(residue) OVER (PARTITION BY chain ORDER BY atom) IS NOT DISTINCT FROM residue THEN 0 ELSE 1 END AS n FROM {WIDE}),
 r AS (SELECT *, sum(n) OVER (PARTITION BY chain ORDER BY atom) AS run FROM w),
 f AS (SELECT *, first_value(bfactor) OVER (PARTITION BY chain, run ORDER BY atom) AS fb FROM r)
 SELECT atom FROM f WHERE bfactor > 10 AND fb < 30""")
def atom_groups_run_starts(spark, d):
    return _sets(spark, d, group(residue_test=["core.rel.lt", BF, 30], atom_test=["core.rel.gr", BF, 10]), orders_structure)


@query(P3 + " SELECT atom FROM points WHERE residue IN (SELECT residue FROM points WHERE element = 16) AND element = 8")
def intersect_by(spark, d):
    return _sets(spark, d, [MOD + "intersect-by", [MOD + "whole-residues", el(16)], {"by": el(8)}])


@query(P3 + " SELECT CAST(0 AS BIGINT) AS set_id, atom FROM points WHERE element IN (6, 7)")
def union_of_sets(spark, d):
    sets = group(atom_test=["core.set.has", ["core.type.set", 6, 7], [CORE + "atomic-number"]], group_by=[MAC + "residue-key"])
    return expr.evaluate(points_structure(spark, d), [MOD + "union", sets]).rows.select("set_id", "atom")


@query(P3 + """, a AS (SELECT residue, list(atom ORDER BY atom) AS atoms FROM points WHERE element = 7 GROUP BY residue UNION ALL
 SELECT residue, list(atom ORDER BY atom) FROM points WHERE element IN (7, 16) GROUP BY residue)
 SELECT CAST(count(*) AS BIGINT) AS n_sets, CAST(sum(k) AS BIGINT) AS n_atoms FROM (SELECT atoms, len(atoms) AS k FROM (SELECT DISTINCT atoms FROM a))""")
def merge_distinct_sets(spark, d):
    key = [MAC + "residue-key"]
    few = group(atom_test=["core.rel.eq", [CORE + "atomic-number"], 7], group_by=key)
    more = group(atom_test=["core.set.has", ["core.type.set", 7, 16], [CORE + "atomic-number"]], group_by=key)
    rows = expr.evaluate(points_structure(spark, d), ["structure-query.combinator.merge", few, more]).rows
    return rows.agg(F.countDistinct("set_id").alias("n_sets"), F.count("*").alias("n_atoms"))


@query(P3 + " SELECT atom FROM points WHERE element = 7 AND residue = (SELECT residue FROM points WHERE element = 7 ORDER BY atom LIMIT 1)")
def first_set(spark, d):
    sets = group(atom_test=["core.rel.eq", [CORE + "atomic-number"], 7], group_by=[MAC + "residue-key"])
    return _sets(spark, d, [FIL + "first", sets])


RADII = "CASE element WHEN 6 THEN 1.7 WHEN 7 THEN 1.55 WHEN 8 THEN 1.52 ELSE 1.8 END"


@query(P3 + f", v AS (SELECT *, {RADII} AS r FROM points) SELECT DISTINCT p.atom FROM v p JOIN v q ON p.element = 8 AND q.element = 16 AND greatest(0, sqrt({PD2}) - p.r - q.r) <= 0.3")
def within_gap(spark, d):
    return _sets(spark, d, [FIL + "within", el(8), {"target": el(16), "min-radius": 0, "max-radius": 0.3, "atom-radius": [CORE + "vdw"]}])


@query(P3 + f""", v AS (SELECT *, {RADII} AS r FROM points) SELECT atom FROM points WHERE element = 8 AND atom NOT IN
 (SELECT p.atom FROM v p JOIN v q ON p.element = 8 AND q.element = 16 AND sqrt({PD2}) <= 0.5 + p.r)""")
def within_inverted(spark, d):
    return _sets(spark, d, [FIL + "within", el(8), {"target": el(16), "max-radius": 0.5, "invert": True}])


@query(P3 + " SELECT atom FROM points WHERE element = 119")
def within_unknown_radius(spark, d):
    """Atoms of elements without a radius are near nothing in the mode that adds the atom's own."""
    s = points_structure(spark, d)
    s = replace(s, atoms=s.atoms.withColumn("element", F.when(F.col("element") == 8, F.lit(118)).otherwise(F.col("element")).cast("short")))
    return expr.evaluate(s, [FIL + "within", el(118), {"target": el(16), "max-radius": 50}]).flat()


@query(S3 + f""", u AS MATERIALIZED (SELECT a.atom, a.residue, a.x, a.y, a.z, a.bfactor, a.element, CASE c.entityType WHEN 'water' THEN 1 WHEN 'polymer' THEN 2 ELSE 0 END AS kind
 FROM atoms a JOIN residues r USING (residue) JOIN chains c USING (chain)),
 i AS MATERIALIZED (SELECT atom, x, y, z FROM u WHERE bfactor = 50 AND element = 7),
 n AS MATERIALIZED (SELECT DISTINCT p.residue FROM u p JOIN i q ON {PD2} <= 0.25 WHERE p.kind = 0),
 e AS MATERIALIZED (SELECT DISTINCT residue FROM u),
 l AS MATERIALIZED (SELECT p.residue AS a, q.residue AS b FROM e p JOIN e q ON p.residue % 5 = 0 AND q.residue = p.residue + 7),
 c AS MATERIALIZED (SELECT residue FROM n UNION SELECT b FROM l JOIN n ON a = residue UNION SELECT a FROM l JOIN n ON b = residue),
 m AS MATERIALIZED (SELECT atom, x, y, z FROM i UNION SELECT atom, x, y, z FROM u JOIN c USING (residue) WHERE kind <> 1)
 SELECT atom FROM m UNION SELECT p.atom FROM u p JOIN m q ON p.kind = 1 AND {PD2} <= 0.25""")
def surrounding_ligands(spark, d):
    s = orders_structure(spark, d)
    first = s.atoms.groupBy("residue").agg(F.min("atom").alias("atom"))
    ends = first.select("residue", F.col("atom").alias("a")).filter("residue % 5 = 0").withColumn("to", F.col("residue") + 7)
    links = ends.join(first.select(F.col("residue").alias("to"), F.col("atom").alias("b")), "to")
    links = links.select(F.col("residue").alias("link"), "a", "b", F.lit(1).alias("order"), F.lit(1).alias("flags"), F.lit("struct_conn").alias("source"))
    inner = group(atom_test=["core.logic.and", ["core.rel.eq", BF, 50], ["core.rel.eq", [CORE + "atomic-number"], 7]])
    return expr.evaluate(replace(s, links=links), [MOD + "surrounding-ligands", inner, {"radius": 0.5, "include-water": True}]).flat()


@query(S3 + f" SELECT atom FROM {WIDE} WHERE model = 1 AND bfactor < 20")
def all_conformers_view(spark, d):
    return Q.resolve(Q.all_conformers(Q.model(1) & Q.attribute("bfactor", lambda c: c < 20)), orders_structure(spark, d)).ids


@query(S3 + f" SELECT atom FROM {WIDE} WHERE element = 3 AND altloc IN ('', 'R') AND model = (SELECT model FROM chains ORDER BY chain LIMIT 1)")
def with_view(spark, d):
    return Q.resolve(Q.with_view(Q.element(3), model="first", altloc="R"), orders_structure(spark, d)).ids


@query(P3 + " SELECT atom FROM points JOIN presidues USING (residue) WHERE polymer = 'other' AND residue % 10 = 0")
def ligand(spark, d):
    s = points_structure(spark, d)
    named = s.residues.withColumn("comp", F.when(F.col("residue") % 10 == 0, "LIG").otherwise(F.col("comp")))
    return Q.resolve(Q.ligand(), replace(s, residues=named)).ids


@query(S3 + f" SELECT atom FROM {WIDE} WHERE labelId IN ('L17', 'L21') OR authId = 'Customer#000000005'")
def chain_ids(spark, d):
    q = Q.chain("L17", "label") | Q.chain("L21", "label") | Q.chain("Customer#000000005")
    return Q.resolve(q, orders_structure(spark, d)).ids


@query(S3 + f" SELECT atom FROM {WIDE} WHERE bfactor > 45 AND comp = '5-LOW'")
def compiled_expression(spark, d):
    low = ["core.rel.eq", [MAC + "label_comp_id"], "5-LOW"]
    q = Q.compile_(group(atom_test=["core.logic.and", ["core.rel.gr", BF, 45], low]), "hot and low")
    return Q.resolve(q, orders_structure(spark, d)).ids


@query(S3 + f" SELECT atom, altloc = 'A' AND name = 'F' AS a, entityType = 'water' AS b, entityId AS c FROM {WIDE}")
def expr_lists_and_entities(spark, d):
    s = orders_structure(spark, d)
    pair = ["core.type.list", [MAC + "label_alt_id"], [MAC + "label_atom_id"]]
    trees = {"a": ["core.list.equal", pair, ["core.type.list", "A", "F"]], "b": ["core.rel.eq", [MAC + "entity-type"], "water"], "c": [MAC + "label_entity_id"]}
    return s.wide().select("atom", *(expr.scalar(t).col.alias(n) for n, t in trees.items()))


# Fields ------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(quality, -1)::FLOAT AS q, coalesce(toxic, 7)::FLOAT AS t FROM documents LEFT JOIN labels USING (doc_id)")
def annotation_missing(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id").join(labels, "doc_id", "left")
    return fields.evaluate(rows, "doc_id", q=fields.annotation("residue", "quality", fallback=-1.0), t=fields.annotation("residue", "toxic", fallback=7.0))


@query(S3 + " SELECT residue, model, labelId AS \"chainLabel\", authId AS \"chainAuth\", labelSeq AS \"labelSeq\", authSeq AS \"authSeq\", insertionCode AS \"insCode\", comp FROM residues JOIN chains USING (chain)")
def residue_identity(spark, d):
    return fields.residue_identity(orders_structure(spark, d)).select("residue", "identity.*")


LINEAR = volume.Grid((20, 20, 20), (2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, -20, -20, -20, 1))


def _linear(spark) -> DataFrame:
    return volume.grid_points(spark, LINEAR).select("i", "j", "k", F.expr("CAST(3 * i + 5 * j + 7 * k AS DOUBLE)").alias("v"))


@query(P3 + " SELECT atom, round(CAST(CASE WHEN x BETWEEN -20 AND 18 AND y BETWEEN -20 AND 18 AND z BETWEEN -20 AND 18 THEN 3 * (x + 20) / 2 + 5 * (y + 20) / 2 + 7 * (z + 20) / 2 ELSE 0 END AS DOUBLE), 2) AS v FROM points")
def volume_field(spark, d):
    at = points_structure(spark, d).atoms
    rows = fields.with_volume(at.select("atom", "x", "y", "z"), "atom", _linear(spark), LINEAR, "phi")
    return rounded(fields.evaluate(rows, "atom", v=fields.volume_sample("phi")), "v", digits=2)


@query(P3 + ", i AS (SELECT atom, x BETWEEN -19.5 AND 17.5 AND y BETWEEN -19.5 AND 17.5 AND z BETWEEN -19.5 AND 17.5 AS inside FROM points) SELECT atom AS point, "
       "CASE WHEN inside THEN 1.5 ELSE 0 END::DOUBLE AS gx, CASE WHEN inside THEN 2.5 ELSE 0 END::DOUBLE AS gy, CASE WHEN inside THEN 3.5 ELSE 0 END::DOUBLE AS gz FROM i")
def gradient(spark, d):
    points = points_structure(spark, d).atoms.withColumnRenamed("atom", "point")
    return rounded(volume.gradient(points, _linear(spark), LINEAR, 0.5), "gx", "gy", "gz")


# Charges -----------------------------------------------------------------------------------

VACUUM = electrostatics.Electrostatics("vacuum", unit="kcal/mol/e")
SWITCHED = electrostatics.Electrostatics("distance", unit="kT/e", cutoff=4.0, switch_width=2.0)
DEBYE = electrostatics.Electrostatics("debye", unit="kT/e")


def _charges(spark, d) -> tuple[DataFrame, DataFrame]:
    at = points_structure(spark, d).atoms
    return at.filter("element = 16").withColumnRenamed("atom", "point"), at.withColumn("q", F.col("bfactor").cast("double") - 4)


def _sums(g: str, on: str, scale: float, cols: dict) -> str:
    """SQL: sums over charges q of points p, where u is the squared distance and r its root."""
    body = ", ".join(f"round({scale!r} * coalesce(sum({v.format(g=g)}), 0), 3) AS {k}" for k, v in cols.items())
    return P3 + f""", c AS (SELECT atom, x, y, z, bfactor - 4 AS q FROM points WHERE bfactor <> 4), s AS (SELECT p.atom AS point, q.q, p.x - q.x AS dx, p.y - q.y AS dy, p.z - q.z AS dz, {PD2} AS u, sqrt({PD2}) AS r
 FROM points p JOIN c q ON p.element = 16 {on}) SELECT point, {body} FROM (SELECT atom AS point FROM points WHERE element = 16) LEFT JOIN s USING (point) GROUP BY point"""


@query(_sums("q * (CASE WHEN r <= 2 THEN 1 ELSE (16 - u) * (16 - u) * (16 + 2 * u - 12) / 1728 END) / greatest(u, 1)", f"AND {PD2} <= 16", SWITCHED.scale, {"phi": "{g}"}))
def potential_switched(spark, d):
    return rounded(electrostatics.potential(*_charges(spark, d), SWITCHED), "phi")


@query(_sums(f"q * exp(-{DEBYE.kappa!r} * greatest(r, 1)) / greatest(r, 1)", "", DEBYE.scale, {"phi": "{g}"}))
def potential_debye(spark, d):
    return rounded(electrostatics.potential(*_charges(spark, d), DEBYE), "phi")


@query(_sums("q * CASE WHEN r < 1 THEN 0 ELSE 1 / (u * r) END", "", VACUUM.scale, {"ex": "{g} * dx", "ey": "{g} * dy", "ez": "{g} * dz"}))
def coulomb_field(spark, d):
    return rounded(electrostatics.field(*_charges(spark, d), VACUUM), "ex", "ey", "ez")


SMALL = volume.Grid((4, 3, 2), (10, 0, 0, 0, 0, 10, 0, 0, 0, 0, 20, 0, -15, -10, -10, 1))


@query(duck("points") + f""" SELECT CAST(i.i AS INT) AS i, CAST(j.j AS INT) AS j, CAST(k.k AS INT) AS k, round({VACUUM.scale!r} * sum((bfactor - 4) / greatest(1, sqrt((x - (10 * i.i - 15)) ** 2 + (y - (10 * j.j - 10)) ** 2 + (z - (20 * k.k - 10)) ** 2))), 2) AS v
 FROM points, (SELECT unnest(range(4)) AS i) i, (SELECT unnest(range(3)) AS j) j, (SELECT unnest(range(2)) AS k) k GROUP BY 1, 2, 3""")
def coulomb_grid(spark, d):
    return rounded(electrostatics.coulomb_grid(spark, SMALL, _charges(spark, d)[1], VACUUM), "v", digits=2)


# Guides, springs, groups -------------------------------------------------------------------


@query(P3 + " SELECT residue AS component, count(*) AS n, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z FROM points GROUP BY residue")
def component_centroids(spark, d):
    at = points_structure(spark, d).atoms
    parts = at.select(F.col("atom").alias("node"), F.col("residue").alias("component"))
    return rounded(dynamics.component_centroids(at, parts), "x", "y", "z", digits=4)


@query("SELECT count(*) AS n, round(CAST(sum(value * value + user_id * user_id % 7) / (count(*) * 3 * 0.0019872043) AS DOUBLE), 1) AS temperature FROM events")
def kinetic_temperature(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    v = ev.select(F.col("event_id").alias("atom"), F.col("value").alias("vx"), F.sqrt(F.expr("CAST(user_id * user_id % 7 AS DOUBLE)")).alias("vy"), F.lit(0.0).alias("vz"))
    return rounded(dynamics.kinetic_temperature(v), "temperature", digits=1)


GUIDES = f"SELECT residue, min(atom) AS atom FROM {PWIDE} WHERE name = 'CA' AND polymer = 'protein' AND model = (SELECT model FROM {PWIDE} ORDER BY atom LIMIT 1) GROUP BY residue"


@query(P3 + f", g AS ({GUIDES}) SELECT CAST(row_number() OVER (ORDER BY atom) - 1 AS BIGINT) AS node, atom, residue FROM g")
def ca_guides(spark, d):
    return elastic.ca_guides(points_structure(spark, d)).select("node", "atom", "residue")


@query(P3 + f", g AS ({GUIDES}) SELECT p.atom, g.atom AS guide FROM points p LEFT JOIN g USING (residue)")
def residue_guide_map(spark, d):
    s = points_structure(spark, d)
    return elastic.residue_guide_map(s, elastic.ca_guides(s))


@query(P3 + f", g AS (SELECT atom, residue, x, y, z FROM points JOIN ({GUIDES}) USING (residue, atom)) SELECT p.atom AS a, q.atom AS b, round(sqrt({PD2}), 4) AS rest FROM g p JOIN g q ON p.atom < q.atom AND {PD2} <= 144")
def springs(spark, d):
    return rounded(elastic.springs(elastic.ca_guides(points_structure(spark, d)), 12.0).select("a", "b", "rest"), "rest", digits=4)


@query(P3 + f""", g AS (SELECT atom, residue, x, y, z FROM points JOIN ({GUIDES}) USING (residue, atom)), e AS (SELECT p.atom AS node, q.atom AS other FROM g p JOIN g q ON p.atom <> q.atom AND {PD2} <= 144),
 n AS (SELECT node, count(*) AS degree, string_agg(CAST(other AS STRING), ' ' ORDER BY other) AS neighbours FROM e GROUP BY node)
 SELECT node, neighbours, CAST(sum(degree) OVER (ORDER BY node) - degree AS BIGINT) AS first FROM n""")
def spring_rows(spark, d):
    rows = elastic.spring_rows(elastic.springs(elastic.ca_guides(points_structure(spark, d)), 12.0))
    return rows.select("node", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"), "first")


@query(P3 + f", s AS (SELECT p.atom AS a, q.atom AS b, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, sqrt({PD2}) AS d FROM points p JOIN points q ON p.atom < q.atom AND {PD2} <= 2.25) "
       "SELECT a, b, round(CASE WHEN d > 0 THEN (bx - ax) / d END, 3) AS ux, round(CASE WHEN d > 0 THEN (by_ - ay) / d END, 3) AS uy, round(CASE WHEN d > 0 THEN (bz - az) / d END, 3) AS uz FROM s")
def elastic_pairs(spark, d):
    return rounded(dynamics.elastic_pairs(points_structure(spark, d).atoms, 1.5), "ux", "uy", "uz")


def _bare(spark, d) -> Structure:
    """The points without bonds, one model, with connections between some residues of different chains."""
    s = points_structure(spark, d)
    ends = s.atoms.filter("atom % 40 = 0").select(F.col("atom").alias("a"), (F.col("atom") + 101).alias("b"))
    links = ends.join(s.atoms.select(F.col("atom").alias("b")), "b").select(F.col("a").alias("link"), "a", "b", F.lit(1).alias("order"), F.lit(1).alias("flags"), F.lit("struct_conn").alias("source"))
    return replace(s, bonds=None, links=links)


PAIR = "CASE WHEN p.element = q.element THEN CASE p.element WHEN 6 THEN 1.75 WHEN 7 THEN 1.6 WHEN 8 THEN 1.6 ELSE 2.3 END WHEN least(p.element, q.element) = 6 AND greatest(p.element, q.element) = 7 THEN 1.6 WHEN least(p.element, q.element) = 6 AND greatest(p.element, q.element) = 8 THEN 1.59 WHEN least(p.element, q.element) = 6 THEN 2.0 WHEN least(p.element, q.element) = 8 THEN 1.8 WHEN greatest(p.element, q.element) = 8 THEN (1.6 + 1.52) / 1.95 ELSE (1.6 + 1.9) / 1.95 END"


@query(P3 + f""", w AS {PWIDE}, k AS (SELECT p.atom AS a, q.atom AS b, p.residue AS ra, q.residue AS rb, p.chain AS ca, q.chain AS cb, {PD2} AS d2 FROM w p JOIN w q ON p.atom % 40 = 0 AND q.atom = p.atom + 101),
 n AS (SELECT p.atom AS a, q.atom AS b FROM w p JOIN w q ON p.atom < q.atom AND {PD2} > 0 AND sqrt({PD2}) <= {PAIR}
 WHERE NOT EXISTS (SELECT 1 FROM k WHERE least(ra, rb) = least(p.residue, q.residue) AND greatest(ra, rb) = greatest(p.residue, q.residue))
 AND NOT (p.chain <> q.chain AND EXISTS (SELECT 1 FROM k WHERE (k.a = p.atom AND k.cb = q.chain) OR (k.b = p.atom AND k.ca = q.chain) OR (k.a = q.atom AND k.cb = p.chain) OR (k.b = q.atom AND k.ca = p.chain))))
 SELECT a, b, 33 AS flags FROM n UNION ALL SELECT a, b, 1 FROM k WHERE ca = cb OR d2 <= 16""")
def computed_bonds(spark, d):
    return bonding.computed_bonds(_bare(spark, d)).select("a", "b", "flags")


@query(P3 + " SELECT least(a, b) AS a, greatest(a, b) AS b FROM pbonds GROUP BY 1, 2")
def preserved_bonds(spark, d):
    s = points_structure(spark, d)
    moved = s.with_positions(s.atoms.select("atom", (F.col("x") + 100 * F.col("atom")).alias("x"), "y", "z"))
    return graph.bond_graph(bonding.preserve_bond_graph(s, replace(moved, bonds=None))).select("a", "b")


# Traces and curves -------------------------------------------------------------------------


@query(P3 + """, g AS (SELECT p.residue, p.atom, r.chain, r.labelSeq FROM points p JOIN presidues r USING (residue) WHERE p.name = 'CA' AND r.polymer = 'protein'),
 n AS (SELECT *, CASE WHEN lag(labelSeq) OVER (PARTITION BY chain ORDER BY labelSeq) + 1 = labelSeq THEN 0 ELSE 1 END AS s, residue // 3 % 2 AS ss FROM g),
 r AS (SELECT *, sum(s) OVER (PARTITION BY chain ORDER BY labelSeq) AS run FROM n),
 t AS (SELECT residue, lag(ss) OVER w IS DISTINCT FROM ss AS first, lead(ss) OVER w IS DISTINCT FROM ss AS last FROM r WINDOW w AS (PARTITION BY chain, run ORDER BY labelSeq)),
 o AS (SELECT residue, max(x) FILTER (name = 'O') - max(x) FILTER (name = 'C') AS dx, max(y) FILTER (name = 'O') - max(y) FILTER (name = 'C') AS dy, max(z) FILTER (name = 'O') - max(z) FILTER (name = 'C') AS dz FROM points GROUP BY residue)
 SELECT residue, first, last, round(coalesce(dx / sqrt(dx * dx + dy * dy + dz * dz), 0), 4) AS dx, round(coalesce(dy / sqrt(dx * dx + dy * dy + dz * dz), 0), 4) AS dy, round(coalesce(dz / sqrt(dx * dx + dy * dy + dz * dz), 1), 4) AS dz FROM t LEFT JOIN o USING (residue)""")
def structure_trace(spark, d):
    s = points_structure(spark, d)
    s = replace(s, residues=s.residues.withColumn("ssCode", F.expr("CAST(CASE WHEN (residue div 3) % 2 = 1 THEN 1 ELSE 2 END AS INT)")))
    return rounded(sequence.structure_trace(s).select("residue", "first", "last", "dx", "dy", "dz"), "dx", "dy", "dz", digits=4)


def _spline(c: str, g: tuple, t: str) -> str:
    p0, p1, p2, p3 = (f"{c}{k}" for k in g)
    v0, v1 = f"(({p2} - {p0}) * 0.5)", f"(({p3} - {p1}) * 0.5)"
    return f"(2 * {p1} - 2 * {p2} + {v0} + {v1}) * {t} * {t} * {t} + (-3 * {p1} + 3 * {p2} - 2 * {v0} - {v1}) * {t} * {t} + {v0} * {t} + {p1}"


@query(duck("points") + ", g AS (SELECT atom // 5 AS segment, " + ", ".join(f"max({c}) FILTER (atom % 5 = {k}) AS {c}{k}" for c in "xyz" for k in range(5)) + " FROM points GROUP BY 1 HAVING count(*) = 5) "
       + "SELECT segment, CAST(j AS INT) AS j, " + ", ".join(f"round(CASE WHEN j / 4 < 0.5 THEN {_spline(c, (0, 1, 2, 3), '(j / 4 + 0.5)')} ELSE {_spline(c, (1, 2, 3, 4), '(j / 4 - 0.5)')} END, 4) AS {c}" for c in "xyz")
       + " FROM g, (SELECT unnest(range(5))::DOUBLE AS j) s")
def curve_points(spark, d):
    at = table(spark, d, "points")
    many = at.groupBy(F.expr("atom div 5").alias("segment")).agg(F.sort_array(F.collect_list(F.struct("atom", "x", "y", "z"))).alias("g")).filter("size(g) = 5")
    p = F.flatten(F.transform("g", lambda r: F.array(r["x"], r["y"], r["z"])))
    up = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    guides = many.select("segment", p.alias("p"), up.alias("d12"), up.alias("d23"), F.lit(False).alias("first"), F.lit(False).alias("last"))
    return rounded(curves.curve_segments(guides, 4).select("segment", "j", "x", "y", "z"), "x", "y", "z", digits=4)


def _angle(name: str, at: tuple, test: str) -> str:
    """SQL of the signed angle of four points given by prefixes."""
    d = lambda a, b, c: f"({at[b]}_{c} - {at[a]}_{c})"
    b1, b2, b3 = ({c: d(k, k + 1, c) for c in "xyz"} for k in range(3))
    cross = lambda u, v: {"x": f"({u['y']} * {v['z']} - {u['z']} * {v['y']})", "y": f"({u['z']} * {v['x']} - {u['x']} * {v['z']})", "z": f"({u['x']} * {v['y']} - {u['y']} * {v['x']})"}
    dot = lambda u, v: "(" + " + ".join(f"{u[c]} * {v[c]}" for c in "xyz") + ")"
    n1, n2 = cross(b1, b2), cross(b2, b3)
    m = cross(n1, b2)
    return f"round(CASE WHEN {test} THEN degrees(-atan2({dot(m, n2)} / sqrt({dot(b2, b2)}), {dot(n1, n2)})) END, 3) AS {name}"


def _near(a: str, b: str) -> str:
    return f"sqrt({' + '.join(f'({a}_{c} - {b}_{c}) * ({a}_{c} - {b}_{c})' for c in 'xyz')}) <= 2.5"


_SITES = ", ".join(f"max({c}) FILTER (name = '{n}') AS {n}_{c}" for n in ("N", "CA", "C") for c in "xyz")
_SHIFTED = ", ".join(f"lag({n}_{c}) OVER w AS p{n}_{c}, lead({n}_{c}) OVER w AS n{n}_{c}" for n in ("N", "CA", "C") for c in "xyz")
ORACLES["dihedrals"] = P3 + f""", s AS (SELECT residue, {_SITES} FROM points GROUP BY residue), b AS (SELECT r.residue, r.chain, r.labelSeq, s.* EXCLUDE (residue) FROM presidues r JOIN s USING (residue) WHERE polymer = 'protein'),
 l AS (SELECT *, {_SHIFTED} FROM b WINDOW w AS (PARTITION BY chain ORDER BY labelSeq, residue)),
 o AS (SELECT residue, {_angle('phi', ('pC', 'N', 'CA', 'C'), _near('pC', 'N'))}, {_angle('psi', ('N', 'CA', 'C', 'nN'), _near('C', 'nN'))}, {_angle('omega', ('pCA', 'pC', 'N', 'CA'), _near('pC', 'N'))} FROM l)
 SELECT residue, phi, psi, omega FROM presidues LEFT JOIN o USING (residue)"""
