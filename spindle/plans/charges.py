"""Queries of partial charges: molecules and residues made of orders, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gasteiger, graph, templates
from ..structure import Structure
from .queries import query, rounded
from .testtables import duck, orders_structure

# Molecules: an order's lines in a row, elements by part.
ELEMENT = "CASE CAST(id AS BIGINT) % 6 WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 6 END"


def molecules(spark, d) -> Structure:
    """Every order a molecule: a chain of its lines, with double bonds between some carbons."""
    s = orders_structure(spark, d)
    atoms = s.atoms.select("atom", "residue", F.lit("").alias("altloc"), F.expr(ELEMENT).alias("element"), F.col("id").cast("long").alias("part"))
    after = Window.partitionBy("residue").orderBy("atom")  # an order's lines
    next_ = F.when(F.lead("atom").over(after) == F.col("atom") + 1, F.lead("element").over(after))
    atoms = graph.stored(atoms.withColumn("next", next_))
    order = F.when((F.col("element") == 6) & (F.col("next") == 6) & (F.col("part") % 5 < 2), 2).otherwise(1)
    bonds = atoms.filter("next IS NOT NULL").select(F.col("atom").alias("bond"), F.col("atom").alias("a"), (F.col("atom") + 1).alias("b"), order.alias("order"), F.lit(1).alias("flags"), F.lit("explicit").alias("source"))
    return replace(s, atoms=atoms.drop("part", "next"), bonds=bonds, residues=s.residues.withColumn("polymer", F.lit("other")))


MOLECULES = f""", aa AS (SELECT atom, residue, {ELEMENT} AS z, CAST(id AS BIGINT) AS part FROM atoms),
 one AS (SELECT a.atom AS p, b.atom AS q, CASE WHEN a.z = 6 AND b.z = 6 AND a.part % 5 < 2 THEN 2 ELSE 1 END AS o FROM aa a JOIN aa b ON b.atom = a.atom + 1 AND b.residue = a.residue),
 b AS (SELECT p, q, o FROM one UNION ALL SELECT q, p, o FROM one),
 s AS (SELECT atom AS x, z, CAST(coalesce(sum(o), 0) AS INT) AS orders, count(o) AS degree FROM aa LEFT JOIN b ON p = atom GROUP BY atom, z),
 v AS (SELECT *, CASE z WHEN 6 THEN 4 WHEN 7 THEN 3 ELSE 2 END AS first, CASE z WHEN 6 THEN 4 WHEN 7 THEN 5 ELSE 6 END AS shell FROM s),
 t AS (SELECT *, first - orders AS h, degree + first - orders AS total FROM v),
 f AS (SELECT *, z <= 10 AND total <= 3 AND first - total + shell - first > 0 AS fits FROM t),
 e AS (SELECT b.p, b.q, CAST(b.o >= 2 AS INT) AS many, CAST(fq.fits AS INT) AS ok, fp.fits AND fp.total >= 2 AS centre FROM b JOIN f fp ON fp.x = b.p JOIN f fq ON fq.x = b.q),
 c AS (SELECT *, centre AND ((ok = 1 AND sum(many) OVER (PARTITION BY p) > many) OR (many = 1 AND sum(ok) OVER (PARTITION BY p) > ok)) AS via FROM e),
 conj AS (SELECT c.p AS x, bool_or(c.via OR r.via) AS conj FROM c JOIN c r ON r.p = c.q AND r.q = c.p GROUP BY c.p),
 o AS (SELECT f.*, coalesce(conj, false) AS conj, total + (shell - orders - h) // 2 AS orbitals FROM f LEFT JOIN conj USING (x)),
 m AS (SELECT x, z, h, CASE WHEN orbitals = 2 THEN 'sp' WHEN orbitals = 3 OR (orbitals = 4 AND total <= 3 AND conj) THEN 'sp2' ELSE 'sp3' END AS mode FROM o),
 k AS (SELECT x, h, a, b, c, a + b + c AS ion FROM m JOIN (VALUES {", ".join(f"({z}, '{mode}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for (z, mode), (a, b, c) in gasteiger.PARAMETERS.items())}) p(z, mode, a, b, c) USING (z, mode)),
 r AS (SELECT 0 AS turn, x, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS hq, a AS e FROM k
  UNION ALL
  SELECT turn, x, q, hq, a + q * (b + c * q) FROM (
   SELECT r.turn + 1 AS turn, r.x, k.a, k.b, k.c, r.q + 0.5 ** (r.turn + 1) * (coalesce(sum((n.e - r.e) / CASE WHEN n.e < r.e THEN kn.ion ELSE k.ion END), 0) + any_value(l.light)) AS q,
    any_value(r.hq - 0.5 ** (r.turn + 1) * l.light) AS hq
   FROM r JOIN k ON k.x = r.x LEFT JOIN b ON b.p = r.x LEFT JOIN r n ON n.x = b.q LEFT JOIN k kn ON kn.x = b.q,
   LATERAL (SELECT CASE WHEN k.h = 0 THEN 0 ELSE k.h * (7.17 + r.hq / k.h * (6.24 - 0.56 * r.hq / k.h) - r.e) / CASE WHEN 7.17 + r.hq / k.h * (6.24 - 0.56 * r.hq / k.h) < r.e THEN 20.02 ELSE k.ion END END AS light) l
   WHERE r.turn < 12 GROUP BY r.turn, r.x, r.q, r.e, k.a, k.b, k.c))
"""


@query(duck("atoms").replace("WITH ", "WITH RECURSIVE ", 1) + MOLECULES + "SELECT x AS atom, round(q + hq, 6) AS charge FROM r WHERE turn = 12")
def gasteiger_charges(spark, d):
    """Charges of the molecules that orders stand for."""
    out = gasteiger.gasteiger_charges(molecules(spark, d), spark.createDataFrame([], "atom long"))
    return rounded(out.charges, "charge", digits=6)


# Residues: an order's lines are atoms of a component by order, named by their number in it.
COMP = "CASE residue % 6 WHEN 0 THEN 'ALA' WHEN 1 THEN 'GLY' WHEN 2 THEN 'CYS' WHEN 3 THEN 'HOH' WHEN 4 THEN 'NA' ELSE 'XYZ' END"
NAME = (
    "CASE WHEN residue % 6 = 4 THEN 'NA' WHEN residue % 6 = 3 THEN CASE atom % 100 WHEN 1 THEN 'O' WHEN 2 THEN 'H1' ELSE 'X' END "
    "ELSE CASE atom % 100 WHEN 1 THEN 'CA' WHEN 2 THEN 'SG' WHEN 3 THEN 'N' WHEN 4 THEN 'C' WHEN 5 THEN 'O' WHEN 6 THEN 'HA' ELSE 'CB' END END"
)
ALT = "CASE altloc WHEN 'N' THEN '' ELSE altloc END"
POLYMER = "CASE WHEN polymer = 'protein' AND residue % 6 IN (0, 1, 2, 5) THEN 'protein' ELSE 'other' END"


def residues(spark, d) -> Structure:
    """Orders as residues of proteins, waters, ions and unknown components, with conformers."""
    s = orders_structure(spark, d)
    atoms = s.atoms.withColumns({"name": F.expr(NAME), "altloc": F.expr(ALT), "element": F.lit(6)})
    return replace(s, atoms=atoms, residues=s.residues.withColumns({"comp": F.expr(COMP), "polymer": F.expr(POLYMER)}))


RESIDUES = f""", aa AS (SELECT atom, residue, {NAME} AS name, {ALT} AS alt, occupancy, x, y, z FROM atoms),
 re AS (SELECT residue, chain, model, {COMP} AS comp, {POLYMER} AS polymer FROM residues JOIN chains USING (chain)),
 ends AS (SELECT chain, min(residue) AS first, max(residue) AS last FROM re WHERE polymer <> 'other' GROUP BY chain),
 sg AS (SELECT atom, residue, alt, model, x, y, z FROM aa JOIN re USING (residue) WHERE name = 'SG' AND comp = 'CYS'),
 ss AS (SELECT DISTINCT unnest([p.residue, q.residue]) AS residue FROM sg p JOIN sg q ON q.model = p.model AND p.atom < q.atom AND p.residue <> q.residue
  AND (p.alt = '' OR q.alt = '' OR p.alt = q.alt) AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 < 6.25),
 ions AS (SELECT residue FROM aa JOIN re USING (residue) WHERE comp = 'NA' GROUP BY residue HAVING count(DISTINCT alt) = count(*)),
 named AS (SELECT re.residue, re.comp, CASE WHEN comp = 'HOH' THEN 'WAT' WHEN comp = 'ALA' AND polymer = 'protein' AND first = re.residue THEN 'NALA'
   WHEN comp = 'ALA' AND polymer = 'protein' AND last = re.residue THEN 'CALA' WHEN comp = 'CYS' AND ss.residue IS NOT NULL THEN 'CYX' ELSE comp END AS template
  FROM re LEFT JOIN ends USING (chain) LEFT JOIN ss ON ss.residue = re.residue WHERE comp IN ('ALA', 'GLY', 'CYS', 'HOH')),
 tpl AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{n}', CAST({c} AS DOUBLE), {f"'{p}'" if p else 'NULL'})" for t, rows in templates.BUILT_IN.items() for n, c, p in rows)}) v(template, name, charge, parent)),
 own AS (SELECT atom, aa.residue, aa.alt, tpl.name, charge FROM aa JOIN named USING (residue) JOIN tpl ON tpl.template = named.template AND tpl.name = aa.name),
 held AS (SELECT aa.*, named.template FROM aa JOIN named USING (residue)),
 labels AS (SELECT residue, template, alt, min(atom) AS aa FROM held WHERE alt <> '' GROUP BY residue, template, alt),
 conf AS (SELECT residue, template, alt, alt = max_by(alt, aa) OVER (PARTITION BY residue) AS last FROM labels
  UNION ALL SELECT DISTINCT residue, template, '', true FROM held WHERE residue NOT IN (SELECT residue FROM labels)),
 here AS (SELECT c.residue, c.alt, c.last, h.name, min(h.atom) AS atom FROM conf c JOIN held h ON h.residue = c.residue AND h.alt IN ('', c.alt) GROUP BY ALL),
 folded AS (SELECT p.atom, t.charge FROM conf c JOIN tpl t ON t.template = c.template AND t.parent IS NOT NULL
  JOIN here p ON p.residue = c.residue AND p.alt = c.alt AND p.name = t.parent JOIN aa a ON a.atom = p.atom
  WHERE (a.alt <> '' OR c.last) AND NOT EXISTS (SELECT 1 FROM here x WHERE x.residue = c.residue AND x.alt = c.alt AND x.name = t.name)),
 charges AS (SELECT atom, sum(charge) AS charge FROM (SELECT atom, charge FROM own UNION ALL SELECT atom, charge FROM folded UNION ALL SELECT atom, 1.0 FROM aa JOIN ions USING (residue)) GROUP BY atom)
"""
S3 = duck("chains", "residues", "atoms")


@query(S3 + RESIDUES + "SELECT atom, round(charge, 6) AS charge FROM charges")
def template_charges(spark, d):
    """Template charges by chain end, disulfide and conformer, missing hydrogens folded."""
    return rounded(templates.template_charges(residues(spark, d)).charges, "charge", digits=6)


ACTIVE = """, best AS (SELECT residue, arg_min(alt, (-occ, alt)) AS alt FROM (SELECT residue, alt, sum(CAST(occupancy AS DECIMAL(38, 9))) AS occ FROM aa WHERE alt <> '' GROUP BY residue, alt) GROUP BY residue),
 act AS (SELECT aa.* FROM aa JOIN re USING (residue) LEFT JOIN best USING (residue) WHERE (aa.alt = '' OR aa.alt = best.alt) AND re.model = (SELECT arg_min(model, chain) FROM chains)),
 miss AS (SELECT comp, name, act.residue, count(*) AS k, min(atom) AS first FROM act JOIN re USING (residue) WHERE atom NOT IN (SELECT atom FROM charges) GROUP BY comp, name, act.residue)
"""


@query(S3 + RESIDUES + ACTIVE + """SELECT comp, name, CAST(sum(k) AS BIGINT) AS "count", array_to_string(list(residue ORDER BY first)[:3], ',') AS residues FROM miss GROUP BY comp, name""")
def template_unmatched(spark, d):
    """Atoms that no template charges, by component and name, with their first three residues."""
    found = templates.template_charges(residues(spark, d)).unmatched
    return found.withColumn("residues", F.array_join("residues", ","))


@query(S3 + RESIDUES + """SELECT n.residue, n.template, array_to_string(list(t.name ORDER BY t.name), ',') AS missing
 FROM named n JOIN tpl t ON t.template = n.template AND t.parent IS NULL WHERE n.residue IN (SELECT residue FROM held) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.residue = n.residue AND h.name = t.name) GROUP BY n.residue, n.template""")
def template_incomplete(spark, d):
    """Template atoms, hydrogens aside, that a residue lacks."""
    found = templates.template_charges(residues(spark, d)).incomplete
    return found.withColumn("missing", F.array_join("missing", ","))
