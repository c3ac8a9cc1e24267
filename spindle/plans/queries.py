"""Registered queries over the driver's tables and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import views
from ..functions import expr, timeline
from ..operators import dynamics, fields, graph, selection, sequence, spatial, vectors, volume
from .testtables import duck, orders_structure, points_structure, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
Q = selection
GEN, MOD, FIL, COM, AP = (f"structure-query.{x}." for x in ("generator", "modifier", "filter", "combinator", "atom-property"))
MAC, CORE = AP + "macromolecular.", AP + "core."


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounding(value: Column, digits: int) -> Column:
    """A double rounded as the SQL side does it: scaled, rounded half away from zero, scaled back; no negative zeros.

    Spark's own ``round`` goes by the decimal digits, so 0.0640625 (41 / 640) would end one unit higher.
    """
    v, scale = value.cast("double"), F.lit(10.0**digits)
    whole = F.round(v * scale) / scale
    return F.when(F.abs(v * scale) < float("inf"), whole).otherwise(v) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 3) -> DataFrame:
    """Rounded doubles without negative zeros, comparable across engines."""
    return df.withColumns({c: rounding(F.col(c), digits) for c in cols})


S3 = duck("chains", "residues", "atoms")
P3 = duck("points", "presidues", "pchains", "pbonds")
WIDE = "(SELECT a.*, r.chain, r.labelSeq, r.authSeq, r.comp, r.polymer, r.het, r.ssCode, c.model, c.labelId, c.authId, c.entityId, c.entityType FROM atoms a JOIN residues r USING (residue) JOIN chains c USING (chain))"
PWIDE = "(SELECT a.*, r.chain, r.labelSeq, r.comp, r.polymer, c.model FROM points a JOIN presidues r USING (residue) JOIN pchains c USING (chain))"
PD2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"


# Views -----------------------------------------------------------------------------------


@query(S3 + """, s AS (SELECT residue, altloc, sum(CAST(occupancy AS DECIMAL(38,9))) AS occ FROM atoms GROUP BY residue, altloc),
 b AS (SELECT residue, altloc FROM (SELECT *, row_number() OVER (PARTITION BY residue ORDER BY occ DESC, altloc) AS r FROM s) WHERE r = 1)
 SELECT atom, residue, altloc FROM atoms JOIN b USING (residue, altloc)""")
def active_primary_altloc(spark, d):
    return views.active_atoms(orders_structure(spark, d), "all", "primary").select("atom", "residue", "altloc")


@query(S3 + f" SELECT atom FROM {WIDE} WHERE model = (SELECT model FROM chains ORDER BY chain LIMIT 1) AND altloc IN ('', 'A')")
def scope_model(spark, d):
    return views.active_atoms(orders_structure(spark, d), "first", "A").select("atom")


@query(P3 + " SELECT " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, (min({c}) + max({c})) / 2 AS mid_{c}" for c in "xyz") + " FROM points")
def bounds(spark, d):
    return views.coordinate_bounds(points_structure(spark, d).atoms)


@query(S3 + " SELECT min(bfactor) AS lo, max(bfactor) AS hi FROM atoms")
def column_range(spark, d):
    return views.column_range(orders_structure(spark, d).atoms, "bfactor")


@query(S3 + " SELECT atom, CAST(CASE element WHEN 1 THEN 1.1 WHEN 6 THEN 1.7 WHEN 7 THEN 1.55 WHEN 8 THEN 1.52 ELSE 1.7 END AS DOUBLE) AS radius FROM atoms")
def radii(spark, d):
    return views.atom_radii(orders_structure(spark, d))


@query(P3 + " SELECT round(avg(x), 3) AS x, round(avg(y), 3) AS y, round(avg(z), 3) AS z FROM points WHERE element = 6")
def centroid(spark, d):
    return rounded(views.centroid(points_structure(spark, d).atoms.filter("element = 6")), "x", "y", "z")


@query(S3 + " SELECT CAST(count(*) AS BIGINT) AS n, 'atoms.(residue,name,altloc)' AS path FROM (SELECT 1 FROM atoms GROUP BY residue, name, altloc HAVING count(*) > 1)")
def violations_by_path(spark, d):
    from ..structure import violations

    return violations(orders_structure(spark, d)).groupBy("path").agg(F.count("*").alias("n")).select("n", "path")


@query("SELECT user_id, event_type, CASE WHEN n = 0 THEN event_type ELSE concat(event_type, '_', CAST(n AS STRING)) END AS \"unique\", event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS n FROM events)")
def dedup_suffix(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return views.suffixed_labels(ev, "event_type", ["user_id"], "event_id").select("user_id", "event_type", "unique", "event_id")


@query("SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS n FROM events)")
def segment_ids(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return views.run_ids(ev, "event_type", "event_id", ["user_id"]).select("event_id", F.col("run").cast("long").alias("run"))


# Selections ------------------------------------------------------------------------------


@query(S3 + " SELECT residue FROM residues WHERE comp IN ('1-URGENT', '5-LOW')")
def comp_filter(spark, d):
    return Q.resolve(Q.comp(["1-URGENT", "5-LOW"]), orders_structure(spark, d)).ids


@query(S3 + f" SELECT atom FROM {WIDE} WHERE (element = 3 OR polymer = 'protein') AND NOT (bfactor > 25)")
def and_or_not(spark, d):
    q = (Q.element(3) | Q.protein()) & ~Q.attribute("bfactor", lambda c: c > 25)
    return Q.resolve(q, orders_structure(spark, d)).ids


@query(P3 + f" SELECT DISTINCT p.atom FROM points p JOIN points q ON q.bfactor = 0 AND {PD2} <= 4")
def within_radius(spark, d):
    s = points_structure(spark, d)
    return Q.resolve(Q.within(2.0, Q.attribute("bfactor", lambda c: c == 0)), s).ids


@query(P3 + f" SELECT atom FROM points WHERE element = 7 AND atom NOT IN (SELECT p.atom FROM points p JOIN points q ON q.element = 16 AND {PD2} <= 6.25)")
def beyond_and_element(spark, d):
    return Q.resolve(Q.element(7) & ~Q.within(2.5, Q.element(16)), points_structure(spark, d)).ids


@query(S3 + f" SELECT atom FROM {WIDE} WHERE model = 2 AND authId LIKE 'Customer#%' AND CAST(regexp_extract(authSeq, '^[+-]?[0-9]+') AS INT) BETWEEN 100 AND 200")
def residue_range_in_model(spark, d):
    q = Q.model(2) & Q.where("atom", "named", F.col("authId").startswith("Customer#")) & Q.residues(100, 200)
    return Q.resolve(q, orders_structure(spark, d)).ids


@query(S3 + f" SELECT atom FROM {WIDE} WHERE entityType = 'water' OR (entityType = '' AND comp IN ('HOH', 'WAT', 'H2O', 'DOD'))")
def water(spark, d):
    return Q.resolve(Q.water(), orders_structure(spark, d)).ids


@query(S3 + f" SELECT atom FROM {WIDE} WHERE ssCode IN (1, 4, 5)")
def helix(spark, d):
    return Q.resolve(Q.secondary_structure("helix"), orders_structure(spark, d)).ids


def _two(spark, d):
    s = points_structure(spark, d)
    return Q.resolve(Q.element(6), s), Q.resolve(Q.attribute("bfactor", lambda c: c >= 4), s)


@query(P3 + " SELECT atom FROM points WHERE element = 6 UNION SELECT atom FROM points WHERE bfactor >= 4")
def set_union(spark, d):
    return Q.union(*_two(spark, d)).ids


@query(P3 + " SELECT atom FROM points WHERE element = 6 INTERSECT SELECT atom FROM points WHERE bfactor >= 4")
def set_intersect(spark, d):
    return Q.intersect(*_two(spark, d)).ids


@query(P3 + " SELECT atom FROM points WHERE element = 6 EXCEPT SELECT atom FROM points WHERE bfactor >= 4")
def set_difference(spark, d):
    return Q.difference(*_two(spark, d)).ids


@query(P3 + " SELECT atom FROM points JOIN presidues USING (residue) WHERE comp = 'HOH'")
def to_atoms(spark, d):
    return Q.to_atoms(Q.resolve(Q.comp(["HOH"]), points_structure(spark, d))).ids


@query(P3 + " SELECT DISTINCT residue FROM points WHERE element = 16")
def to_residues(spark, d):
    return Q.to_residues(Q.resolve(Q.element(16), points_structure(spark, d))).ids


@query(P3 + " SELECT bond FROM pbonds WHERE a IN (SELECT atom FROM points WHERE bfactor < 7) AND b IN (SELECT atom FROM points WHERE bfactor < 7)")
def to_bonds_both(spark, d):
    return Q.to_bonds(Q.resolve(Q.attribute("bfactor", lambda c: c < 7), points_structure(spark, d))).ids


@query(P3 + " SELECT bond FROM pbonds WHERE a IN (SELECT atom FROM points WHERE bfactor < 2) OR b IN (SELECT atom FROM points WHERE bfactor < 2)")
def to_bonds_either(spark, d):
    return Q.to_bonds(Q.resolve(Q.attribute("bfactor", lambda c: c < 2), points_structure(spark, d)), "either").ids


# Expressions -----------------------------------------------------------------------------


def _evaluated(spark, sf_dir, rounds="", instead=None, /, **trees) -> DataFrame:
    """A column for each tree; ``rounds``: those that the SQL rounds.

    ``instead``: {name: (condition, value)} where the SQL fixes another value than the language's arithmetic.
    """
    s = orders_structure(spark, sf_dir)
    cols = []
    for name, tree in trees.items():
        value = expr.scalar(tree).col
        value = rounding(value, 6) if name in rounds else value
        if instead and name in instead:
            when, other = instead[name]
            value = F.when(when, other).otherwise(value)
        cols.append(value.alias(name))
    return s.wide().select("atom", *cols)


BF, SEQ = [MAC + "B_iso_or_equiv"], [MAC + "label_seq_id"]


@query(S3 + f""" SELECT atom, round(bfactor * 2 - labelSeq + 1, 6) AS a, round(floor(bfactor / 4 + 0.5), 6) AS b, CAST(bfactor % 7 AS DOUBLE) AS c,
 round(CASE WHEN labelSeq = 1 THEN CAST('Infinity' AS DOUBLE) ELSE bfactor / (labelSeq - 1) END, 6) AS d, round(sqrt(bfactor) + ln(bfactor), 6) AS e, least(bfactor, labelSeq, 5.0) AS f, CAST(greatest(bfactor, 9.0) AS DOUBLE) AS g FROM {WIDE}""")
def expr_math(spark, d):
    m = lambda op, *xs: [f"core.math.{op}", *xs]
    # The SQL: whatever is divided at the first residue, and least() of a NaN and numbers.
    instead = {"d": (F.col("labelSeq") == 1, F.lit(float("inf"))), "f": (F.isnan("bfactor"), F.least(F.col("labelSeq").cast("double"), F.lit(5.0)))}
    return _evaluated(
        spark, d, "abde", instead, a=m("add", m("sub", m("mult", BF, 2), SEQ), 1), b=m("round-int", m("div", BF, 4)), c=m("mod", BF, 7),
        d=m("div", BF, m("sub", SEQ, 1)), e=m("add", m("sqrt", BF), m("log", BF)), f=m("min", BF, SEQ, 5), g=m("max", BF, 9),
    )


@query(S3 + f" SELECT atom, regexp_matches(comp, '^[1-3]-') AS a, regexp_matches(lower(comp), 'low$') AS b, concat(altloc, '-', CAST(labelSeq AS STRING)) AS c FROM {WIDE}")
def expr_regex(spark, d):
    comp = [MAC + "label_comp_id"]
    return _evaluated(
        spark, d, a=["core.str.match", ["core.type.regex", "^[1-3]-"], comp], b=["core.str.match", ["core.type.regex", "low$", "i"], comp],
        c=["core.type.composite-key", [MAC + "label_alt_id"], SEQ],
    )


@query(S3 + f" SELECT atom, ssCode IN (1, 4, 5) AS a, ssCode IN (2, 3) AS b, ssCode = 6 AS c FROM {WIDE}")
def expr_flags(spark, d):
    ss = lambda *n: ["structure-query.type.secondary-structure-flags", *n]
    flags = [MAC + "secondary-structure-flags"]
    return _evaluated(spark, d, a=["core.flags.has-any", flags, ss("helix")], b=["core.flags.has-all", flags, ss("beta")], c=["core.flags.has-any", flags, ss("turn")])


@query(S3 + f" SELECT atom, altloc IN ('A', 'N') AS a, comp IN ('1-URGENT') AND NOT het AS b, labelSeq BETWEEN 2 AND 4 AS c, altloc <> 'R' AS d FROM {WIDE}")
def expr_sets(spark, d):
    return _evaluated(
        spark, d, a=["core.set.has", ["core.type.set", "A", "N"], [MAC + "label_alt_id"]],
        b=["core.logic.and", ["core.set.has", ["core.type.set", "1-URGENT"], [MAC + "label_comp_id"]], ["core.logic.not", [MAC + "is-het"]]],
        c=["core.rel.in-range", SEQ, 2, 4], d=["core.rel.neq", [MAC + "label_alt_id"], "R"],
    )


@query(S3 + f" SELECT atom, round(x + y * 2 - z, 6) AS a, CAST(element AS DOUBLE) AS b, CASE element WHEN 1 THEN 'H' WHEN 2 THEN 'HE' WHEN 3 THEN 'LI' WHEN 4 THEN 'BE' WHEN 5 THEN 'B' WHEN 6 THEN 'C' ELSE 'N' END AS c, CAST(CASE element WHEN 1 THEN 1.1 WHEN 2 THEN 1.4 WHEN 3 THEN 1.81 WHEN 4 THEN 1.53 WHEN 5 THEN 1.92 WHEN 6 THEN 1.7 ELSE 1.55 END AS DOUBLE) AS e, CAST(coalesce(CAST(regexp_extract(authSeq, '^[0-9]+') AS INT), 0) AS DOUBLE) AS f FROM {WIDE}")
def expr_properties(spark, d):
    return _evaluated(
        spark, d, "a", a=["core.math.sub", ["core.math.add", [CORE + "x"], ["core.math.mult", [CORE + "y"], 2]], [CORE + "z"]], b=[CORE + "atomic-number"],
        c=[CORE + "element-symbol"], e=[CORE + "vdw"], f=[MAC + "auth_seq_id"],
    )


def _sets(spark, d, tree, which=points_structure) -> DataFrame:
    return expr.evaluate(which(spark, d), tree).flat()


def group(**tests) -> list:
    return [GEN + "atom-groups", {k.replace("_", "-"): v for k, v in tests.items()}]


def el(z: int) -> list:
    return group(atom_test=["core.rel.eq", [CORE + "atomic-number"], z])


@query(S3 + f""", w AS (SELECT *, CASE WHEN lag(residue) OVER (PARTITION BY chain ORDER BY atom) IS NOT DISTINCT FROM residue THEN 0 ELSE 1 END AS n FROM {WIDE}),
 r AS (SELECT *, sum(n) OVER (PARTITION BY chain ORDER BY atom) AS run FROM w),
 f AS (SELECT *, first_value(bfactor) OVER (PARTITION BY chain, run ORDER BY atom) AS fb FROM r)
 SELECT atom FROM f WHERE bfactor > 10 AND fb < 30""")
def atom_groups_first_of_segment(spark, d):
    return _sets(spark, d, group(residue_test=["core.rel.lt", BF, 30], atom_test=["core.rel.gr", BF, 10]), orders_structure)


@query(P3 + " SELECT min(atom) OVER (PARTITION BY residue) AS set_id, atom FROM points WHERE element IN (6, 7)")
def atom_groups_by_residue(spark, d):
    test = ["core.set.has", ["core.type.set", 6, 7], [CORE + "atomic-number"]]
    return expr.evaluate(points_structure(spark, d), group(atom_test=test, group_by=[MAC + "residue-key"])).rows.select("set_id", "atom")


@query(P3 + " SELECT atom FROM points WHERE bfactor <> 3 AND element = 16")
def query_in_complement(spark, d):
    inner = group(atom_test=["core.rel.eq", BF, 3])
    return _sets(spark, d, [GEN + "query-in-selection", inner, el(16), {"in-complement": True}])


@query(P3 + " SELECT atom FROM points WHERE element IN (7, 16)")
def merge(spark, d):
    return _sets(spark, d, [COM + "merge", el(7), el(16)])


@query(P3 + " SELECT atom FROM points WHERE residue IN (SELECT residue FROM points WHERE element = 16)")
def whole_residues(spark, d):
    return _sets(spark, d, [MOD + "whole-residues", el(16)])


@query(P3 + " SELECT atom FROM points WHERE bfactor IN (SELECT bfactor FROM points WHERE atom < 3)")
def expand_property(spark, d):
    few = group(atom_test=["core.rel.lt", [CORE + "atom-key"], 3])
    return _sets(spark, d, [MOD + "expand-property", few, {"property": BF}])


@query(P3 + f" SELECT DISTINCT p.atom FROM points p JOIN points q ON q.bfactor = 1 AND {PD2} <= 2.25")
def surroundings(spark, d):
    return _sets(spark, d, [MOD + "include-surroundings", group(atom_test=["core.rel.eq", BF, 1]), {"radius": 1.5}])


@query(P3 + f", n AS (SELECT DISTINCT p.residue FROM points p JOIN points q ON q.bfactor = 1 AND {PD2} <= 1) SELECT atom FROM points JOIN n USING (residue)")
def surroundings_whole(spark, d):
    return _sets(spark, d, [MOD + "include-surroundings", group(atom_test=["core.rel.eq", BF, 1]), {"radius": 1, "as-whole-residues": True}])


@query(P3 + """, e AS (SELECT a, b FROM pbonds WHERE flags % 2 = 1 UNION SELECT b, a FROM pbonds WHERE flags % 2 = 1), s AS (SELECT atom FROM points WHERE element = 16),
 k AS (SELECT atom FROM s UNION SELECT b FROM e JOIN s ON a = atom) SELECT atom FROM k UNION SELECT b FROM e JOIN k ON a = atom""")
def connected_k2(spark, d):
    return _sets(spark, d, [MOD + "include-connected", el(16), {"layer-count": 2}])


@query(P3 + """, e AS (SELECT a, b FROM pbonds WHERE "order" >= 2 UNION SELECT b, a FROM pbonds WHERE "order" >= 2)
 SELECT atom FROM points WHERE element = 6 AND EXISTS (SELECT 1 FROM e JOIN points t ON e.b = t.atom WHERE e.a = points.atom AND t.element = 7)""")
def connected_to(spark, d):
    test = ["core.rel.gre", ["structure-query.bond-property.order"], 2]
    return _sets(spark, d, [FIL + "is-connected-to", el(6), {"target": el(7), "bond-test": test}])


@query(P3 + " SELECT atom FROM points WHERE element = 6 AND residue IN (SELECT residue FROM points WHERE element = 6 GROUP BY residue HAVING count(*) >= 2)")
def pick_count(spark, d):
    sets = group(atom_test=["core.rel.eq", [CORE + "atomic-number"], 6], group_by=[MAC + "residue-key"])
    return _sets(spark, d, [FIL + "pick", sets, {"test": ["core.rel.gre", ["structure-query.atom-set.atom-count"], 2]}])


@query(P3 + f""", v AS (SELECT *, CASE element WHEN 6 THEN 1.7 WHEN 7 THEN 1.55 WHEN 8 THEN 1.52 ELSE 1.8 END AS r FROM points)
 SELECT DISTINCT p.atom FROM v p JOIN v q ON q.element = 16 AND p.element = 8 AND sqrt({PD2}) <= 0.5 + p.r""")
def within_vdw(spark, d):
    return _sets(spark, d, [FIL + "within", el(8), {"target": el(16), "max-radius": 0.5}])


@query(P3 + f""", t AS (SELECT p.atom, max(CASE WHEN sqrt({PD2}) < 1 THEN 1 ELSE 0 END) AS close, max(CASE WHEN sqrt({PD2}) < 3 THEN 1 ELSE 0 END) AS near
 FROM points p JOIN points q ON p.element = 8 AND q.element = 16 GROUP BY p.atom) SELECT atom FROM t WHERE close = 0 AND near = 1""")
def within_min_max(spark, d):
    return _sets(spark, d, [FIL + "within", el(8), {"target": el(16), "min-radius": 1, "max-radius": 3}])


@query(P3 + " SELECT atom FROM points WHERE bfactor IN (SELECT bfactor FROM points WHERE element = 16)")
def same_properties(spark, d):
    return _sets(spark, d, [FIL + "with-same-atom-properties", [GEN + "all"], {"source": el(16), "property": BF}])


@query(P3 + " SELECT atom FROM points WHERE residue IN (SELECT residue FROM points WHERE element = 16) AND element <> 8")
def except_by(spark, d):
    return _sets(spark, d, [MOD + "except-by", [MOD + "whole-residues", el(16)], {"by": el(8)}])


@query(P3 + " SELECT atom FROM points WHERE residue IN (SELECT residue FROM points WHERE element = 16)")
def intersected_by(spark, d):
    return _sets(spark, d, [FIL + "intersected-by", group(group_by=[MAC + "residue-key"]), {"by": el(16)}])


# Fields ----------------------------------------------------------------------------------


@query(P3 + " SELECT atom, CAST(CASE WHEN abs(element - 6) < 0.5 THEN 1 WHEN abs(element - 7) < 0.5 THEN 2 ELSE -1 END AS FLOAT) AS c, "
       "CAST(10 * greatest(0, least(1, (bfactor - 2) / 5)) AS FLOAT) AS l, CAST(CASE WHEN (bfactor - 2) / 5 < 0 OR (bfactor - 2) / 5 > 1 THEN (bfactor - 2) / 5 - floor((bfactor - 2) / 5) ELSE (bfactor - 2) / 5 END AS FLOAT) AS w FROM points")
def field_scalars(spark, d):
    b = fields.attribute("bfactor")
    return fields.evaluate(
        points_structure(spark, d).atoms, "atom", c=fields.categorical(fields.attribute("element"), {6: 1, 7: 2}, -1),
        l=fields.linear(b, (2, 7), (0, 10)), w=fields.linear(b, (2, 7), (0, 1), "wrap"),
    )


@query(P3 + " SELECT atom, CAST(round(CASE WHEN bfactor <= 1 THEN 0 WHEN bfactor < 5 THEN (bfactor - 1) / 4 ELSE 1 END, 5) AS DOUBLE) AS v_r, "
       "CAST(round(CASE WHEN bfactor <= 1 THEN 1 WHEN bfactor < 5 THEN 1 - (bfactor - 1) / 4 ELSE 0 END, 5) AS DOUBLE) AS v_g FROM points")
def colormap(spark, d):
    f = fields.colormap(fields.attribute("bfactor"), [(1, (0, 1, 0, 1)), (5, (1, 0, 0, 1))])
    return rounded(fields.evaluate(points_structure(spark, d).atoms, "atom", v=f).select("atom", "v_r", "v_g"), "v_r", "v_g", digits=5)


@query("SELECT doc_id, CAST(coalesce(quality, -1) AS DOUBLE) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def annotation_left(spark, d):
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = fields.join_annotation(docs.select("doc_id"), labels.select("doc_id", "quality"), ["doc_id"], "quality")
    return out.select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(-1.0)).alias("quality"))


@query("SELECT user_id, min_by(value, event_id) AS value FROM events GROUP BY user_id")
def annotation_first(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return fields.join_annotation(ev.select("user_id").distinct(), ev.select("user_id", "value", "event_id"), ["user_id"], "value", "first", "event_id")


@query("SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def annotation_last(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return fields.join_annotation(ev.select("user_id").distinct(), ev.select("user_id", "value", "event_id"), ["user_id"], "value", "last", "event_id")


# Joins, graphs, kernels ------------------------------------------------------------------


@query(P3 + f" SELECT p.atom AS a, q.atom AS b, round({PD2}, 4) AS d2 FROM points p JOIN points q ON p.atom < q.atom AND {PD2} <= 2.25")
def pairs_within(spark, d):
    return rounded(spatial.pairs_within(points_structure(spark, d).atoms, 1.5), "d2", digits=4)


@query(P3 + f", n AS (SELECT p.atom AS point, q.atom, {PD2} AS d2 FROM points p JOIN points q ON p.element = 16 AND q.element = 7), r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d2, atom) AS k FROM n) SELECT point, atom, round(d2, 4) AS d2 FROM r WHERE k = 1")
def nearest(spark, d):
    at = points_structure(spark, d).atoms
    points = at.filter("element = 16").withColumnRenamed("atom", "point")
    return rounded(spatial.nearest(points, at.filter("element = 7"), 4.0), "d2", digits=4).select("point", "atom", "d2")


@query(P3 + f" SELECT p.atom AS point, round(sum(q.bfactor * 332.0636 / sqrt(greatest({PD2}, 1))), 2) AS phi FROM points p JOIN points q ON p.element = 16 AND q.bfactor <> 0 GROUP BY p.atom")
def coulomb_sum(spark, d):
    at = points_structure(spark, d).atoms
    points = at.filter("element = 16").withColumnRenamed("atom", "point")
    return rounded(dynamics.coulomb_potential(points, at.withColumn("q", F.col("bfactor").cast("double"))), "phi", digits=2)


@query(P3 + f", s AS (SELECT p.atom AS point, sum(q.bfactor * 332.0636 / greatest({PD2}, 1)) AS phi FROM points p JOIN points q ON p.element = 16 AND q.bfactor <> 0 AND {PD2} <= 9 GROUP BY p.atom) SELECT atom AS point, round(coalesce(phi, 0), 2) AS phi FROM points LEFT JOIN s ON point = atom WHERE element = 16")
def coulomb_cutoff(spark, d):
    at = points_structure(spark, d).atoms
    points = at.filter("element = 16").withColumnRenamed("atom", "point")
    return rounded(dynamics.coulomb_potential(points, at.withColumn("q", F.col("bfactor").cast("double")), 3.0, model="distance"), "phi", digits=2)


@query(P3 + " SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(bit_or(flags) AS INT) AS flags, CAST(max(\"order\") AS INT) AS \"order\" FROM pbonds GROUP BY 1, 2")
def edge_merge(spark, d):
    return graph.merged_edges(points_structure(spark, d).bonds)


@query(P3 + " SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT a AS node FROM pbonds UNION ALL SELECT b FROM pbonds) GROUP BY node")
def degree(spark, d):
    return graph.degree(points_structure(spark, d).bonds)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 10000000 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION
  SELECT own.node, min(near.root) FROM recurring.r own JOIN u ON u.a = own.node JOIN r near ON near.node = u.b WHERE near.root < own.root GROUP BY own.node)
 SELECT node, root AS component FROM r""")
def components_all(spark, d):
    """Components of parts and suppliers over all of lineitem."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return graph.components(li.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 10000000).alias("b")))


@query(P3 + f", c AS (SELECT w.*, CASE element WHEN 6 THEN 0.76 WHEN 7 THEN 0.71 WHEN 8 THEN 0.66 ELSE 1.05 END AS cov FROM {PWIDE} w) SELECT p.atom AS a, q.atom AS b FROM c p JOIN c q ON p.atom < q.atom AND p.model = q.model AND sqrt({PD2}) <= p.cov + q.cov + 0.45")
def distance_bonds(spark, d):
    return graph.distance_bonds(points_structure(spark, d)).select("a", "b")


@query(P3 + " SELECT CAST(floor(x / 4) AS BIGINT) AS cx, CAST(floor(y / 4) AS BIGINT) AS cy, CAST(floor(z / 4) AS BIGINT) AS cz, count(*) AS n FROM points GROUP BY 1, 2, 3")
def cell_histogram(spark, d):
    return spatial.cell_histogram(points_structure(spark, d).atoms, 4.0)


@query("SELECT c_custkey, CAST(" + " + ".join(f"(((c_custkey >> {b}) & 1) << {2 * b}) + (((c_nationkey >> {b}) & 1) << {2 * b + 1})" for b in range(6)) + " AS BIGINT) AS m FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer)")
def morton_order(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", spatial.morton([F.col("c_custkey"), F.col("c_nationkey")], 6).alias("m"))


@query(S3 + " SELECT residue, round(CAST(coalesce(sum(bfactor), 0) AS DOUBLE), 3) AS charge FROM residues LEFT JOIN atoms USING (residue) GROUP BY residue")
def residue_charge(spark, d):
    s = orders_structure(spark, d)
    return rounded(dynamics.residue_net_charge(s.residues, s.atoms, "bfactor"), "charge")


@query(duck("frames") + ", r AS (SELECT atom, x, y, z FROM frames WHERE frame = 0) SELECT f.frame, count(*) AS n, round(sqrt(avg((f.x - r.x) * (f.x - r.x) + (f.y - r.y) * (f.y - r.y) + (f.z - r.z) * (f.z - r.z))), 3) AS rmsd FROM frames f JOIN r USING (atom) GROUP BY f.frame")
def rmsd_by_frame(spark, d):
    f = table(spark, d, "frames")
    return rounded(dynamics.rmsd_by_frame(f, f.filter("frame = 0")), "rmsd")


_H = [[f"{a}r{b}" for b in "xyz"] for a in "xyz"]
_SQUARES = " + ".join(f"{v} * {v}" for row in _H for v in row)
_MINORS = " + ".join(f"({_H[i][k]} * {_H[j][m]} - {_H[i][m]} * {_H[j][k]}) ** 2" for i, j in ((0, 1), (0, 2), (1, 2)) for k, m in ((0, 1), (0, 2), (1, 2)))


# Events lie in a plane (y = x / 2), so the covariance has two singular values; their sum follows from its squares and minors.
@query(duck("frames") + f""", j AS (SELECT f.frame, {", ".join(f"f.{c} - avg(f.{c}) OVER w AS {c}, r.{c} - avg(r.{c}) OVER w AS r{c}" for c in "xyz")}
  FROM frames f JOIN frames r ON r.frame = 0 AND r.atom = f.atom WINDOW w AS (PARTITION BY f.frame)),
 s AS (SELECT frame, count(*) AS n, sum(x * x + y * y + z * z + rx * rx + ry * ry + rz * rz) AS size, {", ".join(f"sum({a} * r{b}) AS {a}r{b}" for a in "xyz" for b in "xyz")} FROM j GROUP BY frame)
 SELECT frame, n, round(sqrt(greatest(0, (size - 2 * sqrt({_SQUARES} + 2 * sqrt({_MINORS}))) / n)), 3) AS rmsd FROM s""")
def kabsch_by_frame(spark, d):
    """The least RMSD of every frame to the first over all rotations."""
    f = table(spark, d, "frames")
    return rounded(dynamics.fit_kabsch(f, f.filter("frame = 0")).drop("matrix"), "rmsd")


@query(P3 + " SELECT atom, round(y + 1, 4) AS x, round(-x + 2, 4) AS y, round(z * 2 + 3, 4) AS z FROM points")
def affine(spark, d):
    m = [0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 2, 0, 1, 2, 3, 1]
    at = points_structure(spark, d).atoms
    return rounded(at.select("atom", *(v.alias(c) for c, v in zip("xyz", vectors.affine(m, vectors.vec())))), "x", "y", "z", digits=4)


@query(P3 + " SELECT atom, " + ", ".join(f"round({c} - 5 * floor({c} / 5 + 0.5), 4) AS {c}" for c in "xyz") + " FROM points")
def min_image_ortho(spark, d):
    at = points_structure(spark, d).atoms
    moved = vectors.minimum_image(vectors.vec(), (5, 5, 5))
    return rounded(at.select("atom", *(v.alias(c) for c, v in zip("xyz", moved))), "x", "y", "z", digits=4)


# Chains ----------------------------------------------------------------------------------


@query(P3 + """, g AS (SELECT p.residue, p.atom, r.chain, r.labelSeq FROM points p JOIN presidues r USING (residue) WHERE p.name = 'CA' AND r.polymer = 'protein'),
 n AS (SELECT *, CASE WHEN lag(labelSeq) OVER (PARTITION BY chain ORDER BY labelSeq) + 1 = labelSeq THEN 0 ELSE 1 END AS s FROM g),
 r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY chain ORDER BY labelSeq) AS BIGINT) AS run FROM n)
 SELECT residue, atom, run, CAST(row_number() OVER (PARTITION BY chain, run ORDER BY labelSeq) - 1 AS BIGINT) AS k FROM r""")
def trace_runs(spark, d):
    return sequence.trace(points_structure(spark, d)).select("residue", "atom", F.col("run").cast("long").alias("run"), F.col("k").cast("long").alias("k"))


@query(P3 + " SELECT chain, min(residue) AS first, max(residue) AS last FROM presidues WHERE polymer <> 'other' GROUP BY chain")
def chain_ends(spark, d):
    return sequence.chain_ends(points_structure(spark, d))


@query(P3 + """, c AS (SELECT residue, min_by(x, atom) FILTER (name = 'C') AS cx, min_by(y, atom) FILTER (name = 'C') AS cy, min_by(z, atom) FILTER (name = 'C') AS cz,
 min_by(x, atom) FILTER (name = 'N') AS nx, min_by(y, atom) FILTER (name = 'N') AS ny, min_by(z, atom) FILTER (name = 'N') AS nz FROM points GROUP BY residue),
 l AS (SELECT r.chain, r.residue, c.*, lead(r.residue) OVER w AS next_residue, lead(nx) OVER w AS mx, lead(ny) OVER w AS my, lead(nz) OVER w AS mz
  FROM presidues r JOIN c ON c.residue = r.residue WHERE polymer = 'protein' WINDOW w AS (PARTITION BY r.chain ORDER BY r.residue))
 SELECT chain, residue, next_residue, round(sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my) + (cz - mz) * (cz - mz)), 3) AS distance FROM l WHERE next_residue IS NOT NULL AND sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my) + (cz - mz) * (cz - mz)) > 2""")
def sequence_gaps(spark, d):
    return rounded(sequence.sequence_gaps(points_structure(spark, d)), "distance")


@query()
def dihedrals(spark, d):
    return rounded(sequence.dihedrals(points_structure(spark, d)), "phi", "psi", "omega")


@query()
def dssp(spark, d):
    return sequence.dssp(points_structure(spark, d))


@query("SELECT event_id, round(coalesce((a - b) / 2, a - value, value - b, 0), 4) AS diff FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def central_difference(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return rounded(sequence.central_difference(ev, "value", ["user_id"], "event_id").select("event_id", "diff"), "diff", digits=4)


# Time ------------------------------------------------------------------------------------


@query("""SELECT event_id, round(CASE WHEN value <= 0 THEN 1.0 WHEN value < 20 THEN 1 + 3 * value / 20 WHEN value < 60 THEN 4.0 WHEN value < 90 THEN 10 + (2 - 10) * (1 - cos((value - 60) / 30 * pi())) / 2 ELSE 2.0 END, 4) AS v FROM events""")
def asof_curve(spark, d):
    k = timeline.Keyframe
    keys = [k(0, 1), k(20, 4, "hold"), k(60, 10, "cosine"), k(90, 2)]
    ev = spark.read.parquet(f"{d}/events.parquet")
    return rounded(ev.select("event_id", timeline.sample(F.col("value"), keys).alias("v")), "v", digits=4)


@query("SELECT event_id, CAST(floor(p) AS INT) AS a, CAST(least(floor(p) + 1, 49) AS INT) AS b, round(p - floor(p), 6) AS t FROM (SELECT event_id, CASE WHEN abs(q - floor(q + 0.5)) < 1e-6 THEN floor(q + 0.5) ELSE q END AS p FROM (SELECT event_id, greatest(0, least(49, value)) AS q FROM events))")
def frame_pair(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    pair = timeline.frame_pair(F.col("value"), 50)
    return rounded(ev.select("event_id", *(c.alias(n) for n, c in pair.items())), "t", digits=6)


@query(duck("frames") + " SELECT 7 AS moment, a.atom, round(CAST(CAST(a.x + (b.x - a.x) * 0.25 AS FLOAT) AS DOUBLE), 2) AS x FROM frames a JOIN frames b ON a.frame = 3 AND b.frame = 4 AND a.atom = b.atom")
def lerp_frames(spark, d):
    moments = spark.createDataFrame([(7, 3.25)], "moment int, position double")
    f = table(spark, d, "frames")
    return rounded(timeline.interpolated(f, moments, 20).select("moment", "atom", "x"), "x", digits=2)


# Volumes ---------------------------------------------------------------------------------

GRID = volume.Grid((20, 20, 20), (2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, -20, -20, -20, 1))
VOLUME = "SELECT CAST(i.i AS INT) AS i, CAST(j.j AS INT) AS j, CAST(k.k AS INT) AS k, CAST((i.i * 3 + j.j * 5 + k.k * 7 + i.i * j.j) % 31 AS DOUBLE) AS v FROM (SELECT unnest(range(20)) AS i) i, (SELECT unnest(range(20)) AS j) j, (SELECT unnest(range(20)) AS k) k"


def _volume(spark) -> DataFrame:
    rows = volume.grid_points(spark, GRID)
    return rows.select("i", "j", "k", F.expr("CAST((i * 3 + j * 5 + k * 7 + i * j) % 31 AS DOUBLE)").alias("v"))


@query(P3 + f""", g AS ({VOLUME}), u AS (SELECT atom, (x + 20) / 2 AS u, (y + 20) / 2 AS v, (z + 20) / 2 AS w FROM points),
 c AS (SELECT *, least(floor(u), 18) AS i0, least(floor(v), 18) AS j0, least(floor(w), 18) AS k0 FROM u WHERE u BETWEEN 0 AND 19 AND v BETWEEN 0 AND 19 AND w BETWEEN 0 AND 19),
 s AS (SELECT atom, sum((1 - abs(u - i)) * (1 - abs(c.v - j)) * (1 - abs(w - k)) * g.v) AS value FROM c JOIN g ON g.i IN (i0, i0 + 1) AND g.j IN (j0, j0 + 1) AND g.k IN (k0, k0 + 1) GROUP BY atom)
 SELECT atom AS point, round(coalesce(value, 0), 3) AS value FROM points LEFT JOIN s USING (atom)""")
def trilinear(spark, d):
    points = points_structure(spark, d).atoms.withColumnRenamed("atom", "point")
    return rounded(volume.sample(points, _volume(spark), GRID), "value")


@query(duck("residues") + " SELECT chain, labelSeq, residue FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY labelSeq DESC) AS r FROM residues) WHERE r <= 2")
def last_two_residues(spark, d):
    w = Window.partitionBy("chain").orderBy(F.col("labelSeq").desc())
    rows = table(spark, d, "residues").withColumn("r", F.row_number().over(w))
    return rows.filter("r <= 2").select("chain", "labelSeq", "residue")
