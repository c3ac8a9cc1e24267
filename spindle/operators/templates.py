"""Partial charges of known components from templates, with a report of what they leave out.

A residue's template is named by its component, its place in its chain, its protonation and its
disulfides; all of that is aggregates of its atoms and joins.  Charges are then one join by
(template, atom name); hydrogens that a structure lacks add theirs to the atom that carries them.
Both are told by a residue's first atom of each name and conformer, a row as short as its template, so
the atoms are gone over twice: for these rows, and to be given their charges.

Templates are data: frames (template, name, charge, parent) and (template, alias, name), small enough to
be sent to every task.  A few common ones are built in; ``read_templates`` takes others from a Parquet or CSV table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from .. import views
from ..structure import Structure
from . import graph, spatial

# Charges of single-atom ions by component.
IONS = {
    "LI": 1, "NA": 1, "K": 1, "RB": 1, "CS": 1, "AG": 1, "CU1": 1,
    "F": -1, "CL": -1, "BR": -1, "IOD": -1,
    "MG": 2, "CA": 2, "SR": 2, "BA": 2, "MN": 2, "FE2": 2, "CO": 2, "NI": 2, "CU": 2, "ZN": 2, "CD": 2, "HG": 2, "PB": 2,
    "FE": 3, "MN3": 3, "3CO": 3,
}
# Components whose templates have variants at the ends of a chain.
PROTEIN = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO",
    "SER", "THR", "TRP", "TYR", "VAL", "HID", "HIE", "HIP", "ASH", "GLH", "LYN", "CYX", "CYM",
)
# Fixed values: (atom, charge, atom that carries it) of built-in templates, from the published force field.
BUILT_IN = {
    "WAT": (("O", -0.834, None), ("H1", 0.417, "O"), ("H2", 0.417, "O")),
    "GLY": (("N", -0.4157, None), ("H", 0.2719, "N"), ("CA", -0.0252, None), ("HA2", 0.0698, "CA"), ("HA3", 0.0698, "CA"), ("C", 0.5973, None), ("O", -0.5679, None)),
    "ALA": (
        ("N", -0.4157, None), ("H", 0.2719, "N"), ("CA", 0.0337, None), ("HA", 0.0823, "CA"), ("CB", -0.1825, None), ("HB1", 0.0603, "CB"), ("HB2", 0.0603, "CB"),
        ("HB3", 0.0603, "CB"), ("C", 0.5973, None), ("O", -0.5679, None),
    ),
    "NALA": (
        ("N", 0.1414, None), ("H1", 0.1997, "N"), ("H2", 0.1997, "N"), ("H3", 0.1997, "N"), ("CA", 0.0962, None), ("HA", 0.0889, "CA"), ("CB", -0.0597, None),
        ("HB1", 0.03, "CB"), ("HB2", 0.03, "CB"), ("HB3", 0.03, "CB"), ("C", 0.6163, None), ("O", -0.5722, None),
    ),
    "CALA": (
        ("N", -0.3821, None), ("H", 0.2681, "N"), ("CA", -0.1747, None), ("HA", 0.1067, "CA"), ("CB", -0.2093, None), ("HB1", 0.0764, "CB"), ("HB2", 0.0764, "CB"),
        ("HB3", 0.0764, "CB"), ("C", 0.7731, None), ("O", -0.8055, None), ("OXT", -0.8055, None),
    ),
    "CYS": (
        ("N", -0.4157, None), ("H", 0.2719, "N"), ("CA", 0.0213, None), ("HA", 0.1124, "CA"), ("CB", -0.1231, None), ("HB2", 0.1112, "CB"), ("HB3", 0.1112, "CB"),
        ("SG", -0.3119, None), ("HG", 0.1933, "SG"), ("C", 0.5973, None), ("O", -0.5679, None),
    ),
    "CYX": (
        ("N", -0.4157, None), ("H", 0.2719, "N"), ("CA", 0.0429, None), ("HA", 0.0766, "CA"), ("CB", -0.079, None), ("HB2", 0.091, "CB"), ("HB3", 0.091, "CB"),
        ("SG", -0.1081, None), ("C", 0.5973, None), ("O", -0.5679, None),
    ),
}
TEMPLATE = "template string, name string, charge double, parent string"
ALIAS = "template string, alias string, name string"
PEPTIDE, SULFUR_REACH = 2.0, 2.5


def built_in(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [(t, n, c, p) for t, atoms in BUILT_IN.items() for n, c, p in atoms]
    return spark.createDataFrame(rows, TEMPLATE), spark.createDataFrame([("NALA", "H", "H1"), ("WAT", "OW", "O")], ALIAS)


def read_templates(spark: SparkSession, path: str, aliases: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Templates and aliases from tables with the columns of TEMPLATE and ALIAS: Parquet, or CSV with a header."""

    def read(at: str, kind: str) -> DataFrame:
        return spark.read.schema(kind).csv(at, header=True) if at.lower().endswith(".csv") else spark.read.schema(kind).parquet(at)

    return read(path, TEMPLATE), read(aliases, ALIAS) if aliases else spark.createDataFrame([], ALIAS)


def polymer_ends(s: Structure) -> DataFrame:
    """(chain, first, last): the first and last polymer residue of every chain."""
    return s.residues.filter("polymer <> 'other'").groupBy("chain").agg(F.min("residue").alias("first"), F.max("residue").alias("last"))


def sequence_gaps(s: Structure, reach: float = PEPTIDE) -> DataFrame:
    """(before, after, distance) of neighbouring polymer residues whose linking atoms are over ``reach`` apart or missing.

    Neighbours follow each other in the residue table.  Of atoms of a name those without a conformer come first, then
    those of least id.
    """
    order = Window.partitionBy("chain").orderBy("residue")
    rows = s.residues.withColumns({"prev": F.lag("residue").over(order), "prev_kind": F.lag("polymer").over(order)})
    rows = rows.filter("prev = residue - 1 AND polymer <> 'other' AND prev_kind <> 'other'")
    pick = F.struct((F.col("altloc") != "").alias("alt"), "atom")
    named = s.atoms.filter(F.col("name").isin("C", "O3'", "N", "P")).groupBy("residue", "name").agg(F.min_by(F.struct("x", "y", "z"), pick).alias("at"))
    left = named.select(F.col("residue").alias("prev"), F.col("name").alias("prev_atom"), F.col("at").alias("l"))
    right = named.select("residue", F.col("name").alias("own_atom"), F.col("at").alias("r"))
    rows = rows.withColumn("prev_atom", F.when(F.col("prev_kind") == "protein", "C").otherwise("O3'")).withColumn("own_atom", F.when(F.col("polymer") == "protein", "N").otherwise("P"))
    joined = rows.join(left, ["prev", "prev_atom"], "left").join(right, ["residue", "own_atom"], "left").withColumn("distance", F.sqrt(spatial.squared_distance("l", "r")))
    return joined.filter(F.col("distance").isNull() | (F.col("distance") > reach)).select(F.col("prev").alias("before"), F.col("residue").alias("after"), "distance")


def near_sulfurs(sulfurs: DataFrame, reach: float = SULFUR_REACH) -> DataFrame:
    """(residue) of the ``sulfurs`` (residue, altloc, model, x, y, z) with one of another residue less than ``reach`` away in their model.

    Places are compared, each once however many sulfurs share it; of a place's residues the least and the greatest tell whether there is another one.
    """
    at = ["model", "x", "y", "z", "altloc"]
    spots = graph.cut(sulfurs.groupBy(*at).agg(F.min("residue").alias("lo"), F.max("residue").alias("hi")))
    clash = (F.col("l.altloc") != "") & (F.col("r.altloc") != "") & (F.col("l.altloc") != F.col("r.altloc"))
    pairs = spatial.near_pairs(spots, spots, reach, ~clash & (F.sqrt(spatial.squared_distance("l", "r")) < reach), ("model",))
    met = pairs.groupBy(*(F.col(f"l_{c}").alias(c) for c in at)).agg(F.min("r_lo").alias("lo"), F.max("r_hi").alias("hi"))
    return sulfurs.join(met, at).filter("lo <> residue OR hi <> residue").select("residue")


def cystines(s: Structure, sulfurs: DataFrame, reach: float = SULFUR_REACH) -> DataFrame:
    """(residue) in a disulfide: by links, or by sulfurs of two cysteines less than ``reach`` apart in one model."""
    near = near_sulfurs(sulfurs, reach)
    if s.links is None:
        return near.distinct()
    linked = s.links.filter(F.col("flags").cast("int").bitwiseAND(S.BOND_FLAGS["disulfide"]) != 0).select(F.explode(F.array("a", "b")).alias("atom"))
    return near.union(s.atoms.join(linked, "atom", "left_semi").select("residue")).distinct()


def template_names(groups: DataFrame, ends: DataFrame, sulfurs: DataFrame, known: DataFrame, his: str | None) -> DataFrame:
    """``groups`` (residue, comp, chain, polymer, hd1, he2, p, wanted, ...) with ``template``, null where none is known.

    known: (template).  The most specific known name of at most three counts.
    """
    base = F.col("comp")
    nucleic = F.when(F.col("polymer") == "dna", F.concat(F.lit("D"), F.regexp_replace(base, "^D", ""))).when(F.col("polymer") == "rna", F.concat(F.lit("R"), F.regexp_replace(base, "^R", ""))).otherwise(base)
    key = F.coalesce("wanted", F.when(base == "HOH", "WAT").otherwise(nucleic))
    protonated = F.lit(his) if his else F.when(F.col("hd1") & F.col("he2"), "HIP").when(F.col("hd1"), "HID").otherwise("HIE")
    rows = groups.join(ends, "chain", "left").join(sulfurs.withColumn("sulfide", F.lit(True)), "residue", "left").withColumn("key", key)
    rows = rows.withColumn("key", F.when(F.col("key") == "HIS", protonated).when((F.col("key") == "CYS") & F.col("sulfide"), "CYX").otherwise(F.col("key")))
    opens, closes = F.col("first") == F.col("residue"), F.col("last") == F.col("residue")
    chain = F.col("key").isin(*PROTEIN) & (F.col("polymer") == "protein")
    base_ = F.col("key").rlike("^[DR][ACGTU]$") & (F.col("polymer") != "other") & ~chain
    bare = ~F.col("p")
    name = F.col("key")
    tried = F.array(
        F.when(chain & opens, F.concat(F.lit("N"), name)).when(base_ & opens & closes & bare, F.concat(name, F.lit("N"))),
        F.when(chain & closes, F.concat(F.lit("C"), name)).when(base_ & opens & bare, F.concat(name, F.lit("5"))),
        F.when(base_ & closes, F.concat(name, F.lit("3"))),
        name,
    )
    one = known.agg(F.collect_set("template").alias("known"))
    found = rows.withColumn("tried", tried).crossJoin(F.broadcast(one))
    return found.select(*groups.columns, F.get(F.filter("tried", lambda n: F.array_contains("known", n)), F.lit(0)).alias("template"))


class TemplateCharges:
    """Charges of ions and of the components that templates know, and a report; each is made when it is asked for.

    charges: (atom, charge); the other frames are the report.
    ions: (residue, comp, charge, source); incomplete: (residue, template, missing); gaps: (before, after, distance);
    unmatched: (comp, name, count, residues); totals: one row (assigned, net_charge), of active atoms.
    """

    def __init__(self, s: Structure, templates: DataFrame, aliases: DataFrame, his: str | None, asked: DataFrame):
        self.s, self.his, self.asked = s, his, asked
        self.templates, self.aliases = templates.groupBy("template", "name", "parent").agg(F.sum("charge").alias("charge")), aliases
        self.keys = ["residue", "comp"] if "comp" in s.atoms.columns else ["residue"]

    @cached_property
    def wide(self) -> DataFrame:
        """Atoms with what their residue says; a residue without a chain takes no part."""
        s = self.s
        formal = F.coalesce(F.col("formalCharge").cast("int"), F.lit(0)) if "formalCharge" in s.atoms.columns else F.lit(0)
        own = [F.col("comp").alias("__comp")] if "comp" in s.atoms.columns else []
        atoms = s.atoms.select("atom", "name", "altloc", "residue", "element", "x", "y", "z", formal.alias("formal"), *own)
        of = s.residues.select("residue", "chain", "polymer", F.col("comp").alias("__of")).join(s.chains.select("chain", "model"), "chain")
        comp = F.coalesce("__comp", "__of") if own else F.col("__of")
        return atoms.join(of, "residue").withColumn("comp", comp).drop("__comp", "__of")

    @cached_property
    def groups(self) -> DataFrame:
        """A row for each component of a residue.

        labels: (altloc, at, names) of every conformer: its least atom and the least atom of each name that any template has; sulfurs: the places of
        a cysteine's sulfurs.
        """
        by = ["residue", "comp", "altloc"]
        sulfur = (F.col("name") == "SG") & (F.col("comp") == "CYS")
        place = [F.when(sulfur, F.col(c)).alias(f"s{c}") for c in "xyz"]
        rows = self.wide.select(*by, "name", "atom", "element", "formal", "chain", "polymer", "model", *place)
        first = F.min_by("formal", F.when(F.col("formal") != 0, F.col("atom")))
        same = [F.min(c).alias(c) for c in ("chain", "model")]
        each = rows.groupBy(*by, "name", "sx", "sy", "sz", "polymer").agg(F.min("atom").alias("at"), F.min_by("element", "atom").alias("element"), first.alias("formal"), F.count("*").alias("n"), *same)
        known = self.templates.select("name").union(self.aliases.select("alias")).distinct().withColumn("known", F.lit(True))
        each = each.join(F.broadcast(known), "name", "left")
        has = lambda n: F.bool_or(F.col("name") == n)
        spot = F.when((F.col("name") == "SG") & (F.col("comp") == "CYS"), F.struct("altloc", *(F.col(f"s{c}").alias(c) for c in "xyz")))
        told = F.when(F.col("formal").isNotNull(), F.struct("at", "formal"))
        labels = each.groupBy(*by).agg(
            F.min("at").alias("at"), F.collect_list(F.when(F.col("known"), F.struct("name", "at"))).alias("names"), F.collect_list(spot).alias("sulfurs"),
            F.min("polymer").alias("polymer"), has("HD1").alias("hd1"), has("HE2").alias("he2"), has("P").alias("p"), F.min("name").alias("one"), F.max("name").alias("other"),
            F.sum("n").alias("n"), F.min(F.struct("at", "element")).alias("element"), F.min(told).alias("formal"), *same,
        )
        groups = labels.groupBy("residue", "comp").agg(
            F.collect_list(F.struct("altloc", "at", "names")).alias("labels"), F.flatten(F.collect_list("sulfurs")).alias("sulfurs"),
            F.min("polymer").alias("polymer"), *(F.bool_or(c).alias(c) for c in ("hd1", "he2", "p")), F.min("one").alias("one"), F.max("other").alias("other"),
            F.sum("n").alias("n"), F.count("altloc").alias("alts"), F.min("element")["element"].alias("element"), F.min("formal")["formal"].alias("formal"), *same,
        )
        usual = S.lookup(F.col("comp"), IONS)
        single = usual.isNotNull() & (F.col("element") != 1) & (F.col("one") == F.col("other")) & (F.col("alts") == F.col("n"))
        groups = groups.withColumn("ion", F.when(single, F.coalesce(F.when(F.col("formal") != 0, F.col("formal")), usual)))
        return graph.stored(groups.drop("one", "other", "n", "alts", "element"))

    @cached_property
    def named(self) -> DataFrame:
        """The groups with their template; null: an ion, or none known."""
        sulfurs = self.groups.select("residue", "model", F.explode("sulfurs").alias("s")).select("residue", "model", "s.*")
        rows = self.groups.join(self.asked.select("residue", F.col("template").alias("wanted")), "residue", "left")
        rows = template_names(rows, polymer_ends(self.s), cystines(self.s, sulfurs), self.templates.select("template").distinct(), self.his)
        rows = rows.withColumn("template", F.when(F.col("ion").isNull(), F.col("template")))
        other = self.aliases.groupBy("template").agg(F.map_from_entries(F.collect_list(F.struct("alias", "name"))).alias("other"))
        rows = rows.join(F.broadcast(other), "template", "left")
        known = lambda n: F.struct(F.coalesce(F.col("other")[n["name"]], n["name"]).alias("name"), n["at"].alias("at"))
        return rows.withColumn("labels", F.transform("labels", lambda g: F.struct(g["altloc"], g["at"], F.transform(g["names"], known).alias("names")))).drop("other")

    @cached_property
    def folds(self) -> DataFrame:
        """``named`` with ``folds``: charges of the hydrogens that a conformer lacks, by the atom that carries them.

        What all conformers share gets the hydrogens of the last one, that whose least atom is the greatest; what the template does not charge
        gets none.
        """
        heavy = self.templates.select("template", F.col("name").alias("parent")).distinct()
        light = self.templates.filter("parent IS NOT NULL").join(F.broadcast(heavy), ["template", "parent"]).groupBy("template").agg(F.collect_list(F.struct("name", "parent", "charge")).alias("light"))
        rows = self.named.join(F.broadcast(light), "template", "left")
        marked = F.filter("labels", lambda g: g["altloc"] != "")
        last = F.array_max(F.transform(marked, lambda g: F.struct(g["at"], g["altloc"])))["altloc"]
        rows = rows.withColumn("last", F.coalesce(last, F.lit("")))
        ends = F.when(F.size(marked) > 0, F.transform(marked, lambda g: g["altloc"])).otherwise(F.array(F.lit("")))

        def carried(c: Column) -> Column:
            here = F.flatten(F.transform(F.filter("labels", lambda g: (g["altloc"] == "") | (g["altloc"] == c)), lambda g: F.transform(g["names"], lambda n: F.struct(n["name"], n["at"], g["altloc"]))))

            def add(h: Column) -> Column:
                at = F.array_min(F.transform(F.filter(here, lambda n: n["name"] == h["parent"]), lambda n: F.struct(n["at"], n["altloc"])))
                takes = ~F.exists(here, lambda n: n["name"] == h["name"]) & at.isNotNull() & ((at["altloc"] != "") | (c == F.col("last")))
                return F.when(takes, F.struct(at["at"].alias("atom"), h["charge"].alias("charge")))

            return F.transform("light", add)

        found = F.filter(F.flatten(F.transform(ends, carried)), lambda f: f.isNotNull())
        return rows.withColumn("folds", F.coalesce(found, F.array().cast("array<struct<atom:bigint,charge:double>>")))

    @cached_property
    def told(self) -> DataFrame:
        """(atom, residue, comp, name, altloc, charge) of all atoms, the charge null where none is known."""
        # A component that its residue tells is the group's; so atoms meet their group by the residue alone.
        atoms = self.wide.select("atom", "residue", "comp", "name", "altloc") if len(self.keys) > 1 else self.s.atoms.select("atom", "residue", "name", "altloc")
        rows = self.folds.select("residue", "comp", "template", "ion", "folds")
        if len(self.keys) > 1:
            rows = rows.withColumnRenamed("comp", "__comp")
            rows = atoms.join(rows.withColumnRenamed("residue", "__r"), (F.col("residue") == F.col("__r")) & F.col("comp").eqNullSafe(F.col("__comp"))).drop("__r", "__comp")
        else:
            rows = atoms.join(rows, "residue")
        rows = rows.join(F.broadcast(self.aliases.select("template", F.col("alias").alias("name"), F.col("name").alias("to"))), ["template", "name"], "left").withColumn("known", F.coalesce("to", "name"))
        entry = self.templates.groupBy("template", F.col("name").alias("known")).agg(F.sum("charge").alias("own"))
        rows = rows.join(F.broadcast(entry), ["template", "known"], "left")
        more = F.aggregate(F.filter("folds", lambda f: f["atom"] == F.col("atom")), F.lit(0.0), lambda s, f: s + f["charge"])
        return rows.select("atom", "residue", "comp", "name", "altloc", F.coalesce(F.col("own") + more, F.col("ion").cast("double")).alias("charge"))

    @cached_property
    def charges(self) -> DataFrame:
        return self.told.filter("charge IS NOT NULL").select("atom", "charge")

    @cached_property
    def ions(self) -> DataFrame:
        source = F.when(F.col("formal") != 0, "imported:formalCharge").otherwise("ccd:ion")
        return self.groups.filter("ion IS NOT NULL").select("residue", "comp", F.col("ion").alias("charge"), source.alias("source"))

    @cached_property
    def incomplete(self) -> DataFrame:
        heavy = self.templates.filter("parent IS NULL").groupBy("template").agg(F.collect_set("name").alias("heavy"))
        held = F.flatten(F.transform("labels", lambda g: F.transform(g["names"], lambda n: n["name"])))
        rows = self.named.join(F.broadcast(heavy), "template").withColumn("missing", F.array_except("heavy", held)).filter("size(missing) > 0")
        return rows.groupBy("residue", "template").agg(F.sort_array(F.flatten(F.collect_list("missing"))).alias("missing"))  # no more than a template's atoms

    @cached_property
    def gaps(self) -> DataFrame:
        return sequence_gaps(self.s)

    @cached_property
    def active(self) -> DataFrame:
        return views.active_atoms(self.s, base=self.told)

    @cached_property
    def unmatched(self) -> DataFrame:
        return unmatched(self.active.filter("charge IS NULL"))

    @cached_property
    def totals(self) -> DataFrame:
        return self.active.agg(F.count("charge").alias("assigned"), F.coalesce(F.sum("charge"), F.lit(0.0)).alias("net_charge"))


def template_charges(s: Structure, templates: DataFrame | None = None, aliases: DataFrame | None = None, his: str | None = None, residues: DataFrame | None = None) -> TemplateCharges:
    """Charges of ions and of the components that templates know.

    ``his``: HID, HIE or HIP for every histidine; else by its hydrogens.  ``residues``: (residue, template) named by the caller.
    Formal charges that an atom column ``formalCharge`` gives count before an ion's usual one.
    """
    if his not in (None, "HID", "HIE", "HIP"):
        raise ValueError("his must be HID, HIE or HIP")
    spark = s.spark
    if templates is None:
        templates, more = built_in(spark)
        aliases = more if aliases is None else aliases
    aliases = spark.createDataFrame([], ALIAS) if aliases is None else aliases
    asked = spark.createDataFrame([], "residue long, template string") if residues is None else residues
    return TemplateCharges(s, templates, aliases, his, asked)


def unmatched(atoms: DataFrame, first: int = 3) -> DataFrame:
    """(comp, name, count, residues): atoms without a charge by component and name, with their first residues.

    The count and the ``first`` distinct residues, by the atoms' order, come from aggregates of bounded size.
    """
    each = graph.stored(atoms.groupBy("comp", "name", "residue").agg(F.count("*").alias("k"), F.min("atom").alias("at")))
    nth = F.row_number().over(Window.partitionBy("comp", "name").orderBy("at"))
    few = each.withColumn("nth", nth).filter(F.col("nth") <= first).groupBy("comp", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "residue"))), lambda r: r["residue"]).alias("residues"))
    return each.groupBy("comp", "name").agg(F.sum("k").alias("count")).join(few, ["comp", "name"])


def known_component(comp: Column) -> Column:
    """Whether a component is an ion or one of the built-in templates' base components."""
    return comp.isin(*IONS, *BUILT_IN, "HOH")
