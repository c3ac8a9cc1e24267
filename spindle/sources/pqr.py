"""PQR text files as structures.

Lines are numbered with ``posexplode`` over the whole text, fields are taken with regular
expressions, and MODEL and TER records number segments by a running sum over the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..structure import Structure, StructureError, validated

NUMBER = r"[+-]?\d*\.\d*(?:[eE][+-]?\d+)?"


class IoError(StructureError):
    """A file that can't be read; ``code`` is stable."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record, name, comp, chain, seq, insertion, model, segment, x, y, z, charge, radius)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return parse(files)


def parse(files: DataFrame) -> DataFrame:
    """The records of (file, value) texts; malformed lines have null fields and fail in ``structure``."""
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    kind = F.regexp_extract("text", r"^(ATOM|HETATM|MODEL|TER)", 1)
    lines = lines.withColumn("record", kind).filter("record <> ''")
    by_line = Window.partitionBy("file").orderBy("line")
    edge = F.col("record").isin("MODEL", "TER").cast("int")
    lines = lines.withColumn("segment", F.sum(edge).over(by_line).cast("int"))
    told = F.when(F.col("record") == "MODEL", F.coalesce(F.trim(F.substring("text", 6, 80)).try_cast("int"), F.sum((F.col("record") == "MODEL").cast("int")).over(by_line) + 1))
    lines = lines.withColumn("model", F.coalesce(F.last(told, True).over(by_line), F.lit(1)).cast("int"))
    rows = lines.filter(F.col("record").isin("ATOM", "HETATM"))
    # The last tokens with a decimal point hold x y z charge radius; neighbours may be glued.
    parts = rows.withColumn("__t", F.regexp_extract("text", r"^(.*?)((?:\s+\S*\.\S*)+)\s*$", 2))
    parts = parts.withColumn("__n", F.regexp_extract_all("__t", F.lit(f"({NUMBER})"), 1))
    head = F.regexp_extract("text", r"^(?:ATOM|HETATM)\s*(.*?)((?:\s+\S*\.\S*)+)\s*$", 1)
    parts = parts.withColumn("__h", F.split(F.trim(head), r"\s+"))
    size = F.size("__h")
    seq = F.element_at("__h", -1)
    good = (F.size("__n") == 5) & size.isin(4, 5)
    out = parts.select(
        "file", "line", "record", "model", "segment", good.alias("ok"), F.get("__h", F.lit(1)).alias("name"), F.get("__h", F.lit(2)).alias("comp"),
        F.when(size == 5, F.get("__h", F.lit(3))).otherwise("").alias("chain"), F.regexp_extract(seq, r"^(-?\d+)(\w?)$", 1).try_cast("int").alias("seq"),
        F.regexp_extract(seq, r"^(-?\d+)(\w?)$", 2).alias("insertion"), *(F.get("__n", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "charge", "radius"))),
    )
    return out


def structure(records: DataFrame, check: bool = True) -> Structure:
    """Tables from records: residues and chains are numbered in order of appearance."""
    if check:
        bad = records.filter("NOT ok OR seq IS NULL OR radius < 0 OR radius IS NULL").select("line").limit(1).collect()
        if bad:
            raise IoError("PARSE", f"line {bad[0]['line'] + 1}")
        if records.isEmpty():
            raise IoError("NO_ATOMS", "no ATOM or HETATM records")
    at = Window.partitionBy("file").orderBy("line")
    rows = records.withColumn("atom", F.row_number().over(at).cast("long") - 1)
    ck, rk = ["file", "model", "segment", "chain"], ["file", "model", "segment", "chain", "seq", "insertion", "comp"]
    chains = rows.groupBy(*ck).agg(F.min("atom").alias("__f"), F.count("*").alias("__c"))
    chains = chains.withColumn("__chain", F.row_number().over(Window.partitionBy("file").orderBy("__f")).cast("long") - 1)
    residues = rows.groupBy(*rk).agg(F.min("atom").alias("__f"), F.max((F.col("record") == "HETATM").cast("int")).alias("__het"))
    residues = residues.withColumn("__residue", F.row_number().over(Window.partitionBy("file").orderBy("__f")).cast("long") - 1)
    wide = rows.join(chains.drop("__f", "__c"), ck).join(residues.drop("__f"), rk)
    element = S.atomic_number(F.regexp_extract("name", r"^\d*([A-Za-z])", 1))
    atoms = wide.select(
        "atom", F.col("atom").cast("string").alias("id"), "name", F.lit("").alias("altloc"), F.col("__residue").alias("residue"), element.alias("element"),
        F.lit(1.0).cast("float").alias("occupancy"), F.lit(0.0).cast("float").alias("bfactor"),
        F.when(F.col("radius") > 0, F.col("radius")).otherwise(S.display_radius(element)).cast("float").alias("radius"), F.lit(None).cast("string").alias("comp"),
        *(F.col(c).cast("float").alias(c) for c in "xyz"), F.col("charge").cast("float").alias("charge"),
    )
    res = residues.join(chains.drop("__f", "__c"), ck).select(
        F.col("__residue").alias("residue"), F.col("__chain").alias("chain"), F.col("seq").alias("labelSeq"), F.col("seq").cast("string").alias("authSeq"),
        F.col("insertion").alias("insertionCode"), "comp", S.polymer_kind(F.col("comp")).alias("polymer"), (F.col("__het") == 1).alias("het"),
    )
    names = chains.select(F.col("__chain").alias("chain"), "model", F.concat(F.lit("S"), F.col("segment").cast("string"), F.col("chain")).alias("labelId"), F.col("chain").alias("authId"))
    out = Structure(atoms=atoms, residues=res, chains=names, attributes={"charge": ("atom", "pqr")})
    return validated(out) if check else out


def report(records: DataFrame) -> DataFrame:
    """(atoms, residues, net_charge, radius_fallbacks) of the records."""
    return records.agg(
        F.count("*").alias("atoms"), F.countDistinct("model", "segment", "chain", "seq", "insertion", "comp").alias("residues"),
        F.round(F.sum("charge"), 6).alias("net_charge"), F.sum((F.col("radius") == 0).cast("int")).alias("radius_fallbacks"),
    )


#: How far a hydrogen may lie from the heavy atom that takes its charge, and how much a residue's sum may be off.
FOLD_DISTANCE, DELTA_TOLERANCE = 1.3, 1e-3


def apply_charges(s: Structure, records: DataFrame) -> tuple[Structure, dict[str, DataFrame]]:
    """``s`` with the records' charges as ``partialCharge``, and a report.

    Records of the first model find atoms by chain, author number, insertion code and name, in
    every model and conformer.  The charge of a hydrogen that a conformer of a residue lacks goes
    to its nearest heavy atom there.  The report has the frames matched (n), unmatched_atoms,
    unmatched_records and residue_delta (residues whose charges don't add up to the records').
    """
    first = records.agg(F.min_by("model", "line").alias("m"), F.max(F.col("chain") != "").alias("named")).first()
    key = ["__c", "__s", "__i"]
    rec = records.filter(F.col("model") == F.lit(first["m"])).select("line", "name", "charge", "x", "y", "z", F.col("chain").alias("__c"), F.col("seq").cast("string").alias("__s"), F.col("insertion").alias("__i"))
    rec = rec.withColumn("hydrogen", F.col("name").rlike(r"^\d*[Hh]"))
    chain = F.col("authId") if first["named"] else F.lit("")
    res = s.residues.join(s.chains, "chain").select("residue", "model", "labelId", "authId", chain.alias("__c"), F.col("authSeq").alias("__s"), F.col("insertionCode").alias("__i"))
    if not first["named"]:
        used = res.join(rec.select(*key).distinct(), key, "left_semi")
        torn = used.groupBy(*key).agg(F.countDistinct("labelId").alias("n"), F.sort_array(F.collect_set("labelId")).alias("labels")).filter("n > 1").first()
        if torn:
            raise IoError("AMBIGUOUS_CHAIN", f"no chain ids, and residue {torn['__s']}{torn['__i']} is in chains {', '.join(torn['labels'])}")
    at = s.atoms.select("atom", "residue", F.col("name").alias("aname"), "altloc")
    placed = rec.join(res.select("residue", *key), key)
    hit = placed.join(at, (placed["residue"] == at["residue"]) & (placed["name"] == at["aname"])).select("line", "atom", "charge", "hydrogen")
    base = hit.groupBy("atom").agg(F.max_by("charge", "line").alias("base"))
    # Every conformer of a residue has its own atoms and those without a code.
    codes = at.groupBy("residue").agg(F.collect_set(F.when(F.col("altloc") != "", F.col("altloc"))).alias("codes"))
    conformers = codes.select("residue", F.explode(F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.array(F.lit("")))).alias("alt"))
    copies = conformers.join(at, "residue").filter((F.col("altloc") == "") | (F.col("altloc") == F.col("alt"))).select("residue", "alt", "aname", "atom")
    lacking = placed.filter("hydrogen").select("line", "name", "charge", "residue", *key, *(F.col(c).alias(f"h{c}") for c in "xyz")).join(conformers, "residue")
    have = copies.select("residue", "alt", F.col("aname").alias("name")).distinct()
    lacking = lacking.join(have, ["residue", "alt", "name"], "left_anti")
    heavy = rec.filter("NOT hydrogen").join(hit.select("line").distinct(), "line", "left_semi").select(*key, F.col("line").alias("kline"), F.col("name").alias("kname"), "x", "y", "z")
    near = lacking.join(heavy, key).join(have.withColumnRenamed("name", "kname"), ["residue", "alt", "kname"])
    d2 = sum(((F.col(f"h{c}") - F.col(c)) * (F.col(f"h{c}") - F.col(c)) for c in "xyz"), F.lit(0.0))
    near = near.withColumn("d2", d2).filter(F.col("d2") <= FOLD_DISTANCE * FOLD_DISTANCE)
    best = near.groupBy("line", "residue", "alt").agg(F.min_by("kname", F.struct("d2", -F.col("kline"))).alias("aname"), F.first("charge").alias("charge"))
    folded = best.join(copies, ["residue", "alt", "aname"]).select("line", "atom", "charge").distinct().groupBy("atom").agg(F.sum("charge").alias("more"))
    values = s.atoms.select("atom").join(base, "atom", "left").join(folded, "atom", "left")
    values = values.select("atom", (F.coalesce("base", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).cast("float").alias("partialCharge"))
    out = s.with_attributes({"partialCharge": values}, provenance="imported:pqr")
    lost = lacking.select("line", "residue", "alt").join(best.select("line", "residue", "alt"), ["line", "residue", "alt"], "left_anti").select("line")
    nowhere = rec.join(hit.select("line"), "line", "left_anti").join(placed.filter("hydrogen").select("line"), "line", "left_anti").select("line")
    unmatched = rec.join(lost.union(nowhere).distinct(), "line", "left_semi").select(*(F.col(c).alias(n) for c, n in zip(key, ("chain", "seq", "insertion"))), "name")
    sums = rec.groupBy(*key).agg(F.sum("charge").alias("pqr"))
    one = copies.groupBy("residue", "alt", "aname").agg(F.min("atom").alias("atom")).join(values, "atom")
    held = one.groupBy("residue", "alt").agg(F.sum(F.col("partialCharge").cast("double")).alias("assigned"))
    delta = sums.join(res, key).join(held, "residue").filter(F.abs(F.col("assigned") - F.col("pqr")) > DELTA_TOLERANCE)
    names = s.atoms.select("atom", "residue", "name").join(base, "atom", "left_anti").join(res.select("residue", "authId", "__s", "__i"), "residue")
    report_ = {
        "matched": base.agg(F.count("*").alias("n")),
        "unmatched_atoms": names.select("atom", F.col("authId").alias("chain"), F.col("__s").alias("seq"), F.col("__i").alias("insertion"), "name"),
        "unmatched_records": unmatched,
        "residue_delta": delta.select("residue", "model", F.col("alt").alias("altloc"), "pqr", "assigned"),
    }
    return out, report_
