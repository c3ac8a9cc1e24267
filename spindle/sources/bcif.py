"""BinaryCIF files as structures.

A file is a MessagePack map of blocks, categories and encoded columns.  ``read_category``
decodes one category of every file in a Spark task per file, by the fields asked for; the rest is
joins: first-seen numbering of chains and residues, component bonds by atom names, assemblies by
operator lists.  Values that are marked absent ('.') or unknown ('?') are null.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..structure import Structure, validated
from .pqr import IoError

#: Fixed values of the format: numeric types of byte arrays.
DTYPES = {1: "i1", 2: "<i2", 3: "<i4", 4: "u1", 5: "<u2", 6: "<u4", 32: "<f4", 33: "<f8"}
ATOM_SITE = {
    "group_PDB": "string", "id": "string", "type_symbol": "string", "label_atom_id": "string", "label_alt_id": "string", "label_comp_id": "string",
    "label_asym_id": "string", "auth_asym_id": "string", "label_entity_id": "string", "label_seq_id": "int", "auth_seq_id": "string",
    "pdbx_PDB_ins_code": "string", "Cartn_x": "double", "Cartn_y": "double", "Cartn_z": "double", "occupancy": "double", "B_iso_or_equiv": "double",
    "pdbx_formal_charge": "int", "pdbx_PDB_model_num": "int",
}
#: Bond flags and connection types.
COVALENT, METALLIC, HYDROGEN, DISULFIDE, AROMATIC = 1, 2, 4, 8, 16
CONNECTIONS = {"covale": COVALENT, "disulf": COVALENT | DISULFIDE, "metalc": METALLIC, "hydrog": HYDROGEN}
ORDERS = {"doub": 2, "trip": 3, "quad": 4}


def unpack(data: bytes, at: int = 0):
    """(value, next place) of a MessagePack value."""
    tag = data[at]
    at += 1
    if tag < 0x80:
        return tag, at
    if tag >= 0xE0:
        return tag - 256, at
    if tag < 0x90:
        return _mapping(data, at, tag & 15)
    if tag < 0xA0:
        return _sequence(data, at, tag & 15)
    if tag < 0xC0:
        return data[at : at + (tag & 31)].decode(), at + (tag & 31)
    if tag in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[tag], at
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if tag in numbers:
        return struct.unpack_from(numbers[tag], data, at)[0], at + struct.calcsize(numbers[tag])
    sized = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
    if tag not in sized:
        raise ValueError(f"unsupported MessagePack tag {tag}")
    n = struct.unpack_from(sized[tag], data, at)[0]
    at += struct.calcsize(sized[tag])
    if tag >= 0xDE:
        return _mapping(data, at, n)
    if tag >= 0xDC:
        return _sequence(data, at, n)
    piece = data[at : at + n]
    return (piece if tag <= 0xC6 else piece.decode()), at + n


def _sequence(data: bytes, at: int, n: int):
    out = []
    for _ in range(n):
        value, at = unpack(data, at)
        out.append(value)
    return out, at


def _mapping(data: bytes, at: int, n: int):
    flat, at = _sequence(data, at, 2 * n)
    return dict(zip(flat[::2], flat[1::2])), at


def decoded(data, encodings: list[dict]):
    """The values of an encoded array; the encodings are undone from the last to the first."""
    for e in reversed(encodings):
        kind = e["kind"]
        if kind == "ByteArray":
            data = np.frombuffer(data, DTYPES[e["type"]])
        elif kind == "FixedPoint":
            data = data / e["factor"]
        elif kind == "IntervalQuantization":
            data = e["min"] + data * ((e["max"] - e["min"]) / (e["numSteps"] - 1))
        elif kind == "RunLength":
            data = np.repeat(data[::2], data[1::2])
        elif kind == "Delta":
            data = np.cumsum(data, dtype=np.int64) + e["origin"]
        elif kind == "IntegerPacking":
            data = _widened(data.astype(np.int64), e["byteCount"], e["isUnsigned"], e["srcSize"])
        elif kind == "StringArray":
            ends = decoded(e["offsets"], e["offsetEncoding"])
            words = [e["stringData"][a:b] for a, b in zip(ends, ends[1:])] + [None]
            data = np.array(words, object)[decoded(data, e["dataEncoding"])]
        else:
            raise ValueError(f"unsupported encoding {kind}")
    return data


def _widened(packed: np.ndarray, width: int, unsigned: bool, size: int) -> np.ndarray:
    """Integers from runs of limit values that end in another value."""
    high = (1 << (8 * width)) - 1 if unsigned else (1 << (8 * width - 1)) - 1
    goes_on = packed == high
    if not unsigned:
        goes_on |= packed == -high - 1
    last = np.flatnonzero(~goes_on)
    total = np.cumsum(packed)[last]
    return np.diff(total, prepend=0)[:size]


def categories(data: bytes) -> dict[str, dict[str, dict]]:
    """Category name -> column name -> encoded column, of the first block."""
    try:
        root = unpack(data)[0]
        block = root["dataBlocks"][0]
        return {c["name"].lstrip("_"): {x["name"]: x for x in c["columns"]} | {"": c["rowCount"]} for c in block["categories"]}
    except (KeyError, IndexError, TypeError, ValueError, struct.error) as e:
        raise IoError("INVALID_BCIF", str(e)) from e


def column(encoded: dict, kind: str) -> pa.Array:
    """One column as an Arrow array of Spark type ``kind``; masked values are null."""
    values = decoded(encoded["data"]["data"], encoded["data"]["encoding"])
    absent = np.zeros(len(values), bool)
    if encoded.get("mask"):
        absent = np.asarray(decoded(encoded["mask"]["data"], encoded["mask"]["encoding"])) != 0
    if values.dtype == object:
        absent |= np.array([v is None or v in (".", "?") for v in values], bool)
    if kind == "string":
        rows = [None if no else str(v) for v, no in zip(values.tolist(), absent)]
        return pa.array(rows, pa.string())
    number = [None if no else _number(v) for v, no in zip(values.tolist(), absent)]
    if kind == "double":
        return pa.array(number, pa.float64())
    return pa.array([None if v is None or v != v else int(v) for v in number], pa.int32())


def _number(value) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def read_category(spark: SparkSession, path: str, name: str, fields: dict[str, str]) -> DataFrame:
    """(file, row, fields ...) of a category of all files under ``path``; fields a file lacks are null."""
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = categories(content).get(name)
                if found is None:
                    continue
                n = found[""]
                cols = [column(found[f], kind) if f in found else pa.nulls(n, kinds[kind]) for f, kind in fields.items()]
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(range(n), pa.int64()), *cols], ["file", "row", *fields])

    schema = "file string, row long, " + ", ".join(f"`{f}` {kind}" for f, kind in fields.items())
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _has(spark: SparkSession, path: str) -> set[str]:
    """Names of the categories that any file has, and ``category.field`` of their columns."""

    def run(batches):
        for batch in batches:
            names = [n for content in batch.column(0).to_pylist() for c, cols in categories(content).items() for n in (c, *(f"{c}.{x}" for x in cols if x))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return {r["name"] for r in spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string").distinct().collect()}


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row per key with a number in order of first appearance (per file), and that row's number."""
    firsts = rows.groupBy("file", *keys).agg(F.min("row").alias("first"))
    return firsts.withColumn(name, F.row_number().over(Window.partitionBy("file").orderBy("first")).cast("long") - 1)


def read_structure(spark: SparkSession, path: str, assembly: str | None = None, check: bool = True) -> Structure:
    """The structure in a file: atoms, residues, chains, links and instances.

    ``assembly`` names a biological assembly, whose chains and operators become the instances;
    without it every chain has one identity instance.  Residues are told apart by chain,
    sequence number, author number and insertion code, not by component.  A path with several files is refused: their
    atoms and entities would have the same numbers.
    """
    if spark.read.format("binaryFile").load(path).select("path").limit(2).count() > 1:
        raise IoError("SEVERAL_FILES", "a structure is read from one file")
    has = _has(spark, path)
    if "atom_site" not in has:
        raise IoError("MISSING_ATOM_SITE", "no atom_site category")
    site = read_category(spark, path, "atom_site", ATOM_SITE)
    site = site.withColumns(
        {
            "model": F.coalesce("pdbx_PDB_model_num", F.lit(1)), "asym": F.coalesce("label_asym_id", F.lit("")), "seq": F.coalesce("label_seq_id", F.lit(-1)),
            "comp": F.coalesce("label_comp_id", F.lit("UNK")), "ins": F.coalesce("pdbx_PDB_ins_code", F.lit("")),
        }
    ).withColumn("auth", F.coalesce("auth_seq_id", F.col("seq").cast("string")))
    chain_key, residue_key = ["model", "asym"], ["model", "asym", "seq", "auth", "ins"]
    chains, residues = _numbered(site, chain_key, "chain"), _numbered(site, residue_key, "residue")
    atoms = site.join(residues.drop("first"), ["file", *residue_key]).join(chains.drop("first"), ["file", *chain_key])
    first = site.select("file", F.col("row").alias("first"), "comp", "group_PDB", "label_entity_id", "auth_asym_id")
    chain_rows = chains.join(first, ["file", "first"])
    residue_rows = residues.join(first, ["file", "first"]).join(chains.select("file", *chain_key, "chain"), ["file", *chain_key])
    number = S.atomic_number(F.coalesce("type_symbol", F.lit("")))
    out = atoms.select(
        F.col("row").alias("atom"), F.coalesce("id", (F.col("row") + 1).cast("string")).alias("id"), F.coalesce("label_atom_id", F.lit("")).alias("name"),
        F.coalesce("label_alt_id", F.lit("")).alias("altloc"), "residue", number.alias("element"), F.coalesce("occupancy", F.lit(1.0)).cast("float").alias("occupancy"),
        F.coalesce("B_iso_or_equiv", F.lit(0.0)).cast("float").alias("bfactor"), S.display_radius(number).cast("float").alias("radius"), "comp",
        *(F.coalesce(f"Cartn_{c}", F.lit(0.0)).cast("float").alias(c) for c in "xyz"), F.coalesce("pdbx_formal_charge", F.lit(0)).cast("byte").alias("formalCharge"),
    )
    kinds = entities(spark, path)
    chain_out = chain_rows.withColumn("entityId", F.coalesce("label_entity_id", F.lit(""))).join(kinds, "entityId", "left").select(
        "chain", "model", F.col("asym").alias("labelId"), F.coalesce("auth_asym_id", "asym").alias("authId"), "entityId",
        F.coalesce("type", F.lit("")).alias("entityType"), F.coalesce("subtype", F.lit("other")).alias("entitySubtype"),
    )
    residue_out = residue_rows.select(
        "residue", "chain", F.col("seq").alias("labelSeq"), F.col("auth").alias("authSeq"), F.col("ins").alias("insertionCode"), "comp",
        S.polymer_kind(F.col("comp")).alias("polymer"), (F.coalesce("group_PDB", F.lit("")) != "ATOM").alias("het"), "asym", "seq",
    )
    codes = secondary_structure(spark, path, residue_rows)
    residue_out = residue_out.join(codes, ["asym", "seq"], "left").drop("asym", "seq").withColumn("ssCode", F.coalesce("ssCode", F.lit(0)))
    told = {"formalCharge": ("atom", "imported:mmcif" if "atom_site.pdbx_formal_charge" in has else "default")}
    told["ssCode"] = ("residue", "imported:mmcif" if has & {"struct_conf", "struct_sheet_range"} else "default")
    made = identity_instances(chain_out) if assembly is None else assembly_instances(spark, path, chain_out, assembly)
    links = read_links(spark, path, out, residue_out, chain_out) if has & {"chem_comp_bond", "struct_conn"} else None
    found = Structure(atoms=out, residues=residue_out, chains=chain_out, links=links, instances=made, attributes=told)
    return validated(found) if check else found


def entities(spark: SparkSession, path: str) -> DataFrame:
    """(entityId, type, subtype): lower-case types; the polymer's or branch's kind, or null."""
    of = read_category(spark, path, "entity", {"id": "string", "type": "string"}).filter("id is not null")
    poly = read_category(spark, path, "entity_poly", {"entity_id": "string", "type": "string"})
    branch = read_category(spark, path, "pdbx_entity_branch", {"entity_id": "string", "type": "string"})
    kinds = poly.union(branch).groupBy(F.col("entity_id").alias("id")).agg(F.min("type").alias("subtype"))
    return of.join(kinds, "id", "left").groupBy(F.col("id").alias("entityId")).agg(F.lower(F.min_by("type", "row")).alias("type"), F.min("subtype").alias("subtype"))


def secondary_structure(spark: SparkSession, path: str, residues: DataFrame) -> DataFrame:
    """(asym, seq, ssCode): helices by class, turns, bends and strands; one code per label, for every model."""
    ends = {"beg_label_asym_id": "string", "beg_label_seq_id": "int", "end_label_seq_id": "int"}
    conf = read_category(spark, path, "struct_conf", ends | {"conf_type_id": "string", "pdbx_PDB_helix_class": "string"})
    helix = F.when(F.col("pdbx_PDB_helix_class") == "5", 4).when(F.col("pdbx_PDB_helix_class") == "3", 5).otherwise(1)
    kind = F.upper("conf_type_id")
    code = F.when(kind.startswith("HELX"), helix).when(kind.startswith("STRN"), 3).when(kind.startswith("TURN"), 6).when(kind.startswith("BEND"), 7).otherwise(0)
    strand = read_category(spark, path, "struct_sheet_range", ends)
    ranges = conf.select(*ends, code.alias("code")).union(strand.select(*ends, F.lit(3)))
    # Ranges are lists of label numbers; priorities are those of the imported flags.
    rank = F.when(F.col("code") == 4, 0).when(F.col("code") == 5, 1).when(F.col("code") == 3, 2).when(F.col("code") == 1, 3).otherwise(F.col("code"))
    at = ranges.filter("code > 0 AND end_label_seq_id >= beg_label_seq_id").select(
        F.col("beg_label_asym_id").alias("asym"), F.explode(F.sequence("beg_label_seq_id", "end_label_seq_id")).alias("seq"), "code", rank.alias("rank")
    )
    return at.groupBy("asym", "seq").agg(F.min_by("code", "rank").alias("ssCode")).join(residues.select("asym", "seq").distinct(), ["asym", "seq"], "left_semi")


def identity_instances(chains: DataFrame) -> DataFrame:
    one = F.array(*(F.lit(float(i % 5 == 0)) for i in range(16)))
    return chains.select(F.col("chain").alias("instance"), "chain", F.lit("identity").alias("operatorId"), one.alias("transform"))


def operators_of(expression: str) -> list[list[str]]:
    """``(1-3,X)(P)`` -> every product as a list of operator ids, the first list varying slowest."""
    groups = [g for g in expression.replace("(", "|").replace(")", "|").split("|") if g.strip(" ,")]
    if "(" not in expression:
        groups = [expression]
    lists = []
    for g in groups:
        ids: list[str] = []
        for part in (p.strip() for p in g.split(",")):
            low, dash, high = part.partition("-")
            ids.extend(map(str, range(int(low), int(high) + 1)) if dash and low.isdigit() and high.isdigit() else [part] if part else [])
        lists.append(ids)
    return [list(p) for p in itertools.product(*lists)]


def assembly_instances(spark: SparkSession, path: str, chains: DataFrame, assembly: str) -> DataFrame:
    """One instance for each chain (in every model) and operator product of the assembly.

    The operator lists are a table of the file's head, a few rows that the driver expands.
    """
    gen = read_category(spark, path, "pdbx_struct_assembly_gen", {"assembly_id": "string", "oper_expression": "string", "asym_id_list": "string"})
    groups = gen.filter(F.col("assembly_id") == assembly).orderBy("row").collect()
    if not groups:
        raise IoError("UNKNOWN_ASSEMBLY", f"no biological assembly with id {assembly!r}")
    cells = [f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)] + [f"vector[{i}]" for i in (1, 2, 3)]
    listed = read_category(spark, path, "pdbx_struct_oper_list", {"id": "string"} | dict.fromkeys(cells, "double")).collect()
    matrices = {}
    for r in listed:
        m = np.eye(4)
        m[:3, :3] = np.array([r[c] for c in cells[:9]]).reshape(3, 3)
        m[:3, 3] = [r[c] for c in cells[9:]]
        matrices[r["id"]] = m
    rows = []
    for g, group in enumerate(groups):
        for o, product in enumerate(operators_of(group["oper_expression"])):
            m = np.eye(4)
            for op in product:
                m = m @ matrices[op]
            flat = m.T.reshape(-1).tolist()
            rows.extend((g, a, o, asym.strip(), "x".join(product), flat) for a, asym in enumerate(group["asym_id_list"].split(",")))
    table = spark.createDataFrame(rows, "g int, a int, o int, labelId string, operatorId string, transform array<double>")
    found = chains.select("chain", "labelId").join(table, "labelId")
    order = Window.orderBy("g", "a", "chain", "o")
    return found.withColumn("instance", F.row_number().over(order).cast("long") - 1).select("instance", "chain", "operatorId", "transform")


def read_links(spark: SparkSession, path: str, atoms: DataFrame, residues: DataFrame, chains: DataFrame) -> DataFrame:
    """(link, a, b, order, flags, source): bonds of components by atom names, and the listed connections."""
    bond = read_category(spark, path, "chem_comp_bond", dict.fromkeys(("comp_id", "atom_id_1", "atom_id_2", "value_order", "pdbx_aromatic_flag"), "string"))
    kind = F.lower(F.coalesce("value_order", F.lit("sing")))
    order = S.lookup(kind, ORDERS, 1)
    soft = (F.lower(F.coalesce("pdbx_aromatic_flag", F.lit("n"))) == "y") | (kind == "delo")
    flags = F.lit(COVALENT).bitwiseOR(F.when(soft, AROMATIC).otherwise(0))
    bond = bond.select(F.col("comp_id").alias("comp"), "atom_id_1", "atom_id_2", order.alias("order"), flags.alias("flags")).dropDuplicates(["comp", "atom_id_1", "atom_id_2"])
    # Deuterium takes the bonds of the hydrogen in its place.
    plain = F.when((F.col("element") == 1) & F.col("name").startswith("D"), F.concat(F.lit("H"), F.expr("substring(name, 2)"))).otherwise(F.col("name"))
    at = atoms.select("atom", "residue", "comp", "altloc", plain.alias("name"))
    x = at.select(F.col("atom").alias("a"), "residue", "comp", F.col("altloc").alias("la"), F.col("name").alias("atom_id_1"))
    y = at.select(F.col("atom").alias("b"), "residue", "comp", F.col("altloc").alias("lb"), F.col("name").alias("atom_id_2"))
    together = (F.col("la") == "") | (F.col("lb") == "") | (F.col("la") == F.col("lb"))
    inside = x.join(F.broadcast(bond), ["comp", "atom_id_1"]).join(y, ["residue", "comp", "atom_id_2"]).filter(together & (F.col("a") != F.col("b")))
    inside = inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "order", "flags", F.lit("component").alias("source"))
    named = ("label_asym_id", "label_seq_id", "auth_seq_id", "label_comp_id", "label_atom_id")
    cols = {f"ptnr{p}_{c}": "string" for p in (1, 2) for c in named} | {f"pdbx_ptnr{p}_{c}": "string" for p in (1, 2) for c in ("label_alt_id", "PDB_ins_code")}
    conn = read_category(spark, path, "struct_conn", cols | {"conn_type_id": "string", "pdbx_value_order": "string"})
    where = atoms.join(residues.select("residue", "chain", "labelSeq", "authSeq", "insertionCode"), "residue").join(chains.select("chain", "model", "labelId"), "chain")
    where = where.join(F.broadcast(chains.agg(F.min_by("model", "chain").alias("model"))), "model")
    for p, end in ((1, "a"), (2, "b")):
        side = where.select(F.col("atom").alias(end), "labelId", "labelSeq", "authSeq", "insertionCode", F.col("comp").alias("__comp"), "name", "altloc")
        here = lambda c, p=p: F.col(f"ptnr{p}_{c}")
        alt = F.col(f"pdbx_ptnr{p}_label_alt_id")
        on = (here("label_asym_id") == F.col("labelId")) & (here("label_atom_id") == F.col("name")) & (here("label_comp_id") == F.col("__comp"))
        on = on & (F.coalesce(here("label_seq_id").try_cast("int"), F.lit(-1)) == F.col("labelSeq"))
        on = on & (here("auth_seq_id").isNull() | (here("auth_seq_id") == F.col("authSeq"))) & (F.coalesce(F.col(f"pdbx_ptnr{p}_PDB_ins_code"), F.lit("")) == F.col("insertionCode"))
        conn = conn.join(side, on & (alt.isNull() | (alt == F.col("altloc")))).groupBy(*conn.columns).agg(F.min(end).alias(end))
    flag = S.lookup(F.lower(F.regexp_extract("conn_type_id", r"^([A-Za-z]+)", 1)), CONNECTIONS, COVALENT)
    listed = conn.select("a", "b", S.lookup(F.lower(F.coalesce("pdbx_value_order", F.lit("sing"))), ORDERS, 1).alias("order"), flag.alias("flags"), F.lit("struct_conn").alias("source"))
    every = inside.distinct().union(listed.filter("a <> b"))
    return every.select(F.monotonically_increasing_id().alias("link"), "a", "b", F.col("order").cast("byte").alias("order"), F.col("flags").cast("short").alias("flags"), "source")
