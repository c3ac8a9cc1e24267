"""Column types, names and fixed lookup values of the structural tables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ATOMS = "atom long, id string, name string, altloc string, residue long, element short, occupancy float, bfactor float, radius float, comp string, x float, y float, z float"
RESIDUES = "residue long, chain long, labelSeq int, authSeq string, insertionCode string, comp string, polymer string, het boolean"
CHAINS = "chain long, model int, labelId string, authId string, entityId string, entityType string, entitySubtype string"
BONDS = "bond long, a long, b long, order tinyint, source string, flags short"
LINKS = "link long, a long, b long, order tinyint, flags short, source string"
INSTANCES = "instance long, chain long, operatorId string, transform array<double>"
FRAMES = "frame int, time double, atom long, x float, y float, z float"
TABLES = {"atoms": ATOMS, "residues": RESIDUES, "chains": CHAINS, "bonds": BONDS, "links": LINKS, "instances": INSTANCES}
POLYMERS = ("protein", "rna", "dna", "other")
DOMAINS = ("atom", "residue", "bond")

# Element symbols by atomic number from 1, query radii and masses from 0.
ELEMENT_SYMBOLS = (
    "H", "HE", "LI", "BE", "B", "C", "N", "O", "F", "NE", "NA", "MG", "AL", "SI", "P", "S", "CL", "AR", "K", "CA", "SC", "TI", "V", "CR",
    "MN", "FE", "CO", "NI", "CU", "ZN", "GA", "GE", "AS", "SE", "BR", "KR", "RB", "SR", "Y", "ZR", "NB", "MO", "TC", "RU", "RH", "PD",
    "AG", "CD", "IN", "SN", "SB", "TE", "I", "XE", "CS", "BA", "LA", "CE", "PR", "ND", "PM", "SM", "EU", "GD", "TB", "DY", "HO", "ER",
    "TM", "YB", "LU", "HF", "TA", "W", "RE", "OS", "IR", "PT", "AU", "HG", "TL", "PB", "BI", "PO", "AT", "RN", "FR", "RA", "AC", "TH",
    "PA", "U", "NP", "PU", "AM", "CM", "BK", "CF", "ES", "FM", "MD", "NO", "LR", "RF", "DB", "SG", "BH", "HS", "MT", "DS", "RG", "CN",
    "UUT", "FL", "UUP", "LV", "UUS", "UUO",
)
QUERY_RADII = (
    1.7, 1.1, 1.4, 1.81, 1.53, 1.92, 1.7, 1.55, 1.52, 1.47, 1.54, 2.27, 1.73, 1.84, 2.1, 1.8, 1.8, 1.75, 1.88, 2.75, 2.31, 2.3, 2.15, 2.05,
    2.05, 2.05, 2.05, 2.0, 2.0, 2.0, 2.1, 1.87, 2.11, 1.85, 1.9, 1.83, 2.02, 3.03, 2.49, 2.4, 2.3, 2.15, 2.1, 2.05, 2.05, 2.0, 2.05, 2.1,
    2.2, 2.2, 1.93, 2.17, 2.06, 1.98, 2.16, 3.43, 2.68, 2.5, 2.48, 2.47, 2.45, 2.43, 2.42, 2.4, 2.38, 2.37, 2.35, 2.33, 2.32, 2.3, 2.28,
    2.27, 2.25, 2.2, 2.1, 2.05, 2.0, 2.0, 2.05, 2.1, 2.05, 1.96, 2.02, 2.07, 1.97, 2.02, 2.2, 3.48, 2.83, 2.0, 2.4, 2.0, 2.3, 2.0, 2.0,
    2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, math.nan, math.nan, math.nan, math.nan, math.nan, math.nan,
    math.nan, math.nan, math.nan,
)
MASSES = (
    12.011, 1.008, 4.0026, 6.94, 9.0122, 10.81, 12.011, 14.007, 15.999, 18.998, 20.18, 22.99, 24.305, 26.982, 28.085, 30.974, 32.06, 35.45,
    39.948, 39.098, 40.078, 44.956, 47.867, 50.942, 51.996, 54.938, 55.845, 58.933, 58.693, 63.546, 65.38, 69.723, 72.63, 74.922, 78.971,
    79.904, 83.798, 85.468, 87.62, 88.906, 91.224, 92.906, 95.95, 98.0, 101.07, 102.91, 106.42, 107.87, 112.41, 114.82, 118.71, 121.76,
    127.6, 126.9, 131.29, 132.91, 137.33, 138.91, 140.12, 140.91, 144.24, 145.0, 150.36, 151.96, 157.25, 158.93, 162.5, 164.93, 167.26,
    168.93, 173.05, 174.97, 178.49, 180.95, 183.84, 186.21, 190.23, 192.22, 195.08, 196.97, 200.59, 204.38, 207.2, 208.98, 209.0, 210.0,
    222.0, 223.0, 226.0, 227.0, 232.04, 231.04, 238.03, 237.05, 244.0, 243.0, 247.0, 247.0, 251.0, 252.0, 257.0, 258.0, 259.0, 266.0,
    267.0, 268.0, 269.0, 270.0, 277.0, 278.0, 281.0, 282.0, 285.0, 286.0, 289.0, 290.0, 293.0, 294.0, 294.0,
)
# Radii for display (1.7 elsewhere) and for bonding, by atomic number.
DISPLAY_RADII = {1: 1.1, 6: 1.7, 7: 1.55, 8: 1.52, 15: 1.8, 16: 1.8, 26: 2.05, 34: 1.9}
DEFAULT_RADIUS = 1.7
COVALENT_RADII = {1: 0.31, 6: 0.76, 7: 0.71, 8: 0.66, 15: 1.07, 16: 1.05}
# Bits of bond flags, by every accepted name.
BOND_FLAGS = {
    "covalent": 1, "metallic": 2, "metal-coordination": 2, "hydrogen": 4, "hydrogen-bond": 4,
    "disulfide": 8, "sulfide": 8, "aromatic": 16, "computed": 32,
}
# Secondary-structure codes in order, and the bits of names and codes.
SS_CODES = ("-", "H", "B", "E", "G", "I", "T", "S", "P")
SS_NAMES = {"helix": 2, "alpha": 130, "pi": 514, "310": 258, "beta": 4, "strand": 68, "sheet": 36, "turn": 16, "bend": 8, "coil": 1}
SS_CODE_FLAGS = (0, 130, 68, 36, 258, 514, 16, 8, 0)
# Component names of polymers and of water.
AMINO_ACIDS = (
    "HIS", "ARG", "LYS", "ILE", "PHE", "LEU", "TRP", "ALA", "MET", "PRO", "CYS", "ASN", "VAL", "GLY", "SER", "GLN", "TYR", "ASP", "GLU",
    "THR", "SEC", "PYL", "UNK", "MSE", "SEP", "TPO", "PTR", "PCA", "HYP", "HSD", "HSE", "HSP", "LSN", "ASPP", "GLUP", "HID", "HIE", "HIP",
    "LYN", "ASH", "GLH", "DAL", "DAR", "DSG", "DAS", "DCY", "DGL", "DGN", "DHI", "DIL", "DLE", "DLY", "MED", "DPN", "DPR", "DSN", "DTH",
    "DTR", "DTY", "DVA", "DNE",
)
RNA_BASES = ("A", "C", "T", "G", "I", "U", "N")
DNA_BASES = ("DA", "DC", "DT", "DG", "DI", "DU", "DN")
WATERS = ("HOH", "WAT", "H2O", "DOD")
PEPTIDE_BREAK = 2.5


def lookup(key: Column, values: dict, default=None) -> Column:
    """A literal map as a column; small tables stay inside code generation."""
    items = [F.lit(v) for pair in values.items() for v in pair]
    found = F.try_element_at(F.create_map(*items), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def by_number(element: Column, values: list[float]) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(v) for v in values)), element.cast("int")), F.lit(math.nan))


def element_symbol(element: Column) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(s) for s in ["", *ELEMENT_SYMBOLS])), element.cast("int")), F.lit(""))


def atomic_number(symbol: Column) -> Column:
    """Atomic number of a symbol in any case; D and T are hydrogen, unknown symbols 0."""
    numbers = {s: i + 1 for i, s in enumerate(ELEMENT_SYMBOLS)} | {"D": 1, "T": 1}
    return lookup(F.upper(F.trim(symbol)), numbers, 0).cast("short")


def display_radius(element: Column) -> Column:
    return lookup(element.cast("int"), DISPLAY_RADII, DEFAULT_RADIUS)


def polymer_kind(comp: Column) -> Column:
    name = F.upper(comp)
    return (
        F.when(name.isin(*AMINO_ACIDS), "protein").when(name.isin(*RNA_BASES), "rna").when(name.isin(*DNA_BASES), "dna").otherwise("other")
    )


def leading_int(text: Column) -> Column:
    """The integer that a string starts with, or null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def ss_kind(code: Column) -> Column:
    return F.when(code.isin(1, 4, 5), "helix").when(code.isin(2, 3), "sheet").otherwise("coil")
