"""The driver's tables as structures, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..structure import Structure

CTES = {
    "chains": (
        "SELECT c_custkey AS chain, CAST(n_regionkey + 1 AS INT) AS model, concat('L', CAST(c_custkey AS STRING)) AS labelId, c_name AS authId, "
        "c_mktsegment AS entityId, CASE WHEN c_mktsegment = 'BUILDING' THEN 'water' WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE 'polymer' END AS entityType, "
        "'' AS entitySubtype FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"
    ),
    "residues": (
        "SELECT o_orderkey AS residue, o_custkey AS chain, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS labelSeq, "
        "concat(CAST(o_orderkey % 500 AS STRING), CASE WHEN o_orderkey % 7 = 0 THEN 'A' ELSE '' END) AS authSeq, '' AS insertionCode, o_orderpriority AS comp, "
        "CASE o_orderstatus WHEN 'F' THEN 'protein' WHEN 'O' THEN 'rna' ELSE 'dna' END AS polymer, o_orderkey % 3 = 0 AS het, CAST(o_orderkey % 9 AS INT) AS ssCode FROM {orders}"
    ),
    "atoms": (
        "SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
        "l_returnflag, l_linestatus, l_shipdate) AS atom, CAST(l_partkey AS STRING) AS id, l_linestatus AS name, l_returnflag AS altloc, l_orderkey AS residue, "
        "CAST(l_linenumber AS SMALLINT) AS element, CAST(l_discount + 0.0 AS DOUBLE) AS occupancy, CAST(l_quantity AS DOUBLE) AS bfactor, "
        "CAST(l_partkey % 97 AS DOUBLE) / 2 AS x, CAST(l_suppkey % 89 AS DOUBLE) / 2 AS y, CAST(l_linenumber AS DOUBLE) AS z FROM {lineitem}"
    ),
    "points": (
        "SELECT vec_id AS atom, CAST(vec_id AS STRING) AS id, CASE vec_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'O' END AS name, '' AS altloc, "
        "CAST(floor(vec_id / 4) AS BIGINT) AS residue, CAST(CASE label % 4 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 16 END AS SMALLINT) AS element, "
        "CAST(1 AS DOUBLE) AS occupancy, CAST(label AS DOUBLE) AS bfactor, CAST({e}0] AS DOUBLE) * 40 AS x, CAST({e}1] AS DOUBLE) * 40 AS y, CAST({e}2] AS DOUBLE) * 40 AS z FROM {embeddings}"
    ),
    "presidues": (
        "SELECT residue, CAST(floor(residue / 25) AS BIGINT) AS chain, CAST(residue % 25 + 1 + CASE WHEN residue % 25 > 12 THEN 3 ELSE 0 END AS INT) AS labelSeq, "
        "CAST(residue AS STRING) AS authSeq, '' AS insertionCode, CASE WHEN residue % 5 = 0 THEN 'HOH' ELSE 'ALA' END AS comp, "
        "CASE WHEN residue % 5 = 0 THEN 'other' ELSE 'protein' END AS polymer, false AS het FROM (SELECT DISTINCT CAST(floor(vec_id / 4) AS BIGINT) AS residue FROM {embeddings})"
    ),
    "pchains": (
        "SELECT DISTINCT CAST(floor(vec_id / 100) AS BIGINT) AS chain, CAST(floor(vec_id / 100) % 2 + 1 AS INT) AS model, "
        "concat('P', CAST(CAST(floor(vec_id / 100) AS BIGINT) AS STRING)) AS labelId, 'A' AS authId FROM {embeddings}"
    ),
    "pbonds": (
        "SELECT vec_id AS bond, vec_id AS a, vec_id + 1 + vec_id % 3 AS b, CAST(1 + vec_id % 3 AS INT) AS \"order\", CAST(CASE WHEN vec_id % 5 = 0 THEN 2 WHEN vec_id % 7 = 0 THEN 17 ELSE 1 END AS INT) AS flags "
        "FROM {embeddings} WHERE vec_id % 4 <> 3 AND vec_id + 3 < (SELECT max(vec_id) FROM {embeddings})"
    ),
    "frames": (
        "SELECT CAST(e.event_id % 20 AS INT) AS frame, e.event_id - e.event_id % 20 AS atom, e.value AS x, e.value * 0.5 AS y, CAST(e.user_id % 10 AS DOUBLE) AS z FROM {events} e"
    ),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapted table in Spark."""
    text = CTES[name].replace("{e}", "embedding[").replace('"order"', "`order`")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def duck(*names: str) -> str:
    """WITH clause of the adapted tables for DuckDB (arrays start at 1 there)."""
    out = []
    for n in names:
        text = CTES[n]
        for k in (2, 1, 0):
            text = text.replace(f"{{e}}{k}]", f"embedding[{k + 1}]")
        for t in TABLES:
            text = text.replace(f"{{{t}}}", t)
        out.append(f"{n} AS ({text})")
    return "WITH " + ", ".join(out) + " "


def orders_structure(spark: SparkSession, sf_dir: str) -> Structure:
    return Structure(atoms=table(spark, sf_dir, "atoms"), residues=table(spark, sf_dir, "residues"), chains=table(spark, sf_dir, "chains"))


def points_structure(spark: SparkSession, sf_dir: str) -> Structure:
    return Structure(
        atoms=table(spark, sf_dir, "points"), residues=table(spark, sf_dir, "presidues"), chains=table(spark, sf_dir, "pchains"), bonds=table(spark, sf_dir, "pbonds")
    )
