"""What round 3's findings named, each on a small input that went wrong before."""

import duckdb
import pandas as pd
import pytest

from spindle.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def copied(folder, change: dict) -> str:
    """A folder with the smallest tables, some of them given as SELECTs over themselves."""
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        duckdb.sql(f"COPY (SELECT * FROM ({change.get(t, 'SELECT * FROM t')})) TO '{folder}/{t}.parquet' (FORMAT parquet)".replace("FROM t", f"FROM '{DATA}/{t}.parquet'"))
    return str(folder)


def agrees(spark, name: str, folder: str) -> pd.DataFrame:
    """The query's rows, which are those of its SQL."""
    got = QUERIES[name](spark, folder).toPandas()
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    pd.testing.assert_frame_equal(got[cols].sort_values(cols, ignore_index=True), want[cols].sort_values(cols, ignore_index=True), check_dtype=False, check_exact=True)
    return got


def test_f4_rounding_of_values_half_way(spark, tmp_path):
    """41 / 640 = 0.0640625: the SQL's round gives 0.064062, a round by decimal digits 0.064063."""
    folder = copied(tmp_path, {
        "orders": "SELECT * REPLACE (i AS o_orderkey, 1 AS o_custkey) FROM (SELECT * FROM t LIMIT 1), range(642) r(i)",
        "lineitem": "SELECT * REPLACE (i AS l_orderkey, 41 AS l_quantity) FROM (SELECT * FROM t LIMIT 1), range(642) r(i)",
    })
    assert 0.064062 in set(agrees(spark, "expr_math", folder)["d"])


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    """Points so many that their guides have more than a million contacts."""
    return copied(tmp_path_factory.mktemp("crowd"), {
        "embeddings": "SELECT * REPLACE (i AS vec_id, list_transform(embedding, lambda v: CAST(v * (0.02 + i / 4e5) AS FLOAT)) AS embedding) FROM (SELECT * FROM t ORDER BY vec_id LIMIT 1), range(16000) r(i)",
    })


def test_f3_springs_beyond_a_million(spark, crowd):
    assert len(agrees(spark, "springs", crowd)) > 1_000_000


def test_f2_spring_rows_beyond_a_million(spark, crowd):
    assert agrees(spark, "spring_rows", crowd)["first"].max() > 2_000_000


def test_pairs_of_crowded_cells(spark):
    """Cells of several lots, and cells side by side, give each pair once."""
    from spindle.operators import spatial

    rows = pd.DataFrame({"atom": range(4_000), "x": [(i % 211) / 70 for i in range(4_000)], "y": [(i % 13) / 9 - 0.7 for i in range(4_000)], "z": [i % 2 * 1.5 for i in range(4_000)]})
    got = spatial.self_pairs(spark.createDataFrame(rows), 1.0).select("l_atom", "r_atom").toPandas()
    d = sum((rows[c].to_numpy()[:, None] - rows[c].to_numpy()) ** 2 for c in "xyz")
    want = {(i, j) for i, j in zip(*(d <= 1).nonzero()) if i < j}
    assert len(got) == len(want) and set(got.itertuples(index=False, name=None)) == want


def test_f6_f8_f9_sulfurs_of_crowded_places(spark):
    """300,000 sulfurs on a few places: as pairs they would be billions; those found are the ones that all pairs find."""
    from spindle.operators import templates

    many = spark.range(300_000).selectExpr("id div 2 AS residue", "'' AS altloc", "1 AS model", "id % 3 * 2.0D AS x", "0.0D AS y", "0.0D AS z")
    assert templates.near_sulfurs(many).distinct().count() == 150_000
    rows = [(i // 2 % 40, "ABC"[i % 3] if i % 4 else "", i % 2, 2.0 * (i * i % 61), 4.0 * (i % 7), 0.0) for i in range(90)]
    got = {r["residue"] for r in templates.near_sulfurs(spark.createDataFrame(rows, "residue long, altloc string, model int, x double, y double, z double")).collect()}
    want = {p[0] for p in rows for q in rows if p[0] != q[0] and p[2] == q[2] and (p[1] in ("", q[1]) or not q[1]) and (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 < 6.25}
    assert got == want and 0 < len(got) < 40
