"""Components of whole tables against union-find."""

from spindle.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_of_all_lineitem(spark):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    got = QUERIES["components_all"](spark, DATA).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == union_find((p, s + 10_000_000) for p, s in rows)


def test_components_of_some_lineitem(spark, tmp_path):
    """Several components, with all edges of a table."""
    edges = [(k, k // 7) for k in range(1, 300)]
    spark.createDataFrame(edges, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["node"]: r["component"] for r in QUERIES["components_all"](spark, str(tmp_path)).collect()}
    assert got == union_find((p, s + 10_000_000) for p, s in edges) and len(set(got.values())) == 43
