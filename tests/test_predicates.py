import pytest
from pyspark.sql import functions as F

from stratamem.functions.paths import canonical, lineage, path_error, renamed, under
from stratamem.operators import namespaces as N
from stratamem.operators import predicates as P


def test_paths(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("a/b/c/d/e/f",), ("a/b/c/d/e/f/g",), ("/a",), ("a//b",), ("A",), ("",), (None,)], "p string")
    got = {r["p"]: (r["e"], r["u"]) for r in df.select("p", path_error("p").alias("e"), under("p", "a").alias("u")).collect()}
    assert got["a"] == (None, True) and got["a/b"] == (None, True) and got["ab"] == (None, False) and got["a/b/c/d/e/f"][0] is None
    assert [got[p][0] for p in ("a/b/c/d/e/f/g", "/a", "a//b", "A", "", None)] == ["max_depth", "invalid", "invalid", "invalid", "empty", "empty"]
    assert canonical(["a/b", "c", "a", "a/b/c", "ab"]) == ["a", "ab", "c"]
    assert df.where("p = 'a/b'").select(lineage("p")).first()[0] == ["a", "a/b"]
    assert {r[0] for r in df.where("p IN ('a', 'a/b', 'ab')").select(renamed("p", "a", "x/y")).collect()} == {"x/y", "x/y/b", "ab"}


def test_scopes(spark):
    edges = spark.createDataFrame([("r", "x"), ("x", "y"), ("y", "z"), ("y", "x")], "parent string, child string")
    closure = P.scope_closure(edges)
    pairs = {tuple(r) for r in closure.collect()}
    assert pairs == {(a, b) for a in "rxyz" for b in {"r": "rxyz", "x": "xyz", "y": "xyz", "z": "z"}[a]}
    assert P.closes_cycle(closure, "z", "r") and P.closes_cycle(closure, "q", "q") and not P.closes_cycle(closure, "r", "z")
    m = spark.createDataFrame([("1",), ("2",)], "memory_id string")
    at = spark.createDataFrame([("1", "z"), ("1", "y"), ("2", "q")], "memory_id string, scope_id string")
    assert [r[0] for r in P.scope_dag(m, at, closure, ["x"]).collect()] == ["1"]
    assert P.exact_scope(m, at, ["x"]).count() == 0 and P.exact_scope(m, at, []).count() == 0


def test_as_of(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "_ts_created double")
    assert df.where(P.as_of(gt=1.0, lte=2.0)).count() == 1 and df.where(P.as_of(lte=0.0)).count() == 0
    for bad in ({}, {"gt": float("nan")}, {"gt": 3.0, "lt": 2.0}):
        with pytest.raises(ValueError):
            P.as_of(**bad)
    with pytest.raises(ValueError):
        P.namespaces_of("a", [str(i) for i in range(40)])


def test_visibility(spark):
    m = spark.createDataFrame([("1", "a", False, None), ("2", "a/b", None, None), ("3", "ab", False, None), ("4", "c", True, None), ("5", "d", False, "e1"), ("6", "d", False, "e2")], "memory_id string, namespace string, suppressed boolean, edge_id string")
    meta = spark.createDataFrame([("a", True), ("d", False)], "namespace string, suppressed boolean")
    edges = spark.createDataFrame([("e1", "3", "4"), ("e2", "3", "3")], "edge_id string, from_id string, to_id string")
    assert {r["memory_id"] for r in P.visible(m, meta).collect()} == {"3", "5", "6"}
    assert {r["memory_id"] for r in P.visible(m, meta, edges).collect()} == {"3", "6"}
    assert {r["memory_id"] for r in P.visible(m, meta.limit(0)).collect()} == {"1", "2", "3", "5", "6"}
    deep = spark.createDataFrame([("a/b/c",)], "namespace string")
    flags = spark.createDataFrame([("a", True), ("a/b", True)], "namespace string, suppressed boolean")
    assert P.hidden_namespaces(deep, flags).first()["by"] == "a/b"


def test_labels(spark):
    df = spark.createDataFrame([(["x", "y"],), ([],)], "kinds array<string>")
    n = lambda *a: df.where(P.has_labels("kinds", *a)).count()
    assert (n(["x", "y"], []), n(["z"], []), n([], ["z", "y"]), n([], []), n(None, None)) == (1, 0, 1, 2, 2)


def test_namespace_rank(spark):
    hits = spark.createDataFrame([("dense", "k1", 0.4), ("dense", "k2", 0.4), ("dense", "k3", 0.4), ("spike", "k", 0.95), ("m", "b", 0.1), ("m", "a", 0.1)], "namespace string, memory_key string, score double")
    rows = N.rank(hits, top_hits=1).collect()
    assert [r["namespace"] for r in rows] == ["dense", "spike", "m"] and rows[2]["top_hits"] == ["a"]
    meta = spark.createDataFrame([("spike", "Primary Inbox", "")], "namespace string, alias string, description string")
    assert N.rank(hits, meta, "inbox", boost=9.0).first()["namespace"] == "spike"
    assert N.rank(hits, limit=0).count() == 1 and N.rank(hits.limit(0)).count() == 0
    names = N.catalog(hits.select("namespace").union(spark.createDataFrame([("spike/x",)], "namespace string")), meta.withColumn("suppressed", F.lit(True)))
    assert {r["namespace"] for r in N.under_prefix(names, "spike").collect()} == set()
    assert {r["namespace"] for r in N.under_prefix(names, "spike", True).collect()} == {"spike", "spike/x"}
    assert [tuple(r) for r in N.by_metadata(names, "inbox zero").collect()] == [("spike", 0.5)]
