import pytest
from pyspark.sql import functions as F

from stratamem.functions.paths import lineage
from stratamem.operators import graph as G

NODES = [("a", "n", "ka", False), ("b", "n", "kb", False), ("c", "m", "kc", True), ("d", "m/x", "kd", None)]
EDGES = [("e1", "a", "b"), ("e2", "a", "c"), ("e3", "b", "b"), ("e4", "d", "a"), ("e5", "a", "gone")]


@pytest.fixture(scope="module")
def graph(spark):
    return (spark.createDataFrame(NODES, "memory_id string, namespace string, key string, suppressed boolean"), spark.createDataFrame(EDGES, "edge_id string, from_id string, to_id string"),
            spark.createDataFrame([("a", "person"), ("a", "fact"), ("b", "person")], "memory_id string, kind string"), spark.createDataFrame([("e1", "knows"), ("e1", "likes"), ("e4", "knows")], "edge_id string, kind string"))


def test_edges_need_both_visible_ends(graph):
    nodes, edges, _, el = graph
    got = {r["edge_id"]: r["kinds"] for r in G.edges_of(edges, nodes, el).collect()}
    assert got == {"e1": ["knows", "likes"], "e3": [], "e4": ["knows"]}
    assert {r["edge_id"] for r in G.edges_of(edges, nodes, el, F.col("namespace") == "m/x").collect()} == {"e4"}


def test_neighbours_and_constraints(graph):
    nodes, edges, nl, el = graph
    pairs = G.neighbours(edges)
    assert {(r["memory_id"], r["neighbour_id"], r["direction"]) for r in pairs.where("edge_id IN ('e1', 'e3')").collect()} == {("a", "b", "out"), ("b", "a", "in"), ("b", "b", "out")}
    got = G.constrained(pairs, nodes, el, nl, edge_kind="knows", direction="out", all_=["person"]).collect()
    assert {(r["memory_id"], r["neighbour_id"]) for r in got} == {("a", "b"), ("d", "a")}
    assert G.constrained(pairs, nodes, el, nl, some=[]).where("neighbour_id = 'c'").count() == 0
    assert G.capped(pairs, 1).groupBy("memory_id").count().where("count > 1").count() == 0


def test_stats_and_roll_up(graph, spark):
    nodes, edges, _, _ = graph
    s = {r["namespace"]: tuple(r)[1:] for r in G.stats(nodes, edges).collect()}
    assert s == {"n": (2, 0, 4, 1), "m": (0, 1, 0, 1), "m/x": (1, 0, 1, 0)}
    up = {r["namespace"]: r["nodes"] for r in G.roll_up(G.stats(nodes, edges), lineage("namespace")).collect()}
    assert up == {"n": 2, "m": 1, "m/x": 1}
    hidden = spark.createDataFrame([("n",)], "namespace string")
    assert G.stats(nodes, edges, hidden).where("namespace = 'n'").first()["suppressed_nodes"] == 2


def test_centrality_counts_a_loop_once(graph):
    nodes, edges, _, _ = graph
    got = {r["memory_id"]: (r["degree"], r["centrality"]) for r in G.centrality(edges, nodes).collect()}
    assert got == {"a": (4, 1.0), "b": (2, 0.5), "c": (1, 0.25), "d": (1, 0.25)}
    assert G.centrality(edges.limit(0), nodes).agg(F.max("centrality")).first()[0] == 0


def test_meta_text_and_histogram(graph):
    nodes, edges, nl, el = graph
    t = {r["memory_id"]: r["text"] for r in G.meta_text(edges, nodes, nl, el).collect()}
    assert t["a"] == "edge in:kd:knows\nedge out:kb:knows|likes\nnode:fact\nnode:person"
    assert {r["kind"]: r["n"] for r in G.histogram(nl.union(nl), "memory_id").collect()} == {"person": 2, "fact": 1}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 30)] + [(40, 41), (41, 42), (50, 50)] + [(100, k) for k in range(101, 140)]
    got = {r["id"]: r["component"] for r in G.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert {got[i] for i in range(31)} == {0} and got[42] == 40 and got[50] == 50 and {got[k] for k in range(100, 140)} == {100}
    assert G.components(spark.createDataFrame([], "a int, b int")).count() == 0
