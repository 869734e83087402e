import sqlite3

import pytest

from stratamem.functions.text import porter
from stratamem.operators import retrieval as R

TEXTS = ["merging archery archers at dawn", "the archer merged two branches", "café Archers merges", "", "nothing here", "dawn dawn dawn of merging merging", "well-known archer, well known dawn", None]


def _chunks(spark):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS)], "id string, text string")


@pytest.mark.parametrize("query", ["archer", "merging dawn", "cafe", "of", "well-known dawn", "dawn"])
def test_bm25_equals_fts5(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i + 1, t or "") for i, t in enumerate(TEXTS)])
    parts = [f'("{w}" OR "{w}" *)' if w.isalnum() and len(w) >= 3 else f'"{w}"' for w in query.split()]
    want = {f"d{i - 1}": s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" AND ".join(parts),))}
    got = {r["id"]: r["score"] for r in R.bm25(_chunks(spark), query).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_stems_equal_fts5():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing failing filing happy sky relational conditional rational valency digitizer conformably radically differently vilely analogously vietnamization predication operator feudalism decisiveness hopefulness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate angular homologous effective bowdlerize probate rate cease controlling rolling".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    want = dict(db.execute("SELECT doc, term FROM v"))
    assert {i: porter(w) for i, w in enumerate(words)} == want


def test_query_without_words_matches_nothing(spark):
    assert R.bm25(_chunks(spark), "!!! dawn").count() == 0
    assert R.bm25(_chunks(spark), "  ").count() == 0
    assert R.bm25(_chunks(spark).limit(0), "dawn").count() == 0


def _arm(spark, ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")


def test_fusion(spark):
    order = lambda df: [r["id"] for r in sorted(df.collect(), key=lambda r: (-r["score"], r["id"]))]
    a, b = _arm(spark, "abc"), _arm(spark, "bda")
    assert order(R.fuse([R.Arm("x", a), R.Arm("y", b)]))[0] == "b"
    boosts = spark.createDataFrame([("a", 3.0)], "id string, boost double")
    assert order(R.fuse([R.Arm("x", a), R.Arm("y", b, 2.0)], item_boosts=boosts))[0] == "a"
    one = R.fuse([R.Arm("x", a), R.Arm("y", b)]).where("id = 'a'").first()
    assert one["score"] == pytest.approx(1 / 61 + 1 / 63)
    assert [(c["arm"], c["rank"]) for c in one["contributions"]] == [("x", 1), ("y", 3)]


def test_nearest_skips_other_lengths_and_zeros(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", None), ("f", [2.0, 0.0])], "id string, vector array<float>")
    assert [(r["id"], round(r["distance"], 6)) for r in R.nearest(v, [1.0, 0.0], 5, "id").collect()] == [("a", 0.0), ("f", 0.0), ("b", 1.0)]
    assert R.nearest(v, [1.0, 0.0], 5, "id", max_distance=0.5).count() == 2


def test_hybrid_filters_after_fusion(spark):
    chunks = spark.createDataFrame([("1", "m1", "dawn raid", ["x"]), ("2", "m2", "dawn dawn", ["y"]), ("3", "m3", "dusk", ["x"])], "id string, memory_id string, text string, kinds array<string>")
    found = lambda **o: [r["id"] for r in R.hybrid_search(chunks, None, text="dawn", **o).collect()]
    assert found() == ["2", "1"] and found(labels=(["x"], [])) == ["1"] and found(top_k=0) == [] and found(weights=(0.0, 1.0)) == []
    scope = spark.createDataFrame([("m1",), ("m1",)], "memory_id string")
    assert found(scope=scope) == ["1"] and found(scope=scope.limit(0)) == []


def test_expand_keeps_best_chunk_inside_the_subtree(spark):
    hits = spark.createDataFrame([("h", "m", "a")], "id string, memory_id string, namespace string")
    near = spark.createDataFrame([("m", "n1"), ("m", "n2"), ("m", "n3"), ("m", "n1")], "memory_id string, neighbour_id string")
    scored = spark.createDataFrame([("c1", "n1", "a/b", 1.0), ("c2", "n1", "a", 2.0), ("c3", "n2", "ab", 9.0)], "id string, memory_id string, namespace string, score double")
    got = R.expand(hits, near, scored).collect()
    assert [(r["neighbour_id"], r["id"], r["rank"]) for r in got] == [("n1", "c2", 1)]
    assert R.expand(hits, near, scored, cap=0).count() == 0


def test_methods():
    assert R.resolve_method() == "ann" and R.resolve_method(available=("knn",)) == "knn" and R.resolve_method("ann", ("knn",)) is None and R.resolve_method("knn") == "knn"


def test_search_with_neighbours_and_bounds(spark):
    """Neighbours are ranked among themselves by both arms; each counts once; those without a match or outside the namespace vanish."""
    rows = [("1", "m1", "a", "dawn raid", 1.0, [1.0, 0.0]), ("2", "m2", "a/b", "dawn dawn dawn", 2.0, [0.0, 1.0]), ("3", "m2", "a/b", "dawn of it all and more", 2.0, [0.9, 0.1]), ("4", "m3", "a", "dusk", 3.0, [0.0, 0.0]), ("5", "m4", "b", "dawn dawn", 4.0, [1.0, 0.1])]
    chunks = spark.createDataFrame([(i, m, ns, t, ts, ["x"]) for i, m, ns, t, ts, _ in rows], "id string, memory_id string, namespace string, text string, _ts_created double, kinds array<string>")
    vectors = spark.createDataFrame([(i, m, ns, ts, v) for i, m, ns, _, ts, v in rows], "id string, memory_id string, namespace string, _ts_created double, vector array<float>")
    near = spark.createDataFrame([("m1", n) for n in ("m2", "m3", "m4", "m2")], "memory_id string, neighbour_id string")
    ask = dict(text="dawn", vector=[1.0, 0.0])
    hit = next(r for r in R.hybrid_search(chunks, vectors, neighbours=near, **ask).collect() if r["id"] == "1")
    assert [(n["rank"], n["memory_id"], n["id"]) for n in hit["neighbours"]] == [(1, "m2", "2")]  # 1/61 + 1/62 for both of its chunks
    assert hit["neighbours"][0]["score"] == pytest.approx(1 / 61 + 1 / 62)
    assert all(r["neighbours"] == [] for r in R.hybrid_search(chunks, vectors, neighbours=near, max_neighbours=0, **ask).collect())
    ids = lambda **o: {r["id"] for r in R.hybrid_search(chunks, vectors, **ask, **o).collect()}
    assert ids(memory_ids=["m2"]) == {"2", "3"} and ids(memory_ids=[]) == set() and ids(where=R.F.col("_ts_created") <= 1) == {"1"}
    assert ids(method="lsh", weights=(0.0, 1.0)) == set() and ids(method="ann") >= {"1", "5"}
