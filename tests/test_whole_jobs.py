"""Queries do the whole job on tables made for it."""

import datetime

import numpy as np

from stratamem.operators import dedup as D
from stratamem.operators import links as L
from stratamem.operators import retrieval as R
from stratamem.plans import graphs as PG
from stratamem.plans import retrieval as PR


def _documents(spark, at, rows):
    """rows: doc_id, text, created_at."""
    spark.createDataFrame([(i, t, "en", "web", "support", f"m{i}", ts) for i, t, ts in rows],
                          "doc_id long, text string, lang string, source string, namespace string, memory_key string, created_at timestamp").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_as_of_bounds_rows_before_they_are_ranked(spark, tmp_path):
    """60 rows after the window, which both arms rank first, take no place of the 12 within it."""
    day = lambda y, n: datetime.datetime(y, 1, 1) + datetime.timedelta(days=n)
    d = _documents(spark, tmp_path, [(8 * i + 7, "budget warehouse", day(2026, 10 + i)) for i in range(60)] + [(i, "budget warehouse of the year and more words", day(2025, i - 990)) for i in range(1000, 1012)]
                   + [(i, "nothing of this kind", day(2024, i - 2000)) for i in range(2000, 2150)])
    spark.createDataFrame([(k, [float(k == i) for i in range(8)], 0) for k in range(8)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    ids = [f"doc-{i}" for i in range(1000, 1012)]
    near = sorted(ids, key=lambda x: (int(x[4:]) % 8 != 7, x))
    scores = {x: round(1 / (61 + ids.index(x)) + 1 / (61 + near.index(x)), 6) for x in ids}
    assert {r["id"]: r["score"] for r in PR.hybrid_asof(spark, d).collect()} == dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10])


def test_clusters_are_those_of_all_items(spark):
    """60,000 items, more than were ever sampled: the same clusters as of k-means over the whole array."""
    x = np.random.default_rng(3).normal(size=(60_000, 3)).round(4)
    items = spark.createDataFrame([(f"{i:06d}", v) for i, v in enumerate(x.tolist())], "id string, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ D.centroids(unit, 5).T).argmax(1)
    got = {r["id"]: r["cluster"] for r in D.assign(items, 5).select("id", "cluster").collect()}
    assert [got[f"{i:06d}"] for i in range(len(x))] == want.tolist()


def test_duplicates_of_every_length_of_vector(spark, tmp_path):
    """Equal vectors of 768 and of 512 components are duplicates if the texts overlap; m5 links both lengths."""
    rng = np.random.default_rng(5)
    a, b, c = (rng.normal(size=n).tolist() for n in (768, 512, 768))
    texts = ["the hot coffee", "hot coffee here", "hot coffee", "one quantum", "two others", "hot coffee cup"]
    d = _documents(spark, tmp_path, [(i, t, datetime.datetime(2025, 1, 1 + i)) for i, t in enumerate(texts)])
    vectors = [("m0", a), ("m1", a), ("m2", b), ("m3", c), ("m4", c), ("m5", a), ("m5", b)]
    spark.createDataFrame([(m, f"s{i}", v) for i, (m, v) in enumerate(vectors)], "memory_id string, source_map_id string, vector array<float>").write.parquet(f"{d}/vector_features.parquet")
    spark.createDataFrame([(f"m{i}", "support", f"m{i}", float(i)) for i in range(6)], "_id string, namespace string, key string, _ts_created double").write.parquet(f"{d}/memory_rows.parquet")
    got = {(r["id"], r["component"], r["keep"], r["n"]) for r in PG.semantic_dedup(spark, d).collect()}
    assert got == {(f"m{i}", "m0", i == 5, 4) for i in (0, 1, 2, 5)}


def test_nearest_of_every_query(spark, monkeypatch):
    """A table of queries gives what each query gives alone, also over many blocks; the hashing finds nine in ten of it."""
    monkeypatch.setattr(R, "ROW_BLOCK", 50)
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(300)] + [(300, [0.0] * 8), (301, None)]
    v = spark.createDataFrame(rows, "id int, vector array<float>")
    asked = v.where("id % 100 = 0").selectExpr("id AS query_id", "vector")
    got = {(r["query_id"], r["id"], round(r["distance"], 6)) for r in R.nearest_each(v, asked, 4, "id", max_distance=0.9).collect()}
    assert got == {(q, r["id"], round(r["distance"], 6)) for q in (0, 100, 200) for r in R.nearest(v, list(v.where(f"id = {q}").first()["vector"]), 4, "id", max_distance=0.9).collect()}


def test_hashing_finds_nine_in_ten_for_the_query_set(spark):
    e = PR.V.embeddings(spark, "/root/testdata/sf0.001")
    pairs = [{(r["query_id"], r["id"]) for r in f(e, PR._queries(e), 10, "id").collect()} for f in (R.nearest_each, L.approximate_nearest_each)]
    assert len(pairs[0]) == 50 and len(pairs[0] & pairs[1]) >= 45
