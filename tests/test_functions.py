import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamem.functions import ids as I
from stratamem.functions import text as T
from stratamem.functions import vectors as V


def test_hashes(spark):
    df = spark.createDataFrame([("ns", "key", "{}", "0" * 64, "téxt")], "a string, b string, e string, p string, t string")
    leaf = hashlib.sha256(b"STRATAMEM_EVENT_LEAF_v1\0{}").digest()
    body = b'STRATAMEM_SOURCE_BODY_v1\0{"text_present":true,"text_sha256":"%s","vector_dim":undefined,"vector_present":false,"vector_sha256":undefined}' % hashlib.sha256("téxt".encode()).hexdigest().encode()
    got = df.select(I.stable_id("mem", "a", "b"), I.chain_root("p", I.event_leaf("e")), I.body_hash("t"), I.database_id("a", F.lit("ü/?")), I.qualified("a", "b")).first()
    assert got[0] == "mem_" + hashlib.sha256(b"mem\0ns\0key").hexdigest()[:24]
    assert got[1] == hashlib.sha256(bytes(32) + leaf).hexdigest() and got[2] == hashlib.sha256(body).hexdigest()
    import base64
    import json

    assert json.loads(base64.urlsafe_b64decode(got[3] + "==")) == ["ns", "ü/?"] and got[4] == "ns::key"


def test_text(spark):
    df = spark.createDataFrame([("A b c", "c d"), ("", ""), ("", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(T.jaccard("a", "b")).collect()] == [0.25, 1.0, 0.0, 1.0]
    assert [r[0] for r in df.select(T.preview("a", 4)).collect()] == ["A b…", "", "", None]
    para = spark.createDataFrame([("one\r\n\r\n  two  \n \n\nabcdefgh",), (" \n ",), ("",), (None,)], "t string")
    assert [r[0] for r in para.select(T.paragraph_chunks("t", 5)).collect()] == [["one", "two", "abcde", "fgh"], [], [], None]
    props = ['{"b_c": {"x": 1, "y": null, "z": {"w": "{}"}}, "a": ["p", 2.5, [true, {"q": 1}]]}', "[1]", None, "{}", "{oops", '{"a": {}}', '{"a": 1}']
    given = spark.createDataFrame([(i, p) for i, p in enumerate(props)], "i int, p string").orderBy("i")
    assert [r[0] for r in given.select(T.props_text(F.lit("k"), "p")).collect()] == ["Kind: k\na: p, 2.5, true\nb c.x: 1\nb c.z.w: {}", "", "", "", "", "", "Kind: k\na: 1"]
    own = lambda kind, p: F.concat(kind, F.lit(" "), F.get_json_object(p, "$.a"))
    assert [r[0] for r in given.where("i >= 3").select(T.props_text(F.lit("k"), "p", own)).collect()] == ["", "", "k {}", "k 1"]
    assert df.limit(1).select(T.share_of_query("b Z b", F.col("a"))).first()[0] == 0.5


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), (None, None)], "a array<float>, b array<float>")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(V.cosine_distance("a", "b")).collect()] == [0.0, None, 1.0, None]
    assert [r[0] for r in df.select(V.l2_normalised("a")).collect()] == [[0.6, 0.8], [0.0, 0.0], [1.0, 0.0], None]
    pool = spark.createDataFrame([("m", [1.0, 1.0]), ("m", [3.0, 3.0]), ("m", [9.0, 9.0, 9.0]), ("x", None), ("y", [])], "k string, v array<float>")
    assert [(r["k"], r["n"], r["mean"]) for r in V.mean_pool(pool, "k", "v").collect()] == [("m", 2, [2.0, 2.0])]


def test_sketch(spark):
    df = spark.createDataFrame([("person", '{"a": 1}', '{"b": "x"}'), (None, None, None)], "kind string, lp string, props string")
    features = F.concat(V.label_features(F.col("kind"), F.col("lp")), V.property_features(F.lit("prop:"), F.col("props")))
    (names, s), (none, empty) = df.select(features, V.sketch(features)).collect()
    assert names == ["label:person", "labelProp:person:a=1", 'prop:b="x"'] and none == []
    assert len(s) == 32 and np.linalg.norm(s) == pytest.approx(1) and empty == [0.0] * 32

    def fnv(text):
        h = 2166136261
        for unit in np.frombuffer(text.encode("utf-16-le"), np.uint16).tolist():
            h = (h ^ unit) * 16777619 % 2**32
        return h

    assert fnv("a") == 0xE40C292C
    words = ["", "a", "äß", "😀 x"]
    assert [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(V.fnv1a(F.col("w"))).collect()] == [fnv(w) for w in words]
    want = np.zeros(32)
    for name in names:
        a, b = fnv(name), fnv(name + "\0#")
        want[a % 32] += 1 - a % 2 * 2
        want[b % 32] += (b % 32 != a % 32) * (1 - b % 2 * 2) / 2
    assert np.allclose(s, want / np.linalg.norm(want))


def test_codec_and_quota(spark):
    from stratamem.functions.paths import over_quota

    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(V.decode_vector(V.encode_vector("v"))).collect()] == [[1.5, -2.0], None]
    have, new = spark.createDataFrame([("a",)], "namespace string"), spark.createDataFrame([("a",), ("b",), ("c",)], "namespace string")
    assert [r[0] for r in over_quota(have, new, 2).collect()] == ["c"] and over_quota(have, new, 9).count() == 0


def test_kept_tables_are_released(spark):
    from stratamem.sources.tables import SharedFiles, keep, release, shared_path

    path = shared_path(spark, "x")
    spark.range(3).withColumn("b", F.col("id") % 2).write.partitionBy("b").parquet(path)
    files = SharedFiles(path)
    assert sorted(files.read("b=0", ["id"])["id"].to_pylist()) == [0, 2] and files.read("b=7", ["id"]) is None
    assert keep(spark.range(3), "y").count() == 3
    release(spark)
    assert files.read("b=0", ["id"]) is None
