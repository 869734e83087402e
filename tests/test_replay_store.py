import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamem import ontology as O
from stratamem.client import Memos
from stratamem.operators import dedup as D
from stratamem.operators import links as L
from stratamem.operators import references as REF
from stratamem.operators import replay as R
from stratamem.schema import TABLES
from stratamem.sources import files as FS
from stratamem.sources import store as S
from stratamem.streaming import state as ST

OUT = TABLES["memory_tip_outbox"]


def _outbox(spark, rows):
    return spark.createDataFrame([(f"r{i}" if r[0] is None else r[0], *r[1:7], r[7], f"o{i}", float(r[8])) for i, r in enumerate(rows)], OUT)


ROWS = [("a1", "content", "MERGE_MEMORY", "n", "k", "s", None, "P1", 1), ("a2", "content", "MERGE_MEMORY", "n", "k", "s", None, "P2", 3), ("a3", "content", "DELETE_MEMORY", "n", "k", None, None, None, 2),
        ("a4", "content", "MERGE_MEMORY", "n", "q", "s", None, "", 1), ("a5", "content", "DELETE_MEMORY", "n", "q", None, None, None, 5), ("a6", "graph", "MERGE_MEMORY", "n", "k", None, "e", None, 1)]


def test_replay_at_points(spark):
    o = _outbox(spark, ROWS)
    live = lambda until=None: {(r["memory_key"], r["source_key"], r["payload"]) for r in R.state(R.changes_at(o, "content", until), "content").collect()}
    assert live() == {("k", "s", "p2")} and live(1.0) == {("k", "s", "p1"), ("q", "s", None)} and live(2.0) == {("q", "s", None)} and live(0.0) == set()
    assert R.state(R.changes_at(o, "graph"), "graph").count() == 1
    blobs = spark.createDataFrame([("0xP2", b"x", "hot", None, "b", 1.0)], TABLES["memory_tip_blobs"])
    assert R.with_blobs(R.state(R.changes_at(o, "content"), "content"), blobs).first()["location"] == "hot"


def test_chain(spark):
    events = ['{"a":1}', '{"b":2}', '{"c":3}']
    chain = R.append("0" * 64, events)
    rows = [(p, "0x" + r.upper(), "E", e, None, f"i{k}", float(k)) for k, ((p, r), e) in enumerate(zip(chain, events))]
    log = R.log(spark.createDataFrame([*rows, rows[0], ("ff" * 32, "ee" * 32, "E", "{}", None, "i9", 9.0)], TABLES["memory_provenance"]))
    assert {r["root"]: (r["links"], r["hashes"]) for r in R.verify_chain(log).collect()} == {**{r: (True, True) for _, r in chain}, "ee" * 32: (False, False)}
    assert R.head(log).first()["root"] == "ee" * 32 and R.head(log.limit(0)).count() == 0
    assert [r["root"] for r in R.chain_page(log, before_root=chain[2][1]).collect()] == [chain[1][1], chain[0][1]]
    assert R.chain_page(log, before_root="unknown").count() == 0 and R.chain_page(log, limit=0).count() == 1


def test_evacuation(spark):
    import hashlib

    sha = hashlib.sha256(b"x").hexdigest()
    blobs = spark.createDataFrame([(sha, bytearray(b"x"), "hot", None, "b1", 1.0), ("bad", bytearray(b"y"), "hot", None, "b2", 1.0), ("p2", bytearray(b"z"), "hot", None, "b3", 1.0)], TABLES["memory_tip_blobs"])
    log = R.log(spark.createDataFrame([("", "a1", "E", "{}", None, "i1", 1.0), ("a1", "a2", "E", "{}", None, "i2", 2.0)], TABLES["memory_provenance"]))
    out = R.evacuable(log, _outbox(spark, ROWS), blobs, tips=1)
    assert {r[0] for r in out.collect()} == {sha, "bad"} and R.evacuable(log, _outbox(spark, ROWS), blobs, tips=0).count() == 0
    cold = {r["content_sha256"]: (r["location"], r["payload"]) for r in R.to_cold(blobs, out, F.lit("cold://x")).collect()}
    assert cold[sha] == ("cold", None) and cold["bad"][0] == "hot" and cold["p2"][0] == "hot"
    assert R.to_cold(blobs, out, None).where("location = 'dropped'").count() == 2


def _item(ns, key, text, labels=()):
    return (ns, key, None, [(f"body", text, [1.0, 2.0])], [(k, p) for k, p in labels])


ITEM = "namespace string, key string, properties string, chunks array<struct<key: string, text: string, vector: array<float>>>, labels array<struct<kind: string, props: string>>"


def _texts(s):
    """The texts that were written as such, without the derived ones."""
    own = s.table("source_maps").where("NOT startswith(source_key, '__')").select(F.col("_id").alias("source_map_id"))
    return {r["text"] for r in s.table("text_features").join(own, "source_map_id", "left_semi").collect()}


def _derived(s):
    rows = s.table("source_maps").where("startswith(source_key, '__')").select(F.col("_id").alias("source_map_id"), "source_key").join(s.table("text_features").select("source_map_id", "memory_id", "text"), "source_map_id")
    keys = {r["_id"]: r["key"] for r in s.table("memos").collect()}
    return {(keys[r["memory_id"]], r["source_key"].split("/")[0], r["text"]) for r in rows.collect()}


def test_store_life(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/store")
    assert s.table("memos").count() == 0
    S.merge(s, spark.createDataFrame([_item("a", "x", "one", [("fact", "1"), ("fact", "2")]), _item("a/b", "y", "two")], ITEM), 10.0)
    ids = {r["key"]: r["_id"] for r in s.table("memos").collect()}
    S.link(s, spark.createDataFrame([(ids["x"], ids["y"], "knows", None)], "from_id string, to_id string, kind string, properties string"), 11.0)
    assert s.table("edges").count() == 1 and s.table("node_label_assignments").first()["props"] == "2"
    with pytest.raises(ValueError):
        S.link(s, spark.createDataFrame([(ids["x"], "none", "knows", None)], "from_id string, to_id string, kind string, properties string"), 11.0)
    with pytest.raises(ValueError):
        S.merge(s, spark.createDataFrame([_item("Bad", "x", "one")], ITEM), 10.0)
    one = spark.createDataFrame([(ids["x"],)], "memory_id string")
    S.suppress(s, one, 12.0)
    S.suppress(s, one, 13.0)
    S.merge(s, spark.createDataFrame([_item("a", "x", "three")], ITEM), 99.0)
    m = s.table("memos").where("key = 'x'").first()
    assert m["suppressed"] and m["_ts_created"] == 10.0 and s.table("edges").count() == 0 and _texts(s) == {"two", "three"}
    S.replace_feature(s, "a", "x", "body", 100.0, text="four")
    assert _texts(s) == {"two", "four"} and s.table("vector_features").count() == 2 and s.table("text_stems").count() == s.table("text_features").count()
    S.rename_namespace(s, "a", "z", now_ms=101.0)
    assert s.table("memory_provenance").orderBy(F.desc("_ts_created")).first()["event_json"] == '{"from":"a","kind":"RENAME_NAMESPACE","recursive":true,"source_keys":[],"to":"z","v":1}'
    assert {r["namespace"] for r in s.table("memos").collect()} == {"z", "z/b"}
    moved = s.table("memos")
    for t in ("source_maps", "text_features", "vector_features", "nodes", "memory_scopes"):
        assert s.table(t).join(moved.select(F.col("_id").alias("memory_id")), "memory_id", "left_anti").count() == 0
    assert s.table("text_features").join(s.table("source_maps").select(F.col("_id").alias("source_map_id")), "source_map_id", "left_anti").count() == 0
    S.upsert_metadata(s, spark.createDataFrame([("z", "Zed", "d", True)], "namespace string, display_name string, description string, suppressed boolean"))
    assert s.table("namespace_metadata").first()["display_name"] == "Zed"
    S.merge(s, spark.createDataFrame([_item("q", "x", "five")], ITEM), 5.0)
    with pytest.raises(ValueError):
        S.rename_namespace(s, "q", "z")
    S.delete(s, s.table("memos").where("key = 'x'").select(F.col("_id").alias("memory_id")), 200.0)
    assert s.table("memos").count() == 1 and _texts(s) == {"two"}
    ro = S.Store(spark, f"file://{tmp_path}/store", readonly=True)
    with pytest.raises(PermissionError):
        S.upsert_metadata(ro, s.table('namespace_metadata'))
    with pytest.raises(FileNotFoundError):
        S.Store(spark, f"file://{tmp_path}/none", readonly=True)


def test_crashes_keep_the_last_version(spark, tmp_path, monkeypatch):
    """A writer that dies at any step leaves what was there; a second writer from the same version is refused."""
    path = f"file://{tmp_path}/store"
    s = S.Store(spark, path)
    names = lambda *n: spark.createDataFrame([(x, x, "d", False) for x in n], "namespace string, display_name string, description string, suppressed boolean")
    have = lambda: {r["namespace"] for r in S.Store(spark, path).table("namespace_metadata").collect()}
    S.upsert_metadata(s, names("a"))
    for step in ("publish", "rename"):
        with monkeypatch.context() as m:
            def die(*_):
                raise OSError("gone")

            m.setattr(S.Store, "_publish", die) if step == "publish" else m.setattr(s, "_files", type("F", (), {"rename": die})())
            with pytest.raises(OSError):
                S.upsert_metadata(s, names("b"))
        assert have() == {"a"}
    one, two = s.change(), s.change()
    for c, n in ((one, "c"), (two, "d")):
        S._metadata(c, names(n))
    one.commit()
    with pytest.raises(RuntimeError):
        two.commit()
    assert have() == {"a", "c"} and s.version == 3 and s.table("namespace_metadata", 2).count() == 1
    monkeypatch.setattr(S, "COMPACT_AT", 3)
    S.upsert_metadata(s, names("a", "e"))
    assert have() == {"a", "c", "e"} and len(s.manifest()["tables"]["namespace_metadata"]) == 1
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("y")
    with pytest.raises(ValueError):
        S.Store(spark, f"file://{tmp_path}/other")


def test_edges_as_memos_and_derived_chunks(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/store")
    S.merge(s, spark.createDataFrame([_item("a", "x", "one", [("person", '{"full_name": "Ada"}')]), _item("a", "y", "two")], ITEM), 10.0)
    ids = {r["key"]: r["_id"] for r in s.table("memos").collect()}
    edge = "namespace string, key string, chunks array<struct<key: string, text: string, vector: array<float>>>, from_id string, to_id string, kind string, props string, properties string"
    S.merge_edges(s, spark.createDataFrame([("a", "e", [("body", "they met", None)], ids["x"], ids["y"], "knows", '{"since": 1843}', None)], edge), 11.0)
    meta, node, of = "__mem_search_meta__", "__mem_nl_props__", "__mem_edge_props__"
    assert _derived(s) == {("x", meta, "edge out:y:knows\nnode:person"), ("y", meta, "edge in:x:knows"), ("x", node, "Kind: person\nfull name: Ada"), ("e", of, "Kind: knows\nsince: 1843")}
    m = Memos(s)
    assert [r["key"] for r in m.search(text="ada").collect()] == ["x"] and m.find("a", "e").first()["edge_id"] == m.edges().first()["edge_id"]
    hit = m.search(text="met one two", neighbours=True).collect()
    assert hit == [] and [n["memory_id"] for r in m.search(text="they", neighbours=True).collect() for n in r["neighbours"]] == []
    assert {n["memory_id"] for r in m.search(vector=[1.0, 2.0], text="they met", neighbours=True).where("key = 'e'").collect() for n in r["neighbours"]} == {ids["x"], ids["y"]}
    assert [r["key"] for r in m.search(text="one", memory_ids=[ids["y"]]).collect()] == [] and m.standard_search(text="one", root="none").count() == 1
    assert m.source_maps(ids["x"], 1).count() == 1 and m.suppressed_keys("a").count() == 0 and m.edge(m.edges().first()["edge_id"]).first()["kinds"] == ["knows"]
    S.suppress_namespace(s, "a", 12.0)
    S.suppress_namespace(s, "a", 13.0)
    assert m.search(text="one").count() == 0 and s.table("memory_provenance").where("event_type = 'SUPPRESS_NAMESPACE'").count() == 1
    S.delete(s, spark.createDataFrame([(ids["y"],), ("none",)], "memory_id string"), 14.0)
    assert {r["key"] for r in s.table("memos").collect()} == {"x"} and _derived(s) == {("x", meta, "node:person"), ("x", node, "Kind: person\nfull name: Ada")}
    S.delete_namespace(s, "a", 15.0)
    assert all(s.table(t).count() == 0 for t in ("memos", "nodes", "edges", "source_maps", "text_features", "text_stems", "vector_features", "node_label_assignments", "edge_label_assignments", "memory_scopes", "namespace_metadata"))
    assert R.verify_chain(m.log()).where("NOT links OR NOT hashes").count() == 0
    with pytest.raises(ValueError):
        S.merge(s, spark.createDataFrame([_item("a", "x", "1"), _item("b", "x", "2")], ITEM), 16.0, quota=1)
    S.ensure_scope_chain(s, ["p", "q", "r"])
    S.ensure_scope_chain(s, ["p", "q"])
    assert s.table("scope_closure").count() == 6


def test_client_and_history(spark, tmp_path):
    s = S.Store(spark, f"file://{tmp_path}/store")
    S.merge(s, spark.createDataFrame([_item("a", "x", "merged budget", [("fact", "{}")]), _item("a/b", "y", "budget of dawn"), _item("c", "z", "dawn")], ITEM), 10.0)
    m = Memos(s)
    ids = {r["key"]: r["memory_id"] for r in m.memos().collect()}
    S.link(s, spark.createDataFrame([(ids["x"], ids["y"], "knows", '{"directed":true}')], "from_id string, to_id string, kind string, properties string"), 11.0)
    keys = lambda **o: [r["key"] for r in m.search(**o).collect()]
    assert set(keys(text="budget")) == {"x", "y"} and keys(text="budget", namespaces=["a/b"]) == ["y"] and keys(text="budget", labels=(["fact"], [])) == ["x"] and keys(text="budget", as_of={"lt": 5.0}) == []
    assert set(keys(text="budget", vector=[1.0, 2.0])) == {"x", "y", "z"} and keys(text="budget", namespaces=["a"], mode="exact") == ["x"]
    assert [r["neighbour_id"] for r in m.neighbours("a", "x", edge_kind="knows", direction="out").collect()] == [ids["y"]]
    assert m.graph().first()["kinds"] == ["knows"] and m.edges().first()["directed"] and m.texts().count() == 3
    assert m.search_namespaces("budget").first()["namespace"] in ("a", "a/b") and m.catalog().count() == 3
    first = R.head(m.log()).first()["root"]
    assert R.verify_chain(m.log()).where("NOT links OR NOT hashes").count() == 0
    S.merge(s, spark.createDataFrame([_item("a", "x", "other text")], ITEM), 20.0)
    S.delete(s, m.memos().where("key = 'z'").select("memory_id"), 30.0)
    body = lambda root=None: {(r["memory_key"], bytes(r["body"]).decode()) for r in S.payloads(s, m.state_at("content", root), f"{tmp_path}/cold").collect()}
    assert body(first) == {("x", "merged budget"), ("y", "budget of dawn"), ("z", "dawn")} and body("unknown") == set()
    assert body() == {("x", "other text"), ("y", "budget of dawn")} and m.event_at(first).count() == 1
    assert R.verify_chain(m.log()).where("NOT links OR NOT hashes").count() == 0 and m.state_at("vector").count() == 2 and m.state_at("graph").count() == 2
    S.evacuate(s, f"{tmp_path}/cold", tips=1)
    assert s.table("memory_tip_blobs").where("location = 'cold'").count() > 0 and body() == {("x", "other text"), ("y", "budget of dawn")}
    S.link_scope(s, "r", "a")
    S.link_scope(s, "a", "q")
    with pytest.raises(ValueError):
        S.link_scope(s, "q", "r")
    assert keys(text="other", namespaces=["r"], mode="dag") == ["x"]
    S.unlink_scope(s, "r", "a")
    assert keys(text="other", namespaces=["r"], mode="dag") == []
    S.replace_scopes(s, spark.createDataFrame([(ids["y"], "q")], "memory_id string, scope_id string"))
    assert keys(text="budget", namespaces=["a"], mode="dag") == ["y"]
    assert m.stats().where("namespace = 'a'").first()["nodes"] == 1


def test_ontology(spark):
    o = O.merged({"node": {"p": {"type": "object"}}}, {"node": {"p": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}})
    df = spark.createDataFrame([("p", '{"a": 1}'), ("p", '{"a": true}'), ("p", '{"b": 0}'), ("p", "{"), ("q", "{}"), ("p", '{"a": 0}')], "k string, p string")
    assert [len(r[0]) for r in df.select(O.checker(o)("k", "p")).collect()] == [0, 1, 2, 1, 1, 1]
    assert O.ontology_hash(o) == O.ontology_hash(dict(reversed(o.items())))
    links = spark.createDataFrame([(1, "user", "u", "0xAA", 1), (2, "user", "u", "bb", 2), (2, "user", "u", "bb", 2), (3, "user", " ", "aa", 9), (4, "user", "v", None, 9)], "link_id long, kind string, owner_key string, ontology_hash string, linked_at_ms long")
    onto = spark.createDataFrame([("aa", '["x","y"]', "[]"), ("bb", '["x"]', '["e"]')], "ontology_hash string, node_kinds_json string, edge_kinds_json string")
    assert O.current(links).first()["ontology_hash"] == "bb" and O.history(links).count() == 2
    assert O.databases_with(links, onto, ["x"], ["e"]).count() == 1 and O.databases_with(links, onto, ["y"]).count() == 0 and O.databases_with(links, onto).count() == 1


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    for i, part in enumerate((ROWS[:2], ROWS[2:], [])):
        _outbox(spark, part).coalesce(1).write.mode("append").parquet(src)
        s = ST.field_state(spark, f"file://{tmp_path}/state", "content")
        q = s.start(ST.outbox_stream(spark, src, OUT, 1), f"{tmp_path}/cp")
        q.awaitTermination(120)
    live = ST.live_fields(s.current(), "content")
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in R.state(R.changes_at(_outbox(spark, ROWS), "content"), "content").collect()}
    before = s.current().count()
    s.update(_outbox(spark, ROWS[:1]), 10_000)
    s.update(_outbox(spark, ROWS[:1]), 10_000)
    assert s.current().count() == before


def test_reference_stream(spark, tmp_path):
    """Targets that come, go and come again, repeats of all of them, and an insert that arrives after its own delete."""
    s = ST.reference_state(spark, f"file://{tmp_path}/refs")
    row = lambda i, ts, at: spark.createDataFrame([(i, i[0], ts, at)], "id string, key string, ts double, at double")
    ref = lambda i, ts, at, sign=1: REF.ref_deltas(row(i, ts, at), "c", "id", "key", "ts", sign, F.col("at"))
    target = lambda k, ts, at, sign=1: REF.exist_deltas(row(k, ts, at), "c", "key", "ts", None, sign, F.col("at"))
    seen = []
    for epoch, batch in enumerate((ref("k1", 5.0, 1.0).union(ref("k2", 1.0, 1.0)), target("k", 3.0, 2.0), target("k", 3.0, 2.0), target("k", 3.0, 4.0, -1), target("k", 3.0, 2.0),
                                   target("k", 9.0, 5.0), target("k", 3.0, 6.0), ref("k2", 1.0, 7.0, -1), ref("k2", 1.0, 1.0))):
        s.update(batch, epoch)
        seen.append({(r["child_id"], r["missing"]) for r in REF.orphan_rows(s.current()).collect()})
    absent, late = {("k1", "absent"), ("k2", "absent")}, {("k2", "late")}
    assert seen == [absent, late, late, absent, absent, {("k1", "late"), ("k2", "late")}, late, set(), set()]
    s.update(target("k", 3.0, 8.0, -1), 20)
    s.update(target("k", 3.0, 8.0, -1), 20)
    assert [(r["key"], r["refs"], r["exists"], r["first_exist"]) for r in REF.counts(s.current()).collect()] == [("k", 1, 1, 9.0)]


def test_dedup(spark):
    one = lambda i, v, text, at: (i, v, text, float(at), 0)
    rows = [one("a", [1.0, 0.0], "coffee is hot", 1), one("b", [0.999, 0.02], "hot coffee", 2), one("c", [0.0, 1.0], "quantum", 3), one("d", [1.0, 0.001], "other words here", 9)] + [one(f"x{i}", [0.5, 0.5], "same", 1) for i in range(50)]
    items = spark.createDataFrame(rows, "id string, vector array<float>, text string, created_at double, cluster int")
    got = {r["id"]: (r["component"], r["keep"], r["n"]) for r in D.groups(items).collect()}
    assert got["a"] == ("a", False, 2) and got["b"] == ("a", True, 2) and "c" not in got and "d" not in got
    assert got["x0"] == ("x0", True, 50) and sum(v[1] for v in got.values()) == 2
    assert D.similar_pairs(D.copies(items)[0], 0.05).count() == 3
    assert D.keep_fraction(items, D.groups(items)) == (54 - 50) / 54
    assert D.groups(items.limit(0)).count() == 0 and [D.default_k(n) for n in (1, 10, 100, 10000)] == [1, 10, 16, 100]
    assert 0 < D.calibrate(items.where("id < 'x'"), 0.7, rounds=6) <= 0.5
    c = {r["id"]: r["cluster"] for r in D.assign(items.drop("cluster"), 3).collect()}
    assert c["a"] == c["b"] and len(c) == 54
    with pytest.raises(ValueError):
        D.assign(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, vector array<float>"))


def test_blocks_cover_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    items = spark.createDataFrame([(f"{i:03d}", [1.0, i / 1e6], 0) for i in range(40)], "id string, vector array<float>, cluster int")
    assert D.similar_pairs(items, 0.01).distinct().count() == 40 * 39 // 2


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    """At each threshold the links give the groups of all pairs that overlap, and are fewer than the rows of their blocks."""
    monkeypatch.setattr(D, "BLOCK", 20)
    rng = np.random.default_rng(4)
    words = "red green blue grey black white".split()
    rows = [(f"{i:03d}", (rng.normal(size=3) + 3 * np.eye(3)[i % 3]).tolist(), " ".join(rng.choice(words, 2)), i % 2) for i in range(90)]
    items = spark.createDataFrame(rows, "id string, vector array<double>, text string, cluster int")
    link = D.links(items, 0.3, 0.4)
    assert link.count() < 6 * 40 * 2
    unit = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows}

    def parts(pairs):
        of = {r[0]: r[0] for r in rows}
        for a, b in pairs:
            low, high = sorted((of[a], of[b]))
            of = {k: low if v == high else v for k, v in of.items()}
        return of

    for eps in (0.3, 0.1, 0.02):
        jac = lambda a, b: len(set(a) & set(b)) >= 0.4 * len(set(a) | set(b))
        want = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if a[3] == b[3] and unit[a[0]] @ unit[b[0]] >= 1 - eps and jac(a[2].split(), b[2].split())]
        assert parts([(r["a"], r["b"]) for r in link.where(f"similarity >= {1 - eps}").collect()]) == parts(want)


def test_links_and_layout(spark):
    hits = spark.createDataFrame([("s", "s", "node", "m0", 9.0), ("s", "a", "node", "m1", 1.0), ("s", "a", "node", "m2", 2.0), ("s", "b", "edge", "m3", 5.0), ("s", "c", None, "m4", 2.0)], "source_key string, memory_key string, kind string, source_map string, score double")
    assert [(r["memory_key"], r["source_map"], r["rank"]) for r in L.autolink(hits).orderBy("rank").collect()] == [("a", "m2", 0), ("c", "m4", 1)]
    assert L.autolink(hits, top_k=0).count() == 0 and L.autolink(hits, min_score=3.0).count() == 0
    ids = spark.createDataFrame([(f"{i:03d}",) for i in range(50)], "id string")
    assert [r["i"] for r in L.numbered(ids, "id").orderBy("id").collect()] == list(range(50))
    p = L.fibonacci_sphere(ids, "id").agg(*[f(a) for a in "xyz" for f in (F.min, F.max)]).first()
    assert list(p) == pytest.approx([-1, 1] * 3)
    assert L.fibonacci_sphere(ids.limit(1), "id").first()["x"] == 0 and L.fibonacci_sphere(ids.limit(0), "id").count() == 0


def test_approximate_nearest_recall(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 16))
    rows = [(i, (centre[i % 20] + rng.normal(size=16) * 0.2).tolist()) for i in range(600)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = set(np.argsort(-(x @ x[7]))[:10].tolist())
    got = {r["id"] for r in L.approximate_nearest(spark.createDataFrame(rows, "id int, vector array<float>"), rows[7][1], 10, "id").collect()}
    assert len(want & got) >= 9


def test_files(spark, tmp_path):
    chunks = spark.createDataFrame([("m", "s", "t")], "memory_id string, source_key string, text string")
    FS.export_texts(chunks, f"{tmp_path}/x")
    assert spark.read.json(f"{tmp_path}/x").first()["text"] == "t"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.md").write_text(" hi ")
    (tmp_path / "f/b.bin").write_bytes(b"\x00")
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in FS.read_files(spark, f"{tmp_path}/f").collect()} == {"a.md": "hi", "b.bin": None}
    many = spark.createDataFrame([(i, "x" * i) for i in range(250)], "i int, t string").coalesce(1)
    assert {len(r["vector"]) for r in FS.embed(many, "t", lambda ts: [[float(len(t))] * (1 if len(ts) <= 100 else 2) for t in ts]).collect()} == {1}
    import hashlib

    sha = hashlib.sha256(b"x").hexdigest()
    FS.write_cold(spark.createDataFrame([(sha, bytearray(b"x")), ("no", bytearray(b"y"))], "content_sha256 string, payload binary"), f"{tmp_path}/cold")
    assert FS.read_cold(spark.createDataFrame([(sha,), ("no",)], "content_sha256 string"), f"{tmp_path}/cold").count() == 1
    for gz in (True, False):
        FS.write_projection(spark.createDataFrame([("a", "b")], "f string, t string"), f"{tmp_path}/p", gz)
        assert [tuple(r) for r in FS.read_projection(spark, f"{tmp_path}/p", "f string, t string").collect()] == [("a", "b")]
