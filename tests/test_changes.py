from stratamem.operators import changes as C

SCHEMA = "root_hex string, facet string, event_type string, namespace string, memory_key string, source_key string, _ts_created double, kind string"


def _current(spark, rows, order=()):
    df = spark.createDataFrame([(r[0], "content", *r[1:], "clash") for r in rows], SCHEMA)
    got = C.current(C.changes(df), spark.createDataFrame(list(order), "namespace string, memory_key string, ts double, root string, place long"))
    return {tuple(r) for r in got.collect()}


def test_repeats_disorder_and_deletes(spark):
    rows = [
        ("0xB2", " merge_memory", "n", "k", "s1", 2.0), ("a1", "MERGE_MEMORY", "n", "k", "s1", 1.0), ("A1 ", "MERGE_MEMORY", "n", "k", "s1", 9.0),  # a repeat counts at its earliest time
        ("c3", "MERGE_MEMORY", "n", "k2", "s1", 1.0), ("d4", "delete_memory\n", "n", "k2", None, 2.0), ("e5", "MERGE_MEMORY", "n", "k2", "s2", 3.0),
        ("f6", "OTHER", "n", "k", "s3", 1.0), ("a7", "MERGE_MEMORY", None, "k", None, 1.0)]
    assert _current(spark, rows) == {("n", "k", "s1", "b2"), ("n", "k2", "s2", "e5"), (None, "k", None, "a7")}


def _by_history(spark, rows, linked):
    df = C.changes(spark.createDataFrame([(r[0], "content", *r[1:], "clash") for r in rows], SCHEMA))
    log = spark.createDataFrame(linked, "root_hex string, parent_root_hex string, node int")
    order = C.order(df, C.links(log))
    return {tuple(r) for r in C.current(df, order).collect()}, {(r["root"], r["place"]) for r in order.collect()}


def test_ties_follow_the_history(spark):
    rows = [("aa", "MERGE_MEMORY", "n", "k", "s", 1.0), ("bb", "DELETE_MEMORY", "n", "k", None, 1.0)]
    at = lambda r, p: ("n", "k", 1.0, r, p)
    assert _current(spark, rows, [at("aa", 2), at("bb", 1)]) == {("n", "k", "s", "aa")}
    assert _current(spark, rows, [at("aa", 1), at("bb", 2)]) == set()
    assert _by_history(spark, rows, [("0xAA", " bb", 1), ("bb", "0" * 64, 1)])[0] == {("n", "k", "s", "aa")}
    assert _by_history(spark, rows, [("bb", "aa", 1), ("aa", None, 1), ("aa", None, 1)])[0] == set()


def test_ties_of_distant_and_looping_roots(spark):
    """Nine roots of one time in a line, all but one of them near; two far apart; two that share no history; two below a cycle."""
    merge = lambda root, k, ts=1.0: (root, "MERGE_MEMORY", "n", k, "s", ts)
    line = [(f"a{i}", f"a{i - 1}" if i else None, 1) for i in range(9)] + [(f"far{i:02d}", f"far{i + 1:02d}" if i < 20 else "a8", 1) for i in range(21)]
    loop = [("l1", "l2", 1), ("l2", "l1", 1), ("m1", "l1", 1), ("c1", "m1", 1)]
    rows = [merge(f"a{i}", "k1") for i in (8, 3, 0, 5, 1, 2, 4, 6, 7)] + [merge("far00", "k2"), merge("far19", "k2"), merge("zz", "k3"), merge("a1", "k3"), merge("m1", "k4"), merge("c1", "k4"), merge("a7", None, None), merge("a8", None, None)]
    live, place = _by_history(spark, rows, line + loop)
    assert live == {("n", "k1", "s", "a8"), ("n", "k2", "s", "far00"), ("n", "k3", "s", "a1"), ("n", "k4", "s", "c1"), ("n", None, "s", "a8")}
    assert dict(p for p in place if p[0] in ("m1", "c1")) == {"m1": 0, "c1": 1} and ("far00", 29) in place and ("far19", 10) in place


def test_empty(spark):
    assert _current(spark, []) == set()
