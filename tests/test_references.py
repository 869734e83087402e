from pyspark.sql import functions as F

from stratamem.operators import references as R


def _refs(spark, rows, sign=1, at=None):
    return R.ref_deltas(spark.createDataFrame([(*r, 1, "clash") for r in rows], "id string, key string, ts double, extra int, child_id string"), "c", "id", "key", "ts", sign, at)


def _targets(spark, rows, sign=1, at=None):
    return R.exist_deltas(spark.createDataFrame([(*r, "x") for r in rows], "key string, ts double, live boolean, child_table string"), "c", "key", "ts", F.col("live"), sign, at)


def _orphans(rows):
    return {(r["child_id"], r["missing"]) for r in R.orphan_rows(rows).collect()}


def test_absent_dropped_and_late(spark):
    children = [("a", "0xK1", 5.0), ("b", " k2\n", 5.0), ("c", "K3", 5.0), ("d", "k3", 7.0), ("e", "k4", 5.0), ("f", None, 1.0), ("g", " \t", 1.0), ("h", "k3", None)]
    targets = [("k1", 5.0, True), ("k2", 1.0, False), ("k3", 6.0, True)]
    assert _orphans(R.ledger(_refs(spark, children), _targets(spark, targets))) == {("b", "absent"), ("c", "late"), ("e", "absent")}


def test_copies_count_once_and_empty_tables(spark):
    both = R.ledger(_refs(spark, [("a", "k", 1.0)] * 3), _targets(spark, [("k", 1.0, True)] * 2))
    assert [(r["refs"], r["exists"]) for r in R.counts(both).collect()] == [(1, 1)]
    assert _orphans(R.ledger(_refs(spark, [("a", "k", 1.0)]), _targets(spark, []))) == {("a", "absent")}
    assert _orphans(R.ledger(_refs(spark, []), _targets(spark, [("k", 1.0, True)]))) == set()


def test_ledgers_add_up(spark):
    refs, born = _refs(spark, [("a", "k", 3.0), ("b", "l", 3.0)]), _targets(spark, [("k", 1.0, True)])
    parts = R.merge_ledgers(R.ledger(refs), R.ledger(born))
    assert sorted(R.ledger(refs, born).collect()) == sorted(parts.collect())
    gone = R.merge_ledgers(parts, R.ledger(_targets(spark, [("k", 1.0, True)], -1, F.lit(1.0))))
    assert _orphans(gone) == {("a", "absent"), ("b", "absent")}
    assert _orphans(R.merge_ledgers(gone, R.ledger(born))) == {("a", "absent"), ("b", "absent")}
    unlinked = R.merge_ledgers(gone, R.ledger(_refs(spark, [("a", "k", 3.0), ("b", "l", 3.0)], -1, F.lit(0.0))))
    assert _orphans(unlinked) == set()


def test_report_by_month(spark):
    got = R.report(R.orphan_rows(R.ledger(_refs(spark, [("a", "k", 0.0), ("b", "k", 31.5 * 86400e3)])))).collect()
    assert {(r["month"], r["n_rows"], r["n_keys"]) for r in got} == {("1970-01", 1, 1), ("1970-02", 1, 1)}
