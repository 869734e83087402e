"""References to records that do not exist.

Every change of a child or target table is a signed delta of one row: it came (1) or went (-1) at some time. A ledger holds,
for each (child_table, key, side, id), when the row last came and last went; a row that came after it last went is there.
Summed per key this gives the signed counts `refs` and `exists` with the earliest time of either. Keys with refs > 0 and
exists = 0 are orphans; a key whose target exists but came later is late for the rows that point at it before that time.

Ledgers add up in any order, and a delta delivered again changes nothing (`merge_ledgers`), so the report is maintained from
change deltas alone: a target that is taken away makes its pointing rows orphans again, and the earliest times follow.

Defined cases: null and blank keys point at nothing; a null target time counts as the beginning of time; a null time
of the pointing row is never earlier than its target; exact copies of a row count once; of a coming and a going at the
same time the going counts; empty tables give empty results. A hot key is one entry a row in the ledger and is summed
map-side; its rows are only split, never gathered (AQE skew join).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.sources.tables import normal

KEYS = ["child_table", "key"]
ROW = [*KEYS, "side", "id"]
REF, TARGET = "ref", "target"


def _deltas(df: DataFrame, child_table: str, side: str, id_: Column, key: str, ts: Column, sign: int, at: Column) -> DataFrame:
    when = lambda s: F.lit(None).cast("double") if sign != s else at.cast("double")
    return df.select(F.lit(child_table).alias("child_table"), normal(key).alias("key"), F.lit(side).alias("side"), id_.cast("string").alias("id"),
                     when(1).alias("came"), when(-1).alias("went"), ts.cast("double").alias("ts")).where("key <> ''")


def ref_deltas(df: DataFrame, child_table: str, child_id: str, key: str, ts: str, sign: int = 1, at: Column | None = None) -> DataFrame:
    """Pointing rows that came (1) or went (-1); `at` is the time of the change, which matters only between changes of one row."""
    return _deltas(df, child_table, REF, F.col(child_id), key, F.col(ts), sign, F.lit(0.0) if at is None else at)


def exist_deltas(df: DataFrame, child_table: str, key: str, ts: str, live: Column | None = None, sign: int = 1, at: Column | None = None) -> DataFrame:
    """Target rows of child_table that came or went, told apart by their time; those that can't be used (not `live`) left out."""
    since = F.coalesce(F.col(ts).cast("double"), F.lit(float("-inf")))
    return _deltas(df if live is None else df.where(live), child_table, TARGET, since, key, since, sign, F.lit(0.0) if at is None else at)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ROW).agg(F.max("came").alias("came"), F.max("went").alias("went"), F.min("ts").alias("ts"))


def ledger(*deltas: DataFrame) -> DataFrame:
    """child_table, key, side, id, came, went, ts: one row for each row that ever came or went."""
    return _summed(reduce(DataFrame.unionByName, deltas))


def merge_ledgers(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger after further deltas. Rows that went stay in it, as an older delta of theirs may still arrive."""
    return _summed(old.unionByName(new))


def present(rows: DataFrame, side: str) -> DataFrame:
    return rows.where((F.col("side") == side) & F.col("came").isNotNull() & (F.col("went").isNull() | (F.col("came") > F.col("went"))))


def counts(rows: DataFrame) -> DataFrame:
    """The state of each key of a ledger: refs, exists, first_ref and first_exist per (child_table, key)."""
    there = F.col("came").isNotNull() & (F.col("went").isNull() | (F.col("came") > F.col("went")))
    ref, target = there & (F.col("side") == REF), there & (F.col("side") == TARGET)
    return rows.groupBy(*KEYS).agg(F.count_if(ref).alias("refs"), F.count_if(target).alias("exists"), F.min(F.when(ref, F.col("ts"))).alias("first_ref"), F.min(F.when(target, F.col("ts"))).alias("first_exist"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist, or did not yet exist for some of their references."""
    return state.where("refs > 0 AND (exists = 0 OR first_ref < first_exist)")


def orphan_rows(rows: DataFrame) -> DataFrame:
    """The pointing rows of a ledger without a usable target: child_table, child_id, key, ts, missing ('absent' or 'late')."""
    bad = orphan_keys(counts(rows)).select(*KEYS, "exists", "first_exist")
    return present(rows, REF).join(bad, KEYS).where("exists = 0 OR ts < first_exist").select(
        "child_table", F.col("id").alias("child_id"), "key", "ts", F.when(F.col("exists") == 0, "absent").otherwise("late").alias("missing"))


def report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month (UTC) and kind. Rows without a time have a null month."""
    month = F.date_format(F.timestamp_millis(F.floor("ts")), "yyyy-MM")
    return orphans.groupBy("child_table", month.alias("month"), "missing").agg(
        F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_keys"))
