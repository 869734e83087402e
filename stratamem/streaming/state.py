"""Maintaining states from change streams with Structured Streaming.

A micro-batch is reduced to a state of its own, which is merged with the one before and written under the batch's number.
A batch that is run again after a failure starts from the same earlier state and overwrites its own result, so each change
counts once. Late and disordered changes need no watermark: the states don't depend on the order of arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratamem.operators import references as R
from stratamem.operators import replay as P

KEEP_STATES = 3


class MergedState:
    """A state table with one directory per micro-batch; the last few are kept."""

    def __init__(self, spark: SparkSession, path: str, reduce: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]):
        self.spark, self.path, self.reduce, self.merge = spark, path.rstrip("/"), reduce, merge
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _epochs(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(p.getName()) for p in names if p.getName().isdigit() and self._fs.exists(self._at(f"{p}/_SUCCESS")))

    def current(self, before: int | None = None) -> DataFrame | None:
        done = [e for e in self._epochs() if before is None or e < before]
        return self.spark.read.parquet(f"{self.path}/{done[-1]:012d}") if done else None

    def update(self, batch: DataFrame, epoch: int) -> None:
        new, old = self.reduce(batch), self.current(epoch)
        (new if old is None else self.merge(old, new)).write.mode("overwrite").parquet(f"{self.path}/{epoch:012d}")
        for e in self._epochs()[:-KEEP_STATES]:
            self._fs.delete(self._at(f"{self.path}/{e:012d}"), True)

    def start(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return changes.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def outbox_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """The outbox's Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def field_state(spark: SparkSession, path: str, facet: str) -> MergedState:
    """The last merge of each field and the last delete of each memory, as rows of one table."""
    keys = [*P.FIELDS[facet], "kind"]

    def reduce(batch: DataFrame) -> DataFrame:
        c = P.changes_at(batch, facet).where(F.col("kind").isin("MERGE_MEMORY", "DELETE_MEMORY"))
        return c.groupBy(*keys).agg(F.max(F.struct("ts", "root", "payload")).alias("m"))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy(*keys).agg(F.max("m").alias("m"))

    return MergedState(spark, path, reduce, merge)


def live_fields(state: DataFrame, facet: str) -> DataFrame:
    """The live fields of a field state, as `replay.state` gives them.

    A repeat of a change under a later time is a new change here, as a stream can't know the earliest time of what is still
    to come; replay from the whole outbox takes the earliest."""
    return P.state(state.select(*P.FIELDS[facet], "kind", "m.root", "m.payload", "m.ts"), facet)


def reference_state(spark: SparkSession, path: str) -> MergedState:
    """The ledger of references and targets from a stream of deltas (`references.ref_deltas` and `exist_deltas`), of which
    `references.counts` and `orphan_rows` give the report. Deletes, repeats and disorder are all right."""
    return MergedState(spark, path, lambda batch: R.ledger(batch), R.merge_ledgers)
