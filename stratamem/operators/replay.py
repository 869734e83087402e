"""Provenance reads and time travel: heads, pages, last-writer-wins state at a point, evacuation, chain verification.

The order of the log is (time, id), as rows have no number of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.functions.ids import chain_root, event_leaf
from stratamem.schema import GENESIS, HOT_TIPS, PAGE_LIMIT
from stratamem.sources.tables import normal

#: The columns that name one field of a facet; a delete clears all fields of its memory.
FIELDS = {"content": ["namespace", "memory_key", "source_key"], "vector": ["namespace", "memory_key", "source_key"], "graph": ["namespace", "memory_key", "edge_id"]}


def log(provenance: DataFrame) -> DataFrame:
    """The provenance with normal hashes, each row once, and `at`, its place in the log."""
    rows = provenance.withColumns({"root": normal("root_hex"), "parent": normal("parent_root_hex")}).dropDuplicates(["_id"])
    return rows.withColumn("at", F.struct("_ts_created", "_id"))


def head(logged: DataFrame) -> DataFrame:
    """root, _ts_created of the last row; none for an empty log."""
    return logged.agg(F.max(F.struct("at", "root")).alias("m")).where("m IS NOT NULL").select("m.root", "m.at._ts_created")


def _page(rows: DataFrame, limit: int, *columns: str) -> DataFrame:
    return rows.orderBy(F.desc("_ts_created"), F.desc("_id")).limit(max(1, min(PAGE_LIMIT, limit))).select(*columns)


def event(field: str) -> Column:
    return F.get_json_object("event_json", f"$.{field}")


def events_page(logged: DataFrame, namespace: str | None = None, key: str | None = None, before: tuple[float, str] | None = None, limit: int = PAGE_LIMIT) -> DataFrame:
    """The newest events before a cursor, of a namespace (as named, left or entered) and key. Cut-off event text has none."""
    rows = logged
    if namespace is not None:
        rows = rows.where(F.coalesce((event("namespace") == namespace) | (event("from") == namespace) | (event("to") == namespace), event("namespace") == namespace))
    if key is not None:
        rows = rows.where(event("memory_key") == key)
    if before is not None:
        rows = rows.where((F.col("_ts_created") < before[0]) | ((F.col("_ts_created") == before[0]) & (F.col("_id") < before[1])))
    return _page(rows, limit, "_id", "_ts_created", "event_type", "root")


def chain_page(logged: DataFrame, before_root: str | None = None, limit: int = PAGE_LIMIT) -> DataFrame:
    """The newest chain rows before a root; none for an unknown one."""
    rows = logged
    if before_root is not None:
        rows = rows.where(F.col("at") < logged.where(F.col("root") == before_root).agg(F.max("at").alias("at")).scalar())
    return _page(rows, limit, "_id", "_ts_created", "parent", "root")


def changes_at(outbox: DataFrame, facet: str, until: Column | float | None = None) -> DataFrame:
    """Distinct changes of a facet up to a time: the field's columns, root, kind, payload, ts."""
    rows = outbox.where(F.col("facet") == facet)
    if until is not None:
        rows = rows.where(F.col("_ts_created") <= until)
    return rows.groupBy(*FIELDS[facet], normal("root_hex").alias("root"), F.upper(F.btrim("event_type", F.lit(" \t\n"))).alias("kind"), F.nullif(normal("payload_sha256"), F.lit("")).alias("payload")).agg(F.min("_ts_created").alias("ts"))


def state(changed: DataFrame, facet: str) -> DataFrame:
    """The fields that live after the changes, with the root and payload of the merge that set them."""
    fields = FIELDS[facet]
    at = F.struct("ts", "root")
    last = changed.where("kind = 'MERGE_MEMORY'").groupBy(*fields).agg(F.max(F.struct("ts", "root", "payload")).alias("m"))
    gone = changed.where("kind = 'DELETE_MEMORY'").groupBy(F.col("namespace").alias("n"), F.col("memory_key").alias("k")).agg(F.max(at).alias("gone"))
    rows = last.join(gone, last["namespace"].eqNullSafe(gone["n"]) & last["memory_key"].eqNullSafe(gone["k"]), "left")
    return rows.where(F.col("gone").isNull() | (F.struct(F.col("m.ts").alias("ts"), F.col("m.root").alias("root")) > F.col("gone"))).select(*fields, F.col("m.root").alias("root"), F.col("m.payload").alias("payload"))


def with_blobs(fields: DataFrame, blobs: DataFrame) -> DataFrame:
    """The state with its payloads' location; null where no such blob exists."""
    b = blobs.select(normal("content_sha256").alias("payload"), "location", "cold_uri").groupBy("payload").agg(F.min("location").alias("location"), F.min("cold_uri").alias("cold_uri"))
    return fields.join(b, "payload", "left")


def evacuable(logged: DataFrame, outbox: DataFrame, blobs: DataFrame, tips: int = HOT_TIPS) -> DataFrame:
    """content_sha256 of the hot blobs to which none of the newest `tips` roots points; 0 tips, none."""
    if tips == 0:
        return blobs.select(normal("content_sha256").alias("content_sha256")).where(F.lit(False))
    newest = logged.orderBy(F.desc("_ts_created"), F.desc("_id")).limit(tips).select("root")
    live = outbox.select(normal("root_hex").alias("root"), normal("payload_sha256").alias("content_sha256")).join(newest, "root", "left_semi")
    return blobs.where("location = 'hot'").select(normal("content_sha256").alias("content_sha256")).distinct().join(live, "content_sha256", "left_anti")


def to_cold(blobs: DataFrame, out: DataFrame, uri: Column | None) -> DataFrame:
    """The blobs after the evacuation of `out`: cold at `uri` if their hash is right, or dropped without a uri."""
    hit = out.select("content_sha256", F.lit(True).alias("hit"))
    rows = blobs.withColumn("_n", normal("content_sha256")).join(hit.withColumnRenamed("content_sha256", "_n"), "_n", "left")
    move = F.coalesce("hit", F.lit(False)) & ((F.sha2("payload", 256) == F.col("_n")) if uri is not None else F.lit(True))
    return rows.withColumns({"payload": F.when(~move, F.col("payload")), "location": F.when(move, "cold" if uri is not None else "dropped").otherwise(F.col("location")),
                             "cold_uri": F.when(move, uri if uri is not None else F.lit(None)).otherwise(F.col("cold_uri"))}).drop("_n", "hit")


def verify_chain(logged: DataFrame) -> DataFrame:
    """root, links (its parent exists or it starts a chain) and hashes (the root is the hash of parent and event)."""
    held = logged.select(F.col("root").alias("parent"), F.lit(True).alias("held")).distinct()
    rows = logged.join(held, "parent", "left")
    start = F.col("parent").isin("", GENESIS) | F.col("parent").isNull()
    return rows.select("root", (start | F.coalesce("held", F.lit(False))).alias("links"), F.coalesce(F.col("root") == chain_root(F.when(start, F.lit(GENESIS)).otherwise(F.col("parent")), event_leaf("event_json")), F.lit(False)).alias("hashes"))


def append(parent: str, events: list[str]) -> list[tuple[str, str]]:
    """(parent, root) of events appended one after another: a chain is sequential, so this is for one writer's batch."""
    import hashlib

    from stratamem.functions.ids import EVENT_LEAF

    out = []
    for e in events:
        leaf = hashlib.sha256((EVENT_LEAF + e).encode()).digest()
        root = hashlib.sha256(bytes.fromhex(parent) + leaf).hexdigest()
        out.append((parent, root))
        parent = root
    return out


def chained(events: DataFrame, parent: str) -> DataFrame:
    """`events` (n, event_json, ...) with parent and root, chained in the order of n after `parent`. A hash chain is sequential
    by nature, so the hashes of one writer's batch are made in one task; only n and event_json go through it, as a stream."""

    def run(batches):
        last = parent
        for pdf in batches:
            links = append(last, pdf["event_json"].tolist())
            last = links[-1][1] if links else last
            yield pdf[["n"]].assign(parent=[p for p, _ in links], root=[r for _, r in links])

    roots = events.select("n", "event_json").repartition(1).sortWithinPartitions("n").mapInPandas(run, "n long, parent string, root string")
    return events.join(roots, "n")


def lagged(logged: DataFrame, per: str) -> DataFrame:
    """root, previous: the root before it among the rows of the same `per`, for checks of per-store logs."""
    return logged.select("root", F.lag("root").over(Window.partitionBy(per).orderBy("_ts_created", "_id")).alias("previous"))
