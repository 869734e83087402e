"""The store as versioned Parquet tables, and the mutations that keep its derived tables in step.

A table is a list of parts: rows that were added and ids that were removed, each with the version that wrote it; a removal holds
for older rows. A mutation adds parts for what it changes and publishes them together as the next version: its manifest is
written aside and renamed to the version's name, which fails if that name is taken. So a crash at any point leaves the last version as it
was, nothing is ever deleted on the way, and of two writers from one version the second is refused. Tables of many parts are
written anew as one (`COMPACT_AT`)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.functions.ids import stable_id
from stratamem.functions.paths import over_quota, path_error, renamed, under
from stratamem.functions.text import props_text, stems
from stratamem.functions.vectors import encode_vector
from stratamem.operators import graph as G
from stratamem.operators import replay as R
from stratamem.operators.links import numbered
from stratamem.operators.predicates import closes_cycle, scope_closure
from stratamem.schema import GENESIS, HOT_TIPS, LABEL_PROPS_KEYS, SEARCH_META_KEY, TABLES
from stratamem.sources.files import read_cold, write_cold
from stratamem.sources.tables import keep

SCHEMA_VERSION = 2
COMPACT_AT = 24  # parts of a table
WRITERS = 8  # tables that one commit writes at once


class Store:
    def __init__(self, spark: SparkSession, path: str, readonly: bool = False):
        self.spark, self.path, self.readonly = spark, path.rstrip("/"), readonly
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at, conf = hadoop.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(conf)
        self._files = hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        if self._versions() or self._fs.exists(self._at(f"{self.path}/CURRENT")):
            return
        if readonly:
            raise FileNotFoundError(self.path)
        if self._fs.exists(self._at(self.path)) and len(self._fs.listStatus(self._at(self.path))):
            raise ValueError(f"{self.path} holds something else than a store")
        self._publish({"schema": SCHEMA_VERSION, "tables": {}}, 0)

    def _read(self, name: str) -> str:
        f = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def _versions(self) -> list[int]:
        at = self._at(f"{self.path}/versions")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    @property
    def version(self) -> int:
        """The number of the last version; 0 for a store of the first layout, which named its version in a file."""
        return (self._versions() or [0])[-1]

    def manifest(self, version: int | None = None) -> dict:
        v = self.version if version is None else version
        return upgraded(json.loads(self._read(f"versions/{v:012d}.json") if v else self._read(self._read("CURRENT") + ".json")))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the last version, or of an earlier one; an empty one that was never written."""
        parts = self.manifest(version)["tables"].get(name, [])
        return self._rows(name, parts)

    def _rows(self, name: str, parts: list[dict]) -> DataFrame:
        schema = TABLES[name]
        seq = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{12})-(?:rows|gone|whole)-", 1).cast("int")  # from the part's name; all parts are one scan
        read = lambda kind, shape: (at := [p["at"] for p in parts if p["kind"] == kind]) and self.spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(*at)
        rows, gone = read("rows", schema), read("gone", "_id string")
        if not rows:
            return self.spark.createDataFrame([], schema)
        if gone:
            last = gone.groupBy("_id").agg(F.max(F.coalesce(seq, F.lit(0))).alias("_gone"))
            rows = rows.withColumn("_seq", F.coalesce(seq, F.lit(0))).join(last, "_id", "left").where("_gone IS NULL OR _gone <= _seq")
        return rows.select(*schema.fieldNames())

    def _publish(self, manifest: dict, version: int) -> None:
        """Makes a manifest the version after `version`, unless there is one already."""
        aside, name = self._at(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._at(f"{self.path}/versions/{version + 1:012d}.json")
        f = self._fs.create(aside, False)
        try:
            f.write(bytearray(json.dumps(manifest).encode()))
        finally:
            f.close()
        try:
            self._files.rename(aside, name, self._no_overwrite)
        except Exception as e:
            if not self._fs.exists(name):
                raise
            raise RuntimeError("the store was changed by another writer") from e

    def change(self) -> Change:
        if self.readonly:
            raise PermissionError("read-only store")
        return Change(self)


class Change:
    """What a mutation adds and removes, to be published together. Rows of an id that is there already take its place."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version
        self.added: dict[str, DataFrame] = {}
        self.gone: dict[str, DataFrame] = {}

    def add(self, name: str, rows: DataFrame, fresh: bool = False) -> None:
        """Adds rows; `fresh` ones have ids that the table does not hold."""
        rows = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
        self.added[name] = self.added[name].unionByName(rows) if name in self.added else rows
        if not fresh:
            self.remove(name, rows)

    def remove(self, name: str, ids: DataFrame) -> None:
        ids = ids.select("_id")
        self.gone[name] = self.gone[name].union(ids) if name in self.gone else ids

    def after(self, name: str) -> DataFrame:
        """The table as it will be."""
        rows = self.store.table(name, self.base)
        if name in self.gone:
            rows = rows.join(self.gone[name].distinct(), "_id", "left_anti")
        return rows.unionByName(self.added[name]) if name in self.added else rows

    def commit(self) -> None:
        s, manifest, seq = self.store, self.store.manifest(self.base), self.base + 1
        new: dict[str, list[dict]] = {}
        at = f"{s.path}/gone/{seq:012d}-gone-{uuid.uuid4().hex[:8]}"

        def write_gone() -> None:
            reduce(DataFrame.union, [df.select("_id", F.lit(name).alias("of")) for name, df in self.gone.items()]).write.partitionBy("of").parquet(at)

        def write_rows(name: str, df: DataFrame) -> None:
            path = f"{s.path}/{name}/{seq:012d}-rows-{uuid.uuid4().hex[:8]}"
            df.write.parquet(path)
            new[name] = [{"seq": seq, "kind": "rows", "at": path}]

        with ThreadPoolExecutor(WRITERS) as pool:
            jobs = [pool.submit(write_rows, *x) for x in self.added.items()] + ([pool.submit(write_gone)] if self.gone else [])
            for job in jobs:
                job.result()
        for name in self.gone:
            if s._fs.exists(s._at(path := f"{at}/of={name}")):
                new.setdefault(name, []).append({"seq": seq, "kind": "gone", "at": path})
        for name, parts in new.items():
            parts = manifest["tables"].get(name, []) + parts
            if len(parts) > COMPACT_AT:
                path = f"{s.path}/{name}/{seq:012d}-whole-{uuid.uuid4().hex[:8]}"
                s._rows(name, parts).write.parquet(path)
                parts = [{"seq": seq, "kind": "rows", "at": path}]
            manifest["tables"][name] = parts
        s._publish(manifest, self.base)


def _listed(manifest: dict) -> dict:
    """From one folder a table to a list of parts."""
    return manifest | {"tables": {k: [{"seq": 0, "kind": "rows", "at": at}] for k, at in manifest["tables"].items()}}


#: Steps from one schema version to the next, each on a manifest.
UPGRADES: dict[int, Callable[[dict], dict]] = {1: _listed}


def upgraded(manifest: dict) -> dict:
    while manifest["schema"] < SCHEMA_VERSION:
        manifest = UPGRADES[manifest["schema"]](manifest) | {"schema": manifest["schema"] + 1}
    return manifest


CONTENTS = "array<struct<source_key: string, text: string, vector: array<float>>>"


def _none() -> Column:
    return F.lit(None).cast("string")


def logged(c: Change, kind: str, events: DataFrame, now_ms: float, facets: bool = True, fields: tuple[str, ...] = ()) -> None:
    """A provenance event, and with `facets` outbox rows and blobs, for each of events (namespace, memory_key, contents, and what else the
    event's JSON shows), in the order of their names."""
    s = c.store
    head = R.head(R.log(c.after("memory_provenance"))).collect()
    order = numbered(events.withColumn("_o", F.concat_ws("\0", "namespace", "memory_key")), "_o").withColumnRenamed("i", "n")
    keys = F.transform("contents", lambda x: x["source_key"])
    shown = {"kind": F.lit(kind), "memory_key": F.col("memory_key"), "namespace": F.col("namespace"), "source_keys": keys, "v": F.lit(1)} | {f: F.col(f) for f in fields}
    json_ = F.to_json(F.struct(*[shown[k].alias(k) for k in sorted(shown)]))  # keys in order: canonical
    rows = keep(R.chained(order.withColumn("event_json", json_), head[0]["root"] if head else GENESIS), "events")
    t = F.lit(float(now_ms)).alias("_ts_created")
    id_ = F.concat(F.lit("prov_"), F.lpad(F.hex(F.lit(int(now_ms)) * 1_000_000 + F.col("n")), 24, "0"), F.lit(f"_{c.base:08x}"))  # ids grow with time and place
    c.add("memory_provenance", rows.select(F.col("parent").alias("parent_root_hex"), F.col("root").alias("root_hex"), F.lit(kind).alias("event_type"), "event_json", _none().alias("intent_snapshot_id"), id_.alias("_id"), t), fresh=True)
    if not facets:
        return
    gone = kind == "DELETE_MEMORY"
    named = rows.select("root", "namespace", "memory_key")
    binary = F.lit(None).cast("binary").alias("payload")
    parts = rows.select("root", "namespace", "memory_key", F.explode("contents").alias("c")).select("root", "namespace", "memory_key", "c.source_key", F.encode("c.text", "UTF-8").alias("content"), encode_vector("c.vector").alias("vector"))
    out = named.select("root", F.lit("graph").alias("facet"), "namespace", "memory_key", _none().alias("source_key"), binary)
    for facet in ("content", "vector"):
        one = named.select("root", F.lit(facet).alias("facet"), "namespace", "memory_key", _none().alias("source_key"), binary) if gone else parts.where(F.col(facet).isNotNull()).select("root", F.lit(facet).alias("facet"), "namespace", "memory_key", "source_key", F.col(facet).alias("payload"))
        out = out.unionByName(one)
    sha = F.sha2("payload", 256)
    c.add("memory_tip_outbox", out.select(F.col("root").alias("root_hex"), "facet", F.lit(kind).alias("event_type"), "namespace", "memory_key", "source_key", _none().alias("edge_id"), sha.alias("payload_sha256"), stable_id("tob", F.col("root"), F.col("facet"), F.coalesce("source_key", F.lit(""))).alias("_id"), t), fresh=True)
    blobs = out.where("payload IS NOT NULL").select(sha.alias("content_sha256"), "payload").dropDuplicates(["content_sha256"])
    blobs = blobs.join(s.table("memory_tip_blobs").where("location = 'hot'").select("content_sha256"), "content_sha256", "left_anti")
    c.add("memory_tip_blobs", blobs.select("content_sha256", "payload", F.lit("hot").alias("location"), _none().alias("cold_uri"), stable_id("blob", F.col("content_sha256")).alias("_id"), t))


def _events(memos: DataFrame, ids: DataFrame) -> DataFrame:
    """Events without contents for the memos `ids` (memory_id)."""
    return memos.join(ids.select(F.col("memory_id").alias("_id")).distinct(), "_id", "left_semi").select("namespace", F.col("key").alias("memory_key"), F.array().cast(CONTENTS).alias("contents"))


def _of(df: DataFrame, ids: DataFrame, on: str, id_: str = "memory_id") -> DataFrame:
    return df.join(ids.select(F.col(id_).alias(on)).distinct(), on, "left_semi")


def memory_id(ns="namespace", key="key"):
    return stable_id("mem", F.col(ns), F.col(key))


def _incident(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end at the memos `ids`, each once."""
    own = _of(nodes, ids, "memory_id").select(F.col("_id").alias("node"))
    return edges.join(own, edges["from_node_id"] == own["node"], "left_semi").unionByName(edges.join(own, edges["to_node_id"] == own["node"], "left_semi")).dropDuplicates(["_id"])


def cleared(c: Change, ids: DataFrame) -> None:
    """Removes what hangs on the memos `ids` (memory_id): features, labels, nodes, incident edges and the memos of those edges; and
    of edge memos, their edge. The rows of the memos themselves stay."""
    s = c.store
    memos, nodes, edges = s.table("memos"), s.table("nodes"), s.table("edges")
    owned = _of(memos, ids, "_id").where("edge_id IS NOT NULL").select(F.col("edge_id").alias("_id"))
    doomed = keep(_incident(nodes, edges, ids).select("_id").union(owned).distinct(), "doomed")
    own = memos.where("edge_id IS NOT NULL").join(doomed.withColumnRenamed("_id", "edge_id"), "edge_id", "left_semi").join(ids.select(F.col("memory_id").alias("_id")), "_id", "left_anti").select(F.col("_id").alias("memory_id"))
    gone = keep(ids.select("memory_id").union(own).distinct(), "gone")
    c.remove("memos", own.withColumnRenamed("memory_id", "_id"))
    for name in ("source_maps", "text_features", "text_stems", "vector_features", "nodes", "memory_scopes"):
        c.remove(name, _of(s.table(name), gone, "memory_id"))
    c.remove("edges", doomed)
    c.remove("node_label_assignments", s.table("node_label_assignments").join(_of(nodes, gone, "memory_id").select(F.col("_id").alias("node_id")), "node_id", "left_semi"))
    c.remove("edge_label_assignments", s.table("edge_label_assignments").join(doomed.withColumnRenamed("_id", "edge_id"), "edge_id", "left_semi"))


def _known_labels(c: Change, table: str, kinds: DataFrame, prefix: str, t: Column) -> None:
    new = kinds.select("kind").distinct().join(c.store.table(table).select("kind"), "kind", "left_anti")
    c.add(table, new.select("kind", F.lit("").alias("description"), _none().alias("schema"), stable_id(prefix, F.col("kind")).alias("_id"), t))


def _memo_rows(c: Change, items: DataFrame, kind: str, edge: Column, now_ms: float) -> None:
    """The rows of memos (memory_id, namespace, key); the time of creation and suppression stay."""
    old = c.store.table("memos").select(F.col("_id").alias("memory_id"), F.col("suppressed").alias("was"), F.col("_ts_created").alias("since"))
    c.add("memos", items.join(old, "memory_id", "left").select("namespace", "key", F.lit(kind).alias("kind"), edge.alias("edge_id"), F.coalesce("was", F.lit(False)).alias("suppressed"), F.col("memory_id").alias("_id"), F.coalesce("since", F.lit(float(now_ms))).alias("_ts_created")))


def _chunk_rows(c: Change, chunks: DataFrame, t: Column) -> None:
    """Source maps and features of chunks (memory_id, source_key, text, vector); stems are written with the texts, for searches to read."""
    chunks = chunks.withColumn("sm", stable_id("sm", F.col("memory_id"), F.col("source_key")))
    c.add("source_maps", chunks.select("memory_id", "source_key", _none().alias("content_hash"), F.col("sm").alias("_id"), t))
    texts = chunks.where("text IS NOT NULL").select("memory_id", F.col("sm").alias("source_map_id"), "text")
    c.add("text_features", texts.select("memory_id", "source_map_id", "text", stable_id("tf", F.col("source_map_id")).alias("_id"), t))
    c.add("text_stems", texts.select("memory_id", "source_map_id", stems("text").alias("stems"), stable_id("ts", F.col("source_map_id")).alias("_id"), t))
    c.add("vector_features", chunks.where("vector IS NOT NULL").select("memory_id", F.col("sm").alias("source_map_id"), "vector", stable_id("vf", F.col("sm")).alias("_id"), t))


def _checked(c: Change, items: DataFrame, quota: int | None) -> DataFrame:
    bad = items.where(path_error("namespace").isNotNull()).take(1)
    if bad:
        raise ValueError(f"illegal namespace {bad[0]['namespace']!r}")
    if quota is not None and over_quota(c.store.table("memos"), items, quota).take(1):
        raise ValueError(f"more than {quota} namespaces")
    return items.withColumn("memory_id", memory_id())


def derived(c: Change, ids: DataFrame, now_ms: float, formatter: Callable[[Column, Column], Column] | None = None) -> None:
    """The chunks that follow from the graph, for the memos `ids` (memory_id) as they will be: one with the kinds of its labels and the keys
    and kinds of its neighbours, and one for each of its labels (of an edge memory, its edge's) that has properties."""
    t = F.lit(float(now_ms)).alias("_ts_created")
    memos, nodes, edges = c.after("memos"), c.after("nodes"), c.after("edges")
    ids = keep(_of(memos, ids, "_id").select(F.col("_id").alias("memory_id")).distinct(), "derived")
    old = _of(c.store.table("source_maps"), ids, "memory_id").where((F.col("source_key") == SEARCH_META_KEY) | F.col("source_key").startswith(LABEL_PROPS_KEYS["node"]) | F.col("source_key").startswith(LABEL_PROPS_KEYS["edge"])).select(F.col("_id").alias("source_map_id"))
    c.remove("source_maps", old.withColumnRenamed("source_map_id", "_id"))
    for name in ("text_features", "text_stems"):
        c.remove(name, c.store.table(name).join(old, "source_map_id", "left_semi"))
    at = nodes.select(F.col("_id").alias("n"), "memory_id")
    near = _incident(nodes, edges, ids)
    ends = near.join(at.select(F.col("n").alias("from_node_id"), F.col("memory_id").alias("from_id")), "from_node_id").join(at.select(F.col("n").alias("to_node_id"), F.col("memory_id").alias("to_id")), "to_node_id").select(F.col("_id").alias("edge_id"), "from_id", "to_id")
    node_kinds, edge_kinds = (c.after(f"{x}_labels").select(F.col("_id").alias("label_id"), "kind") for x in ("node", "edge"))
    nl = c.after("node_label_assignments").join(node_kinds, "label_id").join(at.withColumnRenamed("n", "node_id"), "node_id")
    el = c.after("edge_label_assignments").join(edge_kinds, "label_id")
    keyed = memos.select(F.col("_id").alias("memory_id"), "key")
    meta = _of(G.meta_text(ends, keyed, nl.select("memory_id", "kind"), el.select("edge_id", "kind")), ids, "memory_id").where("text <> ''")
    own = _of(nl, ids, "memory_id").select("memory_id", "_id", "kind", "props", F.lit(LABEL_PROPS_KEYS["node"]).alias("role"))
    of_edge = _of(memos, ids, "_id").where("edge_id IS NOT NULL").select(F.col("_id").alias("memory_id"), "edge_id")
    own = own.unionByName(el.join(of_edge, "edge_id").select("memory_id", "_id", "kind", "props", F.lit(LABEL_PROPS_KEYS["edge"]).alias("role")))
    props = own.select("memory_id", F.concat("role", "_id").alias("source_key"), props_text("kind", "props", formatter).alias("text")).where("text <> ''")
    chunks = meta.select("memory_id", F.lit(SEARCH_META_KEY).alias("source_key"), "text").unionByName(props)
    _chunk_rows(c, keep(chunks.withColumn("vector", F.lit(None).cast("array<float>")), "chunks"), t)


def _around(s: Store, ids: DataFrame) -> DataFrame:
    """The memos `ids` and those next to them now."""
    near = _incident(s.table("nodes"), s.table("edges"), ids)
    at = s.table("nodes").select(F.col("_id").alias("n"), "memory_id")
    ends = near.select(F.explode(F.array("from_node_id", "to_node_id")).alias("n")).join(at, "n").select("memory_id")
    return keep(ids.select("memory_id").union(ends).distinct(), "around")


def merge(s: Store, items: DataFrame, now_ms: float, formatter: Callable[[Column, Column], Column] | None = None, quota: int | None = None) -> None:
    """Writes node memos: items have namespace, key, properties?, chunks array<struct<key, text, vector>>, labels
    array<struct<kind, props>>. What hung on them before is replaced; time of creation and suppression stay. Of several labels
    of one kind the last wins; illegal namespaces, and more namespaces than a quota, are refused. The chunks derived from
    the graph are made anew for them and for those that were next to them."""
    c = s.change()
    items = keep(_checked(c, items, quota), "items")
    cleared(c, items)
    t, node = F.lit(float(now_ms)).alias("_ts_created"), stable_id("node", F.col("memory_id"))
    _memo_rows(c, items, "node", _none(), now_ms)
    c.add("nodes", items.select("memory_id", F.col("key").alias("value"), "properties", node.alias("_id"), t))
    _chunk_rows(c, items.select("memory_id", F.explode("chunks").alias("c")).select("memory_id", F.col("c.key").alias("source_key"), "c.text", "c.vector"), t)
    labels = items.select(node.alias("node_id"), F.posexplode("labels").alias("i", "l")).groupBy("node_id", F.col("l.kind").alias("kind")).agg(F.max_by("l.props", "i").alias("props"))
    c.add("node_label_assignments", labels.select("node_id", stable_id("nl", F.col("kind")).alias("label_id"), F.coalesce("props", F.lit("{}")).alias("props"), stable_id("nla", F.col("node_id"), F.col("kind")).alias("_id"), t))
    _known_labels(c, "node_labels", labels, "nl", t)
    c.add("memory_scopes", items.select("memory_id", F.col("namespace").alias("scope_id"), stable_id("ms", F.col("memory_id"), F.col("namespace")).alias("_id"), t))
    derived(c, _around(s, items), now_ms, formatter)
    contents = F.transform("chunks", lambda x: F.struct(x["key"].alias("source_key"), x["text"].alias("text"), x["vector"].alias("vector")))
    logged(c, "MERGE_MEMORY", items.select("namespace", F.col("key").alias("memory_key"), contents.alias("contents")), now_ms)
    c.commit()


def _edge_rows(c: Change, edges: DataFrame, t: Column) -> DataFrame:
    """Writes edges (from_id, to_id, kind, props?, properties?) between memos that must have nodes; with their ids."""
    node = c.store.table("nodes").select(F.col("_id").alias("n"), F.col("memory_id").alias("m"))
    known = edges.join(node.select(F.col("m").alias("from_id"), F.col("n").alias("from_node_id")), "from_id", "left").join(node.select(F.col("m").alias("to_id"), F.col("n").alias("to_node_id")), "to_id", "left")
    if known.where("from_node_id IS NULL OR to_node_id IS NULL").take(1):
        raise ValueError("an edge needs both of its ends")
    new = keep(known.withColumn("_id", stable_id("edge", F.col("from_node_id"), F.col("to_node_id"), F.col("kind"))).dropDuplicates(["_id"]), "edges")
    c.add("edges", new.select("from_node_id", "to_node_id", "properties", "_id", t))
    c.remove("edge_label_assignments", c.store.table("edge_label_assignments").join(new.select(F.col("_id").alias("edge_id")), "edge_id", "left_semi"))
    props = F.coalesce("props", F.lit("{}")) if "props" in edges.columns else F.lit("{}")
    c.add("edge_label_assignments", new.select(F.col("_id").alias("edge_id"), stable_id("el", F.col("kind")).alias("label_id"), props.alias("props"), stable_id("ela", F.col("_id"), F.col("kind")).alias("_id"), t))
    _known_labels(c, "edge_labels", new, "el", t)
    return new


def _ends(new: DataFrame) -> DataFrame:
    return new.select(F.explode(F.array("from_id", "to_id")).alias("memory_id")).distinct()


def link(s: Store, edges: DataFrame, now_ms: float) -> None:
    """Writes edges (from_id, to_id memory ids, kind, properties?) and their labels; both ends must exist."""
    c = s.change()
    new = _edge_rows(c, edges, F.lit(float(now_ms)).alias("_ts_created"))
    derived(c, _ends(new), now_ms)
    c.commit()


def merge_edges(s: Store, items: DataFrame, now_ms: float, formatter: Callable[[Column, Column], Column] | None = None) -> None:
    """Writes edges that are memos themselves: items have namespace, key, chunks, from_id, to_id, kind, props?, properties?. What hung on
    them before is replaced, their edge too."""
    c = s.change()
    items = keep(_checked(c, items, None), "items")
    cleared(c, items)
    t = F.lit(float(now_ms)).alias("_ts_created")
    new = _edge_rows(c, items, t)
    edge = F.col("edge_id")
    _memo_rows(c, new.select("namespace", "key", "memory_id", F.col("_id").alias("edge_id")), "edge", edge, now_ms)
    _chunk_rows(c, items.select("memory_id", F.explode("chunks").alias("c")).select("memory_id", F.col("c.key").alias("source_key"), "c.text", "c.vector"), t)
    c.add("memory_scopes", items.select("memory_id", F.col("namespace").alias("scope_id"), stable_id("ms", F.col("memory_id"), F.col("namespace")).alias("_id"), t))
    derived(c, items.select("memory_id").union(_ends(new)), now_ms, formatter)
    contents = F.transform("chunks", lambda x: F.struct(x["key"].alias("source_key"), x["text"].alias("text"), x["vector"].alias("vector")))
    logged(c, "MERGE_MEMORY", items.select("namespace", F.col("key").alias("memory_key"), contents.alias("contents")), now_ms)
    c.commit()


def replace_feature(s: Store, ns: str, key: str, source_key: str, now_ms: float, text: str | None = None, vector: list[float] | None = None) -> None:
    """Replaces the text or the vector of one chunk; what isn't given stays. One event with what was given."""
    m = s.table("memos").where((F.col("namespace") == ns) & (F.col("key") == key)).select("_id").limit(1).collect()
    if not m or not s.table("source_maps").where((F.col("memory_id") == m[0]["_id"]) & (F.col("source_key") == source_key)).take(1):
        raise KeyError((ns, key, source_key))
    c = s.change()
    one = s.spark.createDataFrame([(m[0]["_id"], source_key, text, vector)], "memory_id string, source_key string, text string, vector array<float>")
    _chunk_rows(c, one, F.lit(float(now_ms)).alias("_ts_created"))
    contents = F.array(F.struct("source_key", "text", "vector"))
    logged(c, "MERGE_MEMORY", one.select(F.lit(ns).alias("namespace"), F.lit(key).alias("memory_key"), contents.alias("contents")), now_ms)
    c.commit()


def delete(s: Store, ids: DataFrame, now_ms: float) -> None:
    """Deletes memos (memory_id) with all that hangs on them, one event each; unknown ids are nothing to delete."""
    c = s.change()
    ids = keep(_of(s.table("memos"), ids, "_id").select(F.col("_id").alias("memory_id")), "delete")
    around = _around(s, ids)
    cleared(c, ids)
    c.remove("memos", ids.withColumnRenamed("memory_id", "_id"))
    derived(c, around, now_ms)
    logged(c, "DELETE_MEMORY", _events(s.table("memos"), ids), now_ms)
    c.commit()


def delete_namespace(s: Store, namespace: str, now_ms: float, recursive: bool = True) -> None:
    """Deletes the memos of a namespace, and of those below it, and its metadata."""
    hit = under("namespace", namespace) if recursive else F.col("namespace") == namespace
    delete(s, s.table("memos").where(hit).select(F.col("_id").alias("memory_id")), now_ms)
    c = s.change()
    c.remove("namespace_metadata", s.table("namespace_metadata").where(hit))
    c.commit()


def suppress(s: Store, ids: DataFrame, now_ms: float, flag: bool = True) -> None:
    """Hides memos (memory_id) from reads, or shows them again; writes stay allowed. Those that are so already give no event."""
    rows = keep(_of(s.table("memos").where(F.coalesce("suppressed", F.lit(False)) != flag), ids, "_id"), "suppress")
    if not rows.take(1):
        return
    c = s.change()
    c.add("memos", rows.withColumn("suppressed", F.lit(flag)))
    logged(c, "SUPPRESS_MEMORY" if flag else "UNSUPPRESS_MEMORY", _events(rows, rows.select(F.col("_id").alias("memory_id"))), now_ms)
    c.commit()


def _namespace_event(c: Change, kind: str, now_ms: float, **fields) -> None:
    one = c.store.spark.range(1).select(F.lit(fields.pop("namespace", None)).cast("string").alias("namespace"), _none().alias("memory_key"), F.array().cast(CONTENTS).alias("contents"), *[F.lit(v).alias(k) for k, v in fields.items()])
    logged(c, kind, one, now_ms, facets=False, fields=tuple(fields))


def suppress_namespace(s: Store, namespace: str, now_ms: float, flag: bool = True) -> None:
    """Hides a namespace and all below it, or shows it again, by its metadata, with one event; none if it is so already."""
    old = s.table("namespace_metadata").where(F.col("namespace") == namespace).collect()
    if bool(old and old[0]["suppressed"]) == flag:
        return
    c = s.change()
    row = (namespace, old[0]["display_name"] if old else None, old[0]["description"] if old else "", flag)
    _metadata(c, s.spark.createDataFrame([row], "namespace string, display_name string, description string, suppressed boolean"))
    _namespace_event(c, "SUPPRESS_NAMESPACE" if flag else "UNSUPPRESS_NAMESPACE", now_ms, namespace=namespace)
    c.commit()


def _metadata(c: Change, rows: DataFrame) -> None:
    c.add("namespace_metadata", rows.select("namespace", "display_name", "description", "suppressed", stable_id("nsm", F.col("namespace")).alias("_id"), F.lit(0.0).alias("_ts_created")))


def upsert_metadata(s: Store, rows: DataFrame) -> None:
    """Namespace metadata (namespace, display_name, description, suppressed): a given row replaces the old one."""
    c = s.change()
    c.remove("namespace_metadata", _of(s.table("namespace_metadata"), rows, "namespace", "namespace"))
    _metadata(c, rows)
    c.commit()


def delete_metadata(s: Store, namespaces: list[str]) -> None:
    c = s.change()
    c.remove("namespace_metadata", s.table("namespace_metadata").where(F.col("namespace").isin(namespaces)))
    c.commit()


def link_scope(s: Store, parent: str, child: str) -> None:
    """Adds a scope edge and rebuilds the closure; an edge that closes a cycle is refused."""
    closure = s.table("scope_closure")
    if closes_cycle(closure, parent, child):
        raise ValueError(f"{parent} > {child} closes a cycle")
    edges = s.table("scope_edges").where((F.col("parent") != parent) | (F.col("child") != child))
    _scopes(s, edges.select("parent", "child").union(s.spark.createDataFrame([(parent, child)], "parent string, child string")))


def ensure_scope_chain(s: Store, scopes: list[str]) -> None:
    """Links each scope of a list to the next one, where that link is not there yet."""
    have = {(r["parent"], r["child"]) for r in s.table("scope_edges").where(F.col("parent").isin(scopes)).select("parent", "child").collect()}
    for a, b in zip(scopes, scopes[1:]):
        if (a, b) not in have:
            link_scope(s, a, b)


def unlink_scope(s: Store, parent: str, child: str) -> None:
    _scopes(s, s.table("scope_edges").where((F.col("parent") != parent) | (F.col("child") != child)).select("parent", "child"))


def _scopes(s: Store, edges: DataFrame) -> None:
    zero, c, edges = F.lit(0.0).alias("_ts_created"), s.change(), keep(edges, "scopes")
    known = s.table("scopes").select(F.col("_id").alias("id"))
    ids = known.union(edges.select("parent")).union(edges.select("child")).distinct()
    for name in ("scopes", "scope_edges", "scope_closure"):
        c.remove(name, s.table(name))
    c.add("scopes", ids.select(F.col("id").alias("_id"), zero))
    c.add("scope_edges", edges.select("parent", "child", stable_id("se", F.col("parent"), F.col("child")).alias("_id"), zero))
    c.add("scope_closure", scope_closure(edges, ids).select("ancestor", "descendant", stable_id("sc", F.col("ancestor"), F.col("descendant")).alias("_id"), zero))
    c.commit()


def replace_scopes(s: Store, rows: DataFrame) -> None:
    """Attaches memos to scopes (memory_id, scope_id) in place of those they were attached to."""
    c = s.change()
    c.remove("memory_scopes", _of(s.table("memory_scopes"), rows, "memory_id"))
    c.add("memory_scopes", rows.distinct().select("memory_id", "scope_id", stable_id("ms", F.col("memory_id"), F.col("scope_id")).alias("_id"), F.lit(0.0).alias("_ts_created")))
    c.commit()


def evacuate(s: Store, cold_path: str | None, tips: int = HOT_TIPS) -> None:
    """Moves the payloads to which none of the newest roots points to a cold store, or drops them without one."""
    blobs, c = s.table("memory_tip_blobs"), s.change()
    out = keep(R.evacuable(R.log(s.table("memory_provenance")), s.table("memory_tip_outbox"), blobs, tips), "evacuate")
    if cold_path:
        write_cold(blobs.join(out, "content_sha256", "left_semi"), cold_path)
    moved = blobs.join(out.select("content_sha256"), "content_sha256", "left_semi")
    c.add("memory_tip_blobs", R.to_cold(moved, out, F.concat(F.lit(f"{cold_path}#"), "content_sha256") if cold_path else None))
    c.commit()


def payloads(s: Store, fields: DataFrame, cold_path: str | None = None) -> DataFrame:
    """Fields of a replay (payload = hash) with `body`: hot, or from the cold store; null where it is gone or altered."""
    hot = s.table("memory_tip_blobs").where("payload IS NOT NULL").select(F.col("content_sha256").alias("payload"), F.col("payload").alias("hot"))
    rows = fields.join(hot, "payload", "left")
    if not cold_path:
        return rows.withColumnRenamed("hot", "body")
    cold = read_cold(fields.select(F.col("payload").alias("content_sha256")), cold_path).select(F.col("content_sha256").alias("payload"), F.col("payload").alias("cold"))
    return rows.join(cold, "payload", "left").withColumn("body", F.coalesce("hot", "cold")).drop("hot", "cold")


def rename_namespace(s: Store, old: str, new: str, recursive: bool = True, now_ms: float = 0.0) -> None:
    """Moves memos to the renamed namespace, with one event. Their ids follow from their names, so every reference is rewritten; a memory
    that is already there is a collision and nothing is changed. The outbox keeps the names under which its rows were written."""
    hit = under("namespace", old) if recursive else F.col("namespace") == old
    memos, c = s.table("memos"), s.change()
    moved = keep(memos.where(hit).select(F.col("_id").alias("was"), renamed("namespace", old, new, recursive).alias("namespace"), "key").withColumn("now", memory_id()), "moved")
    if memos.where(~hit).join(moved.select(F.col("now").alias("_id")), "_id", "left_semi").take(1):
        raise ValueError("a memory of that name is already there")
    swap = lambda df, col, names: df.join(names.select(F.col("was").alias(col), "now"), col, "left").withColumn(col, F.coalesce("now", col)).drop("now")
    ids = moved.select(F.col("was").alias("memory_id"), F.col("now").alias("new_id"))
    nodes = keep(s.table("nodes").join(ids, "memory_id").select(F.col("_id").alias("was"), stable_id("node", F.col("new_id")).alias("now")), "nodes")
    maps = keep(s.table("source_maps").join(ids, "memory_id").select(F.col("_id").alias("was"), stable_id("sm", F.col("new_id"), F.col("source_key")).alias("now")), "maps")

    def rewrite(name: str, rows: DataFrame, new_rows: Callable[[DataFrame], DataFrame]) -> None:
        rows = keep(rows, name)
        c.remove(name, rows)
        c.add(name, new_rows(rows))

    own = lambda name: _of(s.table(name), moved, "memory_id", "was")
    rewrite("memos", memos.where(hit), lambda d: swap(d.withColumn("namespace", renamed("namespace", old, new, recursive)), "_id", moved))
    rewrite("nodes", own("nodes"), lambda d: swap(swap(d, "memory_id", moved), "_id", nodes))
    rewrite("source_maps", own("source_maps"), lambda d: swap(swap(d, "memory_id", moved), "_id", maps))
    for name in ("text_features", "text_stems", "vector_features"):
        rewrite(name, own(name), lambda d: swap(swap(d, "memory_id", moved), "source_map_id", maps))
    edges = s.table("edges")
    ends = edges.join(nodes.select(F.col("was").alias("from_node_id")), "from_node_id", "left_semi").unionByName(edges.join(nodes.select(F.col("was").alias("to_node_id")), "to_node_id", "left_semi")).dropDuplicates(["_id"])
    rewrite("edges", ends, lambda d: swap(swap(d, "from_node_id", nodes), "to_node_id", nodes))
    rewrite("node_label_assignments", s.table("node_label_assignments").join(nodes.select(F.col("was").alias("node_id")), "node_id", "left_semi"), lambda d: swap(d, "node_id", nodes))
    rewrite("memory_scopes", own("memory_scopes"), lambda d: swap(d, "memory_id", moved).withColumn("scope_id", renamed("scope_id", old, new, recursive)))
    rewrite("namespace_metadata", s.table("namespace_metadata").where(hit), lambda d: d.withColumn("namespace", renamed("namespace", old, new, recursive)))
    _namespace_event(c, "RENAME_NAMESPACE", now_ms, **{"from": old, "to": new, "recursive": recursive})
    c.commit()
