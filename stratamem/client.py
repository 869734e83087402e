"""One store's memos as an API: search, graph reads, namespaces, history and writes over `sources.store.Store`.

Everything returns a DataFrame and stays lazy, so results compose; the query texts and vectors come from the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.operators import graph as G
from stratamem.operators import namespaces as N
from stratamem.operators import predicates as P
from stratamem.operators import replay as R
from stratamem.operators import retrieval as Q
from stratamem.schema import DEFAULT_TOP_K, SYSTEM_PREFIX
from stratamem.sources.store import Store


class Memos:
    def __init__(self, store: Store):
        self.store = store

    # -- tables as the operators expect them
    def memos(self) -> DataFrame:
        return self.store.table("memos").withColumnRenamed("_id", "memory_id")

    def metadata(self) -> DataFrame:
        return self.store.table("namespace_metadata").withColumnRenamed("display_name", "alias")

    def nodes(self) -> DataFrame:
        return self.store.table("nodes").select("memory_id", F.col("_id").alias("node_id"), "properties").join(self.memos().select("memory_id", "namespace", "key", "suppressed"), "memory_id")

    def edges(self) -> DataFrame:
        at = self.store.table("nodes").select(F.col("_id").alias("n"), F.col("memory_id").alias("m"))
        e = self.store.table("edges").select(F.col("_id").alias("edge_id"), "from_node_id", "to_node_id", "properties")
        e = e.join(at.select(F.col("n").alias("from_node_id"), F.col("m").alias("from_id")), "from_node_id").join(at.select(F.col("n").alias("to_node_id"), F.col("m").alias("to_id")), "to_node_id")
        return e.select("edge_id", "from_id", "to_id", "properties", F.coalesce(F.get_json_object("properties", "$.directed") == "true", F.lit(False)).alias("directed"))

    def node_labels(self) -> DataFrame:
        a, c = self.store.table("node_label_assignments"), self.store.table("node_labels").select(F.col("_id").alias("label_id"), "kind")
        return a.join(c, "label_id").join(self.nodes().select("node_id", "memory_id"), "node_id").select("memory_id", "kind", "props")

    def edge_labels(self) -> DataFrame:
        a, c = self.store.table("edge_label_assignments"), self.store.table("edge_labels").select(F.col("_id").alias("label_id"), "kind")
        return a.join(c, "label_id").select("edge_id", "kind", "props")

    def chunks(self, system: bool = True) -> DataFrame:
        """id, memory_id, source_key, namespace, key, text, stems, kinds, created of every source map with a text."""
        maps = self.store.table("source_maps").select(F.col("_id").alias("id"), "memory_id", "source_key")
        maps = maps if system else maps.where(~F.col("source_key").startswith(SYSTEM_PREFIX))
        texts = self.store.table("text_features").select(F.col("source_map_id").alias("id"), "text")
        texts = texts.join(self.store.table("text_stems").select(F.col("source_map_id").alias("id"), "stems"), "id")
        rows = maps.join(texts, "id").join(self.memos().select("memory_id", "namespace", "key", "_ts_created"), "memory_id")
        return G.with_kinds(rows, self.node_labels(), "memory_id")

    def vectors(self) -> DataFrame:
        v = self.store.table("vector_features").select(F.col("source_map_id").alias("id"), "memory_id", "vector")
        return v.join(self.memos().select("memory_id", "namespace"), "memory_id")

    # -- reads
    def scope(self, namespaces: list[str] | None, mode: str = "subtree", suppressed: bool = False, as_of: dict | None = None, memory_ids: list[str] | None = None) -> DataFrame:
        """The memory_ids a search may see. Modes: subtree, exact (scopes), dag (scopes and what they reach); None: all."""
        m = self.memos() if suppressed else P.visible(self.memos(), self.metadata(), self.edges())
        if namespaces is not None:
            attached = self.store.table("memory_scopes")
            m = P.path_subtree(m, namespaces) if mode == "subtree" else P.exact_scope(m, attached, namespaces) if mode == "exact" else P.scope_dag(m, attached, self.store.table("scope_closure"), namespaces)
        if as_of:
            m = m.where(P.as_of(**as_of))
        return (m if memory_ids is None else m.where(F.col("memory_id").isin(memory_ids))).select("memory_id")

    def search(self, text: str | None = None, vector: list[float] | None = None, namespaces: list[str] | None = None, mode: str = "subtree", top_k: int = DEFAULT_TOP_K, as_of: dict | None = None, suppressed: bool = False,
               memory_ids: list[str] | None = None, neighbours: bool | dict = False, **options) -> DataFrame:
        """Hits with their memory: id, score, memory_id, kinds, namespace, key, source_key, text, and with neighbours (True, or the
        constraint of `neighbours`) those that match the query. memory_ids: only these memos may be seen. An edge memory's neighbours are its ends."""
        if namespaces is not None:
            namespaces = P.namespaces_of(None, namespaces)
        near = None
        if neighbours is not False:
            ends = self.edge_ends()
            near = G.constrained(G.neighbours(self.edges()), self.memos(), self.edge_labels(), self.node_labels(), **(neighbours if isinstance(neighbours, dict) else {})).select("memory_id", "neighbour_id").union(ends)
        scope = self.scope(namespaces, mode, suppressed, as_of, memory_ids)
        hits = Q.hybrid_search(self.chunks(), self.vectors(), text=text, vector=vector, top_k=top_k, scope=scope, words="stems", neighbours=near, **options)
        return self.hydrate(hits)

    def edge_ends(self) -> DataFrame:
        """(memory_id, neighbour_id): each edge memory and the memos its edge joins."""
        own = self.memos().where("edge_id IS NOT NULL").select("memory_id", "edge_id")
        return own.join(self.edges(), "edge_id").select("memory_id", F.explode(F.array("from_id", "to_id")).alias("neighbour_id"))

    def standard_search(self, text: str | None = None, vector: list[float] | None = None, namespaces: list[str] | None = None, root: str | None = None, **options) -> DataFrame:
        """The search with the defaults of an assistant: 12 hits, no neighbours, of memos created up to the time of an event (the last one)."""
        log = self.log()
        at = (R.head(log) if root is None else log.where(F.col("root") == root)).select("_ts_created").limit(1).collect()
        return self.search(text, vector, namespaces, **({"top_k": 12, "as_of": {"lte": at[0][0]} if at else None} | options)).select("id", "score", "memory_id", "namespace", "key", "source_key", "text")

    # -- single things
    def find(self, namespace: str, key: str) -> DataFrame:
        """memory_id, kind, node_id or edge_id of a memory by its name."""
        m = self.memos().where((F.col("namespace") == namespace) & (F.col("key") == key)).select("memory_id", "kind", "edge_id")
        return m.join(self.store.table("nodes").select("memory_id", F.col("_id").alias("node_id")), "memory_id", "left")

    def source_maps(self, memory_id: str, newest: int) -> DataFrame:
        """The newest source maps of a memory."""
        if newest <= 0:
            raise ValueError("a positive number of source maps")
        return self.store.table("source_maps").where(F.col("memory_id") == memory_id).orderBy(F.desc("_ts_created"), "_id").limit(newest)

    def of_source_map(self, source_map_id: str) -> DataFrame:
        """memory_id, namespace, key, source_key, vector of a source map."""
        m = self.store.table("source_maps").where(F.col("_id") == source_map_id).select("memory_id", "source_key", F.col("_id").alias("id"))
        return m.join(self.memos().select("memory_id", "namespace", "key"), "memory_id").join(self.store.table("vector_features").select(F.col("source_map_id").alias("id"), "vector"), "id", "left")

    def edge(self, edge_id: str) -> DataFrame:
        """One edge with its ends and kinds; none if an end is suppressed."""
        return G.edges_of(self.edges().where(F.col("edge_id") == edge_id), self.nodes(), self.edge_labels())

    def suppressed_keys(self, namespace: str) -> DataFrame:
        return self.memos().where((F.col("namespace") == namespace) & F.col("suppressed")).select("key")

    def hydrate(self, hits: DataFrame) -> DataFrame:
        """Hits (id, score, ...) with what they stand for, best first; unknown ids are dropped."""
        rows = hits.drop("namespace").join(self.chunks().select("id", "namespace", "key", "source_key", "text"), "id")
        return rows.orderBy(F.desc("score"), "id")

    def neighbours(self, namespace: str, key: str, **constraint) -> DataFrame:
        one = self.memos().where((F.col("namespace") == namespace) & (F.col("key") == key)).select("memory_id")
        return G.constrained(G.neighbours(self.edges()), self.memos(), self.edge_labels(), self.node_labels(), **constraint).join(one, "memory_id", "left_semi")

    def graph(self, namespace: Column | None = None) -> DataFrame:
        return G.edges_of(self.edges(), self.nodes(), self.edge_labels(), namespace)

    def stats(self) -> DataFrame:
        return G.stats(self.nodes(), self.edges(), P.hidden_namespaces(self.memos(), self.metadata()))

    def texts(self) -> DataFrame:
        """memory_id and its texts, in order of time, joined by blank lines; system chunks are left out."""
        t = self.store.table("text_features").join(self.chunks(system=False).select(F.col("id").alias("source_map_id")), "source_map_id", "left_semi")
        parts = t.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("_ts_created", "_id", "text"))).alias("p"))
        return parts.select("memory_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))

    def catalog(self) -> DataFrame:
        return N.catalog(self.memos(), self.metadata())

    def search_namespaces(self, text: str, limit: int = N.DEFAULT_LIMIT, under: str | None = None) -> DataFrame:
        """Namespaces by their matching memos and by their metadata, fused: namespace, score."""
        hits = self.search(text, top_k=50).select("namespace", F.col("key").alias("memory_key"), "score")
        content = N.rank(hits, root=under, limit=N.MAX_LIMIT)
        meta = N.by_metadata(self.catalog() if under is None else N.under_prefix(self.catalog(), under, True), text)
        arms = [Q.Arm("nodes", Q.ranked(content, "namespace", F.desc("score"), "namespace", limit=N.MAX_LIMIT)), Q.Arm("metadata", Q.ranked(meta, "namespace", F.desc("score"), "namespace", limit=N.MAX_LIMIT))]
        return Q.fuse(arms).orderBy(F.desc("score"), "id").limit(limit).select(F.col("id").alias("namespace"), "score")

    # -- history
    def log(self) -> DataFrame:
        return R.log(self.store.table("memory_provenance"))

    def state_at(self, facet: str, root: str | None = None) -> DataFrame:
        """The fields of a facet after the event `root`; now without one. An unknown root has no state."""
        log = self.log()
        seen = log if root is None else log.where(F.col("at") <= log.where(F.col("root") == root).agg(F.max("at").alias("at")).scalar())
        place = seen.select(F.col("root").alias("root_hex"), "_ts_created", F.col("_id").alias("pid"))
        outbox = self.store.table("memory_tip_outbox").drop("_ts_created").join(place, "root_hex")
        order = seen.groupBy("root").agg(F.max(F.struct("_ts_created", "_id")).alias("o"))
        changed = R.changes_at(outbox, facet).join(order, "root").withColumn("root_", F.col("root")).withColumn("root", F.concat(F.col("o._id"), F.lit("|"), F.col("root")))
        live = R.state(changed, facet)
        return live.withColumn("root", F.element_at(F.split("root", r"\|"), -1))

    def event_at(self, root: str) -> DataFrame:
        return self.log().where(F.col("root") == root).select("event_type", "event_json")
