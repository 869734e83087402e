"""The model's tables as views over a data directory, in Spark and as SQL.

Memos, vectors, provenance and outbox are the store's own tables, each row once. Chunks are the documents. The property
graph comes from the order tables: regions, nations, customers, suppliers and orders are nodes, their keys are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.functions.ids import stable_id
from stratamem.sources.tables import table


def memos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_rows").dropDuplicates(["_id"]).withColumnRenamed("_id", "memory_id")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """id, memory_id, namespace, key, text, kinds, ts of every document with a text."""
    key = F.coalesce("memory_key", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    kinds = F.array_sort(F.array_compact(F.array(F.lower("lang"), F.col("source"))))
    return table(spark, d, "documents").where("text IS NOT NULL").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), stable_id("mem", "namespace", key).alias("memory_id"), "namespace", key.alias("key"), "text", kinds.alias("kinds"),
        F.unix_millis(F.col("created_at").cast("timestamp")).cast("double").alias("_ts_created"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, memory_id, vector: each source map once."""
    return table(spark, d, "vector_features").dropDuplicates(["source_map_id"]).select(F.col("source_map_id").alias("id"), "memory_id", "vector")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """id, memory_id, namespace, vector, label of the 64-component vectors."""
    id_ = F.concat(F.lit("v-"), F.col("vec_id").cast("string"))
    return table(spark, d, "embeddings").select(id_.alias("id"), id_.alias("memory_id"), F.concat(F.lit("vec/label"), F.col("label").cast("string")).alias("namespace"), F.col("embedding").alias("vector"), F.col("label"))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, memory_id, namespace, kinds, _ts_created, vector: a vector for each chunk, that of the document's number modulo their number."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    n = e.agg(F.count("*").alias("n")).scalar()
    c = chunks(spark, d).withColumn("v", F.pmod(F.substring("id", 5, 20).cast("long"), n))
    return c.join(e, "v").select("id", "memory_id", "namespace", "kinds", "_ts_created", "vector")


def chunk_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """(memory_id, neighbour_id), both ways: the memos of chunks of one namespace in the same hundred of numbers."""
    c = chunks(spark, d).select("namespace", F.floor(F.substring("id", 5, 20).cast("long") / 100).alias("hundred"), "memory_id")
    p = c.join(c.withColumnRenamed("memory_id", "neighbour_id"), ["namespace", "hundred"])
    return p.where("memory_id <> neighbour_id").select("memory_id", "neighbour_id").distinct()


_NODES = (("region", "geo/region", "r_regionkey", None), ("nation", "geo/nation", "n_nationkey", None), ("customer", "crm/customer", "c_custkey", "c_acctbal < 0"), ("supplier", "crm/supplier", "s_suppkey", "s_acctbal < 0"), ("orders", "sales/orders", "o_orderkey", None))
_EDGES = (("nation", "geo/nation", "n_nationkey", "geo/region", "n_regionkey", "includes"), ("customer", "crm/customer", "c_custkey", "geo/nation", "c_nationkey", "references"), ("supplier", "crm/supplier", "s_suppkey", "geo/nation", "s_nationkey", "references"), ("orders", "sales/orders", "o_orderkey", "crm/customer", "o_custkey", "affects"))


def _id(ns: str, key: str):
    return F.concat(F.lit(ns + "/"), F.col(key).cast("string"))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes (memory_id, namespace, key, suppressed), edges (edge_id, from_id, to_id), node labels (memory_id, kind), edge
    labels (edge_id, kind)."""
    nodes = edges = None
    for t, ns, key, off in _NODES:
        rows = table(spark, d, t).select(_id(ns, key).alias("memory_id"), F.lit(ns).alias("namespace"), F.col(key).cast("string").alias("key"), (F.expr(off) if off else F.lit(False)).alias("suppressed"), F.lit(t).alias("kind"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
    for t, a, ka, b, kb, kind in _EDGES:
        rows = table(spark, d, t).select(_id(a, ka).alias("from_id"), _id(b, kb).alias("to_id"), F.lit(kind).alias("kind"))
        edges = rows if edges is None else edges.unionByName(rows)
    edges = edges.withColumn("edge_id", F.concat("from_id", F.lit(">"), "to_id"))
    return nodes.drop("kind"), edges.select("edge_id", "from_id", "to_id"), nodes.select("memory_id", "kind"), edges.select("edge_id", "kind")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """namespace, alias, description, suppressed: one row per top namespace of the memos."""
    top = memos(spark, d).select(F.split("namespace", "/")[0].alias("namespace")).distinct()
    return top.select("namespace", F.initcap("namespace").alias("alias"), F.concat(F.lit("Notes about "), "namespace").alias("description"), F.col("namespace").isin("legal", "orbit").alias("suppressed"))


def scope_edges(spark: SparkSession, d: str) -> DataFrame:
    """parent, child: region over nation, nation over market segment."""
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    up = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))  # region: five rows
    down = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("parent"), F.concat("n_name", F.lit("/"), "c_mktsegment").alias("child")).distinct()
    return up.union(down)


def _n(col: str) -> str:
    return f"regexp_replace(lower(trim({col}, E' \\t\\n')), '^0x', '')"


SQL = {
    "memos": "memos AS (SELECT DISTINCT namespace, key, kind, edge_id, suppressed, _id AS memory_id, _ts_created FROM memory_rows)",
    "chunks": """chunks AS (SELECT 'doc-' || doc_id AS id, namespace, coalesce(memory_key, 'doc-' || doc_id) AS key, text, lower(lang) AS lang, source,
      'mem_' || substr(sha256('mem' || chr(0) || namespace || chr(0) || coalesce(memory_key, 'doc-' || doc_id)), 1, 24) AS memory_id, CAST(epoch_ms(created_at) AS DOUBLE) AS _ts_created
      FROM documents WHERE text IS NOT NULL)""",
    "vectors": "vectors AS (SELECT DISTINCT source_map_id AS id, memory_id, vector FROM vector_features)",
    "embeds": "embeds AS (SELECT 'v-' || vec_id AS id, 'vec/label' || label AS namespace, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)",
    "chunk_vectors": "cvec AS (SELECT c.id, c.memory_id, c.namespace, c.lang, c.source, c._ts_created, e.vector FROM chunks c JOIN embeds e ON e.id = 'v-' || (CAST(substr(c.id, 5) AS BIGINT) % (SELECT count(*) FROM embeds)))",
    "chunk_neighbours": "cnext AS (SELECT DISTINCT a.memory_id, b.memory_id AS neighbour_id FROM chunks a JOIN chunks b ON a.namespace = b.namespace AND CAST(substr(a.id, 5) AS BIGINT) // 100 = CAST(substr(b.id, 5) AS BIGINT) // 100 WHERE a.memory_id <> b.memory_id)",
    "nodes": "nodes_ AS (" + " UNION ALL ".join(f"SELECT '{ns}/' || {k} AS memory_id, '{ns}' AS namespace, CAST({k} AS VARCHAR) AS key, {off or 'false'} AS suppressed, '{t}' AS kind FROM {t}" for t, ns, k, off in _NODES) + ")",
    "edges": "edges_ AS (" + " UNION ALL ".join(f"SELECT '{a}/' || {ka} || '>{b}/' || {kb} AS edge_id, '{a}/' || {ka} AS from_id, '{b}/' || {kb} AS to_id, '{kind}' AS kind FROM {t}" for t, a, ka, b, kb, kind in _EDGES) + ")",
    "metadata": "metadata AS (SELECT DISTINCT string_split(namespace, '/')[1] AS namespace, upper(substr(string_split(namespace, '/')[1], 1, 1)) || substr(string_split(namespace, '/')[1], 2) AS alias, 'Notes about ' || string_split(namespace, '/')[1] AS description, string_split(namespace, '/')[1] IN ('legal', 'orbit') AS suppressed FROM memory_rows)",
    "scopes": "scopes AS (SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name, n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "log": f"log AS (SELECT DISTINCT {_n('root_hex')} AS root, {_n('parent_root_hex')} AS parent, event_type, event_json, _id, _ts_created FROM memory_provenance)",
}


def sql(*views: str, recursive: bool = False) -> str:
    """A WITH clause of the named views, to be followed by the query."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[v] for v in views)
