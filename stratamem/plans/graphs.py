"""Queries over the property graph, the vectors of memos, duplicates and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.functions.ids import database_id, stable_id, body_hash
from stratamem.functions.paths import lineage
from stratamem.functions import text as TX
from stratamem.functions.text import preview, tokens
from stratamem.functions.vectors import label_features, mean_pool, property_features, sketch
from stratamem.operators import dedup as D
from stratamem.operators import graph as G
from stratamem.operators import links as L
from stratamem.plans import views as V
from stratamem.sources.files import text_chunks
from stratamem.sources.tables import keep, normal, table


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


def _kinds(df: DataFrame) -> DataFrame:
    return df.withColumn("kinds", F.array_join("kinds", ","))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, _, el = V.graph(spark, d)
    return _kinds(G.edges_of(edges, nodes, el, F.col("namespace") == "geo/nation")).select("edge_id", "from_key", "to_key", "kinds")


def incident_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, _, el = V.graph(spark, d)
    rows = G.edges_of(edges, nodes, el)
    return _kinds(rows.where("(from_ns = 'geo/nation' AND from_key = '3') OR (to_ns = 'geo/nation' AND to_key = '3')")).select("edge_id", "kinds")


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, _, _ = V.graph(spark, d)
    return G.stats(nodes, edges)


def graph_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return G.roll_up(graph_stats(spark, d), lineage("namespace"))


def label_hist_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.histogram(V.graph(spark, d)[2], "memory_id")


def label_hist_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.histogram(V.graph(spark, d)[3], "edge_id")


def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, _, _ = V.graph(spark, d)
    return _round(G.centrality(edges, nodes), "centrality")


def neighbor_filter_direction(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, nl, el = V.graph(spark, d)
    return G.constrained(G.neighbours(edges), nodes, el, nl, edge_kind="references", direction="in", some=["customer", "supplier"]).select("memory_id", "neighbour_id")


def neighbor_cap(spark: SparkSession, d: str) -> DataFrame:
    return G.capped(G.neighbours(V.graph(spark, d)[1]), 3).select("memory_id", "neighbour_id", "direction", "rank")


def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of an edge memory: both of its ends, each from the other."""
    edges = V.graph(spark, d)[1]
    return G.neighbours(edges).select("edge_id", "memory_id", "neighbour_id")


def search_meta_text(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, nl, el = V.graph(spark, d)
    text = G.meta_text(edges, nodes, nl, el)
    return text.select("memory_id", F.sha2("text", 256).alias("hash"), F.length("text").alias("n"))


def layout_members(spark: SparkSession, d: str) -> DataFrame:
    """What is drawn: ends of edges, and nodes with properties or vectors."""
    edges = V.graph(spark, d)[1]
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    nodes = table(spark, d, "nodes").where("properties IS NOT NULL").select(normal("memory_id").alias("id")).where("id <> ''")
    return ends.union(nodes).union(V.vectors(spark, d).where("size(vector) > 0").select("memory_id")).distinct()


def layout_fibonacci(spark: SparkSession, d: str) -> DataFrame:
    ids = V.memos(spark, d).select("memory_id")
    return _round(L.fibonacci_sphere(ids, "memory_id"), "x", "y", "z")


def layout_pca(spark: SparkSession, d: str) -> DataFrame:
    return L.pca3(V.embeddings(spark, d), "id")


def _sketched():
    """The sketch of a node with one label of no properties, and its own."""
    s = sketch(F.concat(label_features(F.lit("memory"), F.lit(None).cast("string")), property_features(F.lit("prop:"), F.col("properties"))))
    return F.array_join(F.transform(s, lambda x: F.format_string("%.6f", x + F.lit(0.0))), " ")


def layout_sketch(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").dropDuplicates(["_id"])
    return n.select("_id", _sketched().alias("sketch"))


def props_text(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes").dropDuplicates(["_id"])
    return n.select("_id", TX.props_text(F.lit("memory"), "properties").alias("text"))


def mean_pool_by_label(spark: SparkSession, d: str) -> DataFrame:
    rows = mean_pool(V.embeddings(spark, d), "label", "vector")
    return _round(rows.select("label", F.posexplode("mean").alias("i", "mean")), "mean")


def mean_pool_memos(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each memory over its usable source maps, as its length, count and norm."""
    v = V.vectors(spark, d).where("size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30)")
    m = mean_pool(v, "memory_id", "vector")
    return _round(m.select("memory_id", F.size("mean").alias("dim"), "n", F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")), "norm")


def vector_dims(spark: SparkSession, d: str) -> DataFrame:
    return V.vectors(spark, d).where("vector IS NOT NULL").groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))


def inventory_flags(spark: SparkSession, d: str) -> DataFrame:
    """Of each memory: source maps with a vector, and documents with a text."""
    v = V.vectors(spark, d).groupBy("memory_id").agg(F.count_if(F.size("vector") > 0).alias("with_vector"), F.count("*").alias("maps"))
    docs = table(spark, d, "documents").where("text IS NOT NULL").groupBy("namespace", F.col("memory_key").alias("key")).agg(F.count("*").alias("texts"))
    m = V.memos(spark, d).select("memory_id", "namespace", "key").join(v, "memory_id", "left").join(docs, ["namespace", "key"], "left")
    return m.select("memory_id", F.coalesce("with_vector", F.lit(0)).alias("with_vector"), F.coalesce("maps", F.lit(0)).alias("maps"), F.coalesce(F.col("texts") > 0, F.lit(False)).alias("has_text"))


def text_export(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).select("memory_id", F.col("id").alias("source_key"), F.sha2("text", 256).alias("text_hash"))


def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).select("id", preview("text", 240).alias("preview"))


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    rows = text_chunks(V.chunks(spark, d).select("id", "text"), "text", limit=500)
    return rows.select("id", "source_key", F.sha2("text", 256).alias("hash"), F.length("text").alias("n"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return V.memos(spark, d).select("memory_id", stable_id("mem", "namespace", "key").alias("stable"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).select("id", body_hash("text").alias("hash"))


def database_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "database_ontology_links").where("kind IS NOT NULL AND trim(owner_key) <> ''").select("kind", "owner_key").distinct().select("kind", "owner_key", database_id("kind", "owner_key").alias("database_id"))


def latest_links(spark: SparkSession, d: str) -> DataFrame:
    """The ontology each database is linked to last."""
    links = table(spark, d, "database_ontology_links").where("trim(owner_key) <> ''").withColumn("hash", normal("ontology_hash")).where("hash <> ''")
    return links.groupBy("kind", "owner_key").agg(F.max_by("hash", F.struct("linked_at_ms", "link_id")).alias("ontology_hash"))


def ontology_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Ontologies that have all node kinds of another one."""
    o = table(spark, d, "ontologies").select(normal("ontology_hash").alias("hash"), F.array_distinct(F.from_json("node_kinds_json", "array<string>")).alias("kinds")).dropDuplicates(["hash"])
    first = o.select(F.col("hash").alias("least"), F.explode("kinds").alias("kind"), F.size("kinds").alias("n"))
    each = o.select(F.col("hash").alias("has"), F.explode("kinds").alias("kind"))
    return first.join(each, "kind").where("least <> has").groupBy("least", "has", "n").agg(F.count("*").alias("hits")).where("hits = n").select("least", "has")


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of evaluation items whose token sets overlap by at least 0.1, by the tokens they share."""
    words = table(spark, d, "eval_items").select("item_id", F.array_distinct(tokens("text")).alias("w"))
    each = words.select("item_id", F.size("w").alias("n"), F.explode("w").alias("w"))
    other = each.select(F.col("item_id").alias("other_id"), F.col("n").alias("m"), "w")
    both = each.join(other, "w").where("item_id < other_id").groupBy("item_id", "other_id", "n", "m").agg(F.count("*").alias("b"))
    return _round(both.select("item_id", "other_id", (F.col("b") / (F.col("n") + F.col("m") - F.col("b"))).alias("jaccard")).where("jaccard >= 0.1"), "jaccard")


def _items(spark: SparkSession, d: str) -> DataFrame:
    e = V.embeddings(spark, d)
    return e.select("id", "vector", F.lit("").alias("text"), F.substring("id", 3, 20).cast("double").alias("created_at"), F.col("label").alias("cluster"))


EPSILON = 0.6


def dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.similar_pairs(_items(spark, d), EPSILON).select("a", "b")


def dedup_components(spark: SparkSession, d: str) -> DataFrame:
    return D.groups(_items(spark, d), EPSILON).select("id", "component")


def dedup_survivors(spark: SparkSession, d: str) -> DataFrame:
    return D.groups(_items(spark, d), EPSILON).where("keep").select("id", "n")


def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    return D.assign(_items(spark, d).drop("cluster")).select("id", "cluster")


def semantic_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The memos' mean vectors, one for each length a memory has vectors of, clustered and compared per length, with the
    members and survivors of duplicate groups. Texts are those of a memory's documents; a pair's must overlap (Jaccard 0.1)."""
    v = V.vectors(spark, d).where("size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30)")
    m = mean_pool(v, "memory_id", "vector", per_length=True)
    parts = table(spark, d, "documents").where("text IS NOT NULL").groupBy("namespace", F.col("memory_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("parts"))
    texts = parts.select("namespace", "key", F.array_join(F.col("parts.text"), "\n\n").alias("text"))
    about = V.memos(spark, d).select("memory_id", "namespace", "key", F.col("_ts_created").alias("created_at")).join(texts, ["namespace", "key"], "left")
    rows = keep(m.join(about, "memory_id").select(F.col("memory_id").alias("id"), F.col("mean").alias("vector"), F.coalesce("text", F.lit("")).alias("text"), "created_at", "length"), "memos")
    items = rows.withColumn("cluster", F.lit("")).where(F.lit(False))
    for n in sorted(r[0] for r in rows.select("length").distinct().collect()):  # few lengths
        own = D.assign(rows.where(F.col("length") == n), kept=True)
        items = items.unionByName(own.withColumn("cluster", F.concat_ws("/", "length", "cluster")))
    return D.groups(items.drop("length"), 0.2)


QUERIES = {f.__name__: f for f in (
    graph_edges, incident_edges, graph_stats, graph_roll_up, label_hist_nodes, label_hist_edges, degree_centrality, neighbor_filter_direction, neighbor_cap, edge_endpoints, search_meta_text,
    layout_members, layout_fibonacci, layout_pca, layout_sketch, props_text, mean_pool_by_label, mean_pool_memos, vector_dims, inventory_flags, text_export, text_preview, chunk_text, stable_ids, content_hash,
    database_ids, latest_links, ontology_kinds, jaccard_pairs, dedup_pairs, dedup_components, dedup_survivors, kmeans_assign, semantic_dedup)}

_G = V.sql("nodes", "edges")
_SEEN = f"{_G}, seen AS (SELECT e.*, a.namespace AS from_ns, a.key AS from_key, b.namespace AS to_ns, b.key AS to_key FROM edges_ e JOIN nodes_ a ON a.memory_id = from_id JOIN nodes_ b ON b.memory_id = to_id WHERE NOT a.suppressed AND NOT b.suppressed)"
_STATS = f"""{_G},
ends AS (SELECT DISTINCT e.edge_id, n.namespace, n.suppressed FROM edges_ e JOIN nodes_ n ON n.memory_id IN (e.from_id, e.to_id)),
off AS (SELECT edge_id, bool_or(suppressed) AS off FROM ends GROUP BY 1),
pe AS (SELECT namespace, count(DISTINCT edge_id) FILTER (NOT off) AS edges, count(DISTINCT edge_id) FILTER (off) AS suppressed_edges FROM (SELECT DISTINCT edge_id, namespace FROM ends) JOIN off USING (edge_id) GROUP BY 1),
pn AS (SELECT namespace, count(*) FILTER (NOT suppressed) AS nodes, count(*) FILTER (suppressed) AS suppressed_nodes FROM nodes_ GROUP BY 1),
st AS (SELECT namespace, nodes, suppressed_nodes, coalesce(edges, 0) AS edges, coalesce(suppressed_edges, 0) AS suppressed_edges FROM pn LEFT JOIN pe USING (namespace))"""
_NB = ", nb AS (SELECT from_id AS memory_id, to_id AS neighbour_id, edge_id, 'out' AS direction, kind FROM edges_ UNION ALL SELECT to_id, from_id, edge_id, 'in', kind FROM edges_ WHERE from_id <> to_id)"
_PAIRS = f"""{V.sql('embeds', recursive=True)},
unit AS (SELECT id, label, vector, sqrt(list_dot_product(vector, vector)) AS n FROM embeds),
pairs AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM unit x JOIN unit y ON x.label = y.label AND x.id < y.id WHERE list_dot_product(x.vector, y.vector) / (x.n * y.n) >= 1 - {EPSILON})"""
_COMP = """,
both_ AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT x, x AS y FROM both_ UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON r.y = b.x),
comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY 1)"""
_USABLE = "len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OBJECT = "CASE WHEN json_valid(properties) AND json_type(properties) = 'OBJECT' THEN CAST(properties AS JSON) END"
_FNV = lambda c: f"list_reduce(list_transform(string_split({c}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))"

SQL = {
    "props_text": f"""WITH n AS (SELECT DISTINCT _id, {_OBJECT} AS p FROM nodes),
lines AS (SELECT _id, list_transform(list_sort(coalesce(json_keys(p), [])), lambda k: replace(k, '_', ' ') || ': ' || json_extract_string(p, '$."' || k || '"')) AS lines FROM n)
SELECT _id, CASE WHEN len(lines) > 0 THEN 'Kind: memory' || chr(10) || array_to_string(lines, chr(10)) ELSE '' END AS text FROM lines""",
    "layout_sketch": f"""WITH n AS (SELECT DISTINCT _id, {_OBJECT} AS p FROM nodes),
feat AS (SELECT _id, unnest(['label:memory'] || list_transform(coalesce(json_keys(p), []), lambda k: 'prop:' || k || '=' || json_extract(p, '$."' || k || '"')::VARCHAR)) AS f FROM n),
hashed AS (SELECT _id, {_FNV("f")} AS a, {_FNV("f || chr(0) || '#'")} AS b FROM feat),
places AS (SELECT _id, a % 32 AS i, CASE a % 2 WHEN 0 THEN 1.0::DOUBLE ELSE -1.0 END / sqrt(32) AS x FROM hashed UNION ALL SELECT _id, b % 32, CASE b % 2 WHEN 0 THEN 0.5::DOUBLE ELSE -0.5 END / sqrt(32) FROM hashed WHERE a % 32 <> b % 32),
summed AS (SELECT _id, i, sum(x) AS x FROM places GROUP BY 1, 2), len AS (SELECT _id, sqrt(sum(x * x)) AS n FROM summed GROUP BY 1)
SELECT l._id, string_agg(printf('%.6f', coalesce(s.x / nullif(l.n, 0), 0) + 0.0), ' ' ORDER BY r.i) AS sketch FROM len l CROSS JOIN range(32) r(i) LEFT JOIN summed s ON s._id = l._id AND s.i = r.i GROUP BY 1""",
    "graph_edges": f"{_SEEN} SELECT edge_id, from_key, to_key, kind AS kinds FROM seen WHERE 'geo/nation' IN (from_ns, to_ns)",
    "incident_edges": f"{_SEEN} SELECT edge_id, kind AS kinds FROM seen WHERE (from_ns = 'geo/nation' AND from_key = '3') OR (to_ns = 'geo/nation' AND to_key = '3')",
    "graph_stats": f"{_STATS} SELECT * FROM st",
    "graph_roll_up": f"{_STATS}, up AS (SELECT unnest([string_split(namespace, '/')[1], namespace]) AS p, * FROM st) SELECT p AS namespace, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(suppressed_nodes) AS BIGINT) AS suppressed_nodes, CAST(sum(edges) AS BIGINT) AS edges, CAST(sum(suppressed_edges) AS BIGINT) AS suppressed_edges FROM up GROUP BY 1",
    "label_hist_nodes": f"{_G} SELECT kind, count(DISTINCT memory_id) AS n FROM nodes_ GROUP BY 1",
    "label_hist_edges": f"{_G} SELECT kind, count(DISTINCT edge_id) AS n FROM edges_ GROUP BY 1",
    "degree_centrality": f"{_G}, deg AS (SELECT n.memory_id, count(e.edge_id) AS degree FROM nodes_ n LEFT JOIN (SELECT edge_id, from_id AS m FROM edges_ UNION SELECT edge_id, to_id FROM edges_) e ON e.m = n.memory_id GROUP BY 1) SELECT memory_id, degree, round(degree / (SELECT max(degree) FROM deg)::DOUBLE, 6) + 0.0 AS centrality FROM deg",
    "neighbor_filter_direction": f"{_G}{_NB} SELECT nb.memory_id, neighbour_id FROM nb JOIN nodes_ n ON n.memory_id = neighbour_id WHERE nb.kind = 'references' AND direction = 'in' AND n.kind IN ('customer', 'supplier') AND NOT n.suppressed",
    "neighbor_cap": f"{_G}{_NB} SELECT memory_id, neighbour_id, direction, CAST(row_number() OVER (PARTITION BY memory_id ORDER BY neighbour_id, edge_id) AS INT) AS rank FROM nb QUALIFY rank <= 3",
    "edge_endpoints": f"{_G}{_NB} SELECT edge_id, memory_id, neighbour_id FROM nb",
    "search_meta_text": f"""{_G}{_NB},
per AS (SELECT nb.memory_id, n.key, direction, string_agg(DISTINCT nb.kind, '|' ORDER BY nb.kind) AS kinds FROM nb JOIN nodes_ n ON n.memory_id = neighbour_id GROUP BY 1, 2, 3, nb.neighbour_id),
lines AS (SELECT memory_id, 'node:' || kind AS line FROM nodes_ UNION SELECT memory_id, 'edge ' || direction || ':' || key || ':' || kinds FROM per),
texts AS (SELECT memory_id, string_agg(line, chr(10) ORDER BY line) AS text FROM lines GROUP BY 1)
SELECT memory_id, sha256(text) AS hash, CAST(length(text) AS INT) AS n FROM texts""",
    "layout_members": f"{V.sql('edges', 'vectors')} SELECT from_id AS id FROM edges_ UNION SELECT to_id FROM edges_ UNION SELECT {V._n('memory_id')} FROM nodes WHERE properties IS NOT NULL AND {V._n('memory_id')} <> '' UNION SELECT memory_id FROM vectors WHERE len(vector) > 0",
    "layout_fibonacci": f"""{V.sql('memos')}, places AS (SELECT memory_id, row_number() OVER (ORDER BY memory_id) - 1 AS i, count(*) OVER () AS n FROM memos),
raw AS (SELECT memory_id, 1 - (i + 0.5::DOUBLE) / n * 2 AS y, i * (pi() * (3 - sqrt(5))) AS phi FROM places),
p AS (SELECT memory_id, cos(phi) * sqrt(greatest(0, 1 - y * y)) AS x, y, sin(phi) * sqrt(greatest(0, 1 - y * y)) AS z FROM raw)
SELECT memory_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 2 - 1, 6) + 0.0 AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 2 - 1, 6) + 0.0 AS y,
  round((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) * 2 - 1, 6) + 0.0 AS z FROM p""",
    "mean_pool_by_label": f"{V.sql('embeds')} SELECT label, CAST(i - 1 AS INT) AS i, round(avg(vector[i]), 6) + 0.0 AS mean FROM embeds, range(1, 65) r(i) GROUP BY 1, 2",
    "mean_pool_memos": f"""{V.sql('vectors')}, u AS (SELECT * FROM vectors WHERE {_USABLE}), l AS (SELECT memory_id, min(len(vector)) AS dim FROM u GROUP BY 1),
parts AS (SELECT memory_id, dim, unnest(CAST(vector AS DOUBLE[])) AS x, unnest(range(len(vector))) AS i FROM u JOIN l USING (memory_id) WHERE len(vector) = dim),
m AS (SELECT memory_id, dim, i, avg(x) AS m, count(*) AS n FROM parts GROUP BY 1, 2, 3) SELECT memory_id, CAST(dim AS INT) AS dim, max(n) AS n, round(sqrt(sum(m * m)), 6) + 0.0 AS norm FROM m GROUP BY 1, 2""",
    "vector_dims": f"{V.sql('vectors')} SELECT CAST(len(vector) AS INT) AS dim, count(*) AS n FROM vectors WHERE vector IS NOT NULL GROUP BY 1",
    "inventory_flags": f"{V.sql('memos', 'vectors')} SELECT m.memory_id, count(v.id) FILTER (len(v.vector) > 0) AS with_vector, count(v.id) AS maps, EXISTS (SELECT 1 FROM documents x WHERE x.namespace = m.namespace AND x.memory_key = m.key AND x.text IS NOT NULL) AS has_text FROM memos m LEFT JOIN vectors v USING (memory_id) GROUP BY m.memory_id, m.namespace, m.key",
    "text_export": f"{V.sql('chunks')} SELECT memory_id, id AS source_key, sha256(text) AS text_hash FROM chunks",
    "text_preview": f"{V.sql('chunks')} SELECT id, CASE WHEN length(text) > 240 THEN substr(text, 1, 239) || '…' ELSE text END AS preview FROM chunks",
    "chunk_text": f"""{V.sql('chunks')}, paras AS (SELECT id, regexp_replace(unnest(regexp_split_to_array(replace(text, E'\\r\\n', E'\\n'), '\\n\\s*\\n+')), '^\\s+|\\s+$', '', 'g') AS p, unnest(range(len(regexp_split_to_array(replace(text, E'\\r\\n', E'\\n'), '\\n\\s*\\n+')))) AS pn FROM chunks),
cut AS (SELECT id, pn, k, substr(p, k * 500 + 1, 500) AS c FROM (SELECT *, unnest(range((length(p) - 1) // 500 + 1)) AS k FROM paras WHERE p <> ''))
SELECT id, 'chunk:' || (row_number() OVER (PARTITION BY id ORDER BY pn, k) - 1) AS source_key, sha256(c) AS hash, CAST(length(c) AS INT) AS n FROM cut""",
    "stable_ids": f"{V.sql('memos')} SELECT memory_id, 'mem_' || substr(sha256('mem' || chr(0) || namespace || chr(0) || key), 1, 24) AS stable FROM memos",
    "content_hash": f"""{V.sql('chunks')} SELECT id, sha256('STRATAMEM_SOURCE_BODY_v1' || chr(0) || '{{"text_present":true,"text_sha256":"' || sha256(text) || '","vector_dim":undefined,"vector_present":false,"vector_sha256":undefined}}') AS hash FROM chunks""",
    "database_ids": """SELECT DISTINCT kind, owner_key, rtrim(replace(replace(base64(encode('["' || kind || '","' || owner_key || '"]')), '+', '-'), '/', '_'), '=') AS database_id FROM database_ontology_links WHERE kind IS NOT NULL AND trim(owner_key) <> ''""",
    "latest_links": f"SELECT kind, owner_key, {V._n('ontology_hash')} AS ontology_hash FROM database_ontology_links WHERE trim(owner_key) <> '' AND {V._n('ontology_hash')} <> '' QUALIFY row_number() OVER (PARTITION BY kind, owner_key ORDER BY linked_at_ms DESC, link_id DESC) = 1",
    "ontology_kinds": f"WITH o AS (SELECT {V._n('ontology_hash')} AS hash, CAST(node_kinds_json AS JSON)::VARCHAR[] AS kinds FROM ontologies) SELECT DISTINCT a.hash AS least, b.hash AS has FROM o a JOIN o b ON a.hash <> b.hash AND list_has_all(b.kinds, a.kinds)",
    "jaccard_pairs": """WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM eval_items),
j AS (SELECT a.item_id, b.item_id AS other_id, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE AS j FROM w a JOIN w b ON a.item_id < b.item_id)
SELECT item_id, other_id, round(j, 6) + 0.0 AS jaccard FROM j WHERE j >= 0.1""",
    "dedup_pairs": f"{_PAIRS} SELECT a, b FROM pairs",
    "dedup_components": f"{_PAIRS}{_COMP} SELECT id, component FROM comp",
    "dedup_survivors": f"{_PAIRS}{_COMP} SELECT arg_max(id, CAST(substr(id, 3) AS INT)) AS id, count(*) AS n FROM comp GROUP BY component",
}
