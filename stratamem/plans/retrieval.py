"""Queries for ranked retrieval and the predicates of memory reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.functions.paths import lineage, path_error, renamed
from stratamem.operators import graph as G
from stratamem.operators import namespaces as NS
from stratamem.operators import predicates as P
from stratamem.operators import retrieval as R
from stratamem.operators.links import approximate_nearest_each, autolink
from stratamem.plans import views as V
from stratamem.sources.tables import table

QUERY = "budget warehouse"
ROOTS = ["support", "orbit/sales", "orbit/sales/harbour"]


def _query(df: DataFrame, id_: str) -> list[float]:
    return list(df.where(F.col("id") == id_).select("vector").first()[0])


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = V.embeddings(spark, d)
    return _round(R.nearest(e, _query(e, "v-7"), 10, "id"), "distance")


def knn_max_distance(spark: SparkSession, d: str) -> DataFrame:
    e = V.embeddings(spark, d)
    return _round(R.nearest(e, _query(e, "v-7"), 25, "id", max_distance=0.8), "distance")


def knn_scoped(spark: SparkSession, d: str) -> DataFrame:
    e = V.embeddings(spark, d)
    return _round(R.nearest(P.path_subtree(e, ["vec/label1", "vec/label3"]), _query(e, "v-7"), 10, "id"), "distance")


def knn_dim_filter(spark: SparkSession, d: str) -> DataFrame:
    v = V.vectors(spark, d)
    q = v.where("size(vector) = 768 AND forall(vector, x -> NOT isnan(x) AND abs(x) < 1e30)").orderBy("id").select("vector").first()[0]
    return _round(R.nearest(v, list(q), 10, "id"), "distance")


def _queries(df: DataFrame) -> DataFrame:
    """The query set of a search: the rows whose number is divisible by 100."""
    return df.where("CAST(substring(id, 3) AS BIGINT) % 100 = 0").select(F.col("id").alias("query_id"), "vector")


def knn_cosine_each(spark: SparkSession, d: str) -> DataFrame:
    e = V.embeddings(spark, d)
    return _round(R.nearest_each(e, _queries(e), 10, "id"), "distance")


def knn_max_distance_each(spark: SparkSession, d: str) -> DataFrame:
    e = V.embeddings(spark, d)
    return _round(R.nearest_each(e, _queries(e), 25, "id", max_distance=0.8), "distance")


def knn_scoped_each(spark: SparkSession, d: str) -> DataFrame:
    e = V.embeddings(spark, d)
    return _round(R.nearest_each(P.path_subtree(e, ["vec/label1", "vec/label3"]), _queries(e), 10, "id"), "distance")


def knn_dim_filter_each(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of every length; the number of a source map is that of its 24 hexadecimal digits."""
    v = V.vectors(spark, d)
    n = (F.conv(F.substring("id", 4, 12), 16, 10).cast("long") % 100 * 56 + F.conv(F.substring("id", 16, 12), 16, 10).cast("long")) % 100  # 16 ** 12 % 100 is 56
    return _round(R.nearest_each(v, v.where(n == 0).select(F.col("id").alias("query_id"), "vector"), 10, "id"), "distance")


def ann_lsh(spark: SparkSession, d: str) -> DataFrame:
    e = V.embeddings(spark, d)
    return approximate_nearest_each(e, _queries(e), 10, "id")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = R.bm25(V.chunks(spark, d), QUERY, stem=False)
    return _round(hits.orderBy("score", "id").limit(10).select("id", "score"), "score")


def bm25_scoped_global_idf(spark: SparkSession, d: str) -> DataFrame:
    hits = R.bm25(V.chunks(spark, d), "budget", stem=False)
    return _round(P.path_subtree(hits, ROOTS).orderBy("score", "id").limit(25).select("id", "namespace", "score"), "score")


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(V.chunks(spark, d), "merging budgets", stem=True).orderBy("score", "id").limit(25).select("id", "score")


def _arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = V.embeddings(spark, d)
    near = R.nearest(e, _query(e, "v-7"), 25, "id")
    return R.ranked(near, "id", "distance", "id", limit=25), R.ranked(e.where("label = 3"), "id", "id", limit=25)


def rrf_two_arms(spark: SparkSession, d: str) -> DataFrame:
    a, b = _arms(spark, d)
    return _round(R.fuse([R.Arm("vector", a), R.Arm("label", b)]).select("id", "score"), "score")


def rrf_weights(spark: SparkSession, d: str) -> DataFrame:
    a, b = _arms(spark, d)
    return _round(R.fuse([R.Arm("vector", a, 1.0), R.Arm("label", b, 2.0, limit=10)]).select("id", "score"), "score")


def rrf_item_boost(spark: SparkSession, d: str) -> DataFrame:
    a, b = _arms(spark, d)
    boosts = V.embeddings(spark, d).where("label = 1").select("id", F.lit(3.0).alias("boost"))
    return _round(R.fuse([R.Arm("vector", a), R.Arm("label", b)], item_boosts=boosts).select("id", "score"), "score")


def rrf_contributions(spark: SparkSession, d: str) -> DataFrame:
    a, b = _arms(spark, d)
    rows = R.fuse([R.Arm("vector", a), R.Arm("label", b)]).select("id", F.explode("contributions").alias("c"))
    return _round(rows.select("id", "c.arm", "c.rank", "c.score"), "score")


ASKED = "v-7"


def _hybrid(spark: SparkSession, d: str, **options) -> DataFrame:
    """The search operator over documents and their vectors: what is bounded by `where` is so before the arms are ranked, labels and
    min_score are asked of the fused list."""
    hits = R.hybrid_search(V.chunks(spark, d), V.chunk_vectors(spark, d), text=QUERY, vector=_query(V.embeddings(spark, d), ASKED), stem=False, **options)
    return hits if "neighbours" in options else _round(hits.select("id", "score"), "score")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


def hybrid_label_all_some(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, labels=(["en"], ["session-log", "import-ops", "agent-ops", "import-agents", "mail-ops"]))


def hybrid_min_score(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, min_score=0.014)


def hybrid_asof(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, where=P.as_of(gte=1735689600000.0, lte=1767225600000.0))


def hybrid_allowlist(spark: SparkSession, d: str) -> DataFrame:
    """Within the namespaces of a scope, with a bound on the distance, and the vector arm at half weight."""
    c = V.chunks(spark, d)
    return _hybrid(spark, d, scope=P.path_subtree(c, ROOTS).select("memory_id"), max_distance=1.0, weights=(1.0, 0.5), top_k=5)


def search_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of each hit of the search, ranked for the same query."""
    hits = _hybrid(spark, d, neighbours=V.chunk_neighbours(spark, d), max_neighbours=4)
    rows = hits.select(F.col("id").alias("hit_id"), F.inline("neighbours"))
    return _round(rows.select("hit_id", "memory_id", "id", "rank", "score"), "score")


def search_ann(spark: SparkSession, d: str) -> DataFrame:
    """The search with approximate vectors, which the method resolves to where none is asked for."""
    return _hybrid(spark, d, method=None)


def hybrid_text_and_vector(spark: SparkSession, d: str) -> DataFrame:
    """The whole search: stemmed lexical arm, and vector arm over the vectors of every length, of which the query's counts."""
    v = V.vectors(spark, d)
    q = list(v.where("size(vector) = 512 AND forall(vector, x -> NOT isnan(x) AND abs(x) < 1e30)").orderBy("id").select("vector").first()[0])
    c = V.chunks(spark, d).select("id", "memory_id", "text", "kinds")
    both = c.unionByName(v.select("id", "memory_id", F.lit(None).cast("string").alias("text"), F.array().cast("array<string>").alias("kinds")))
    return R.hybrid_search(both, v, text="merged budget", vector=q, top_k=10).select("id", F.round("score", 9).alias("score"), "memory_id")


def path_subtree(spark: SparkSession, d: str) -> DataFrame:
    return P.path_subtree(V.memos(spark, d), ROOTS).select("memory_id", "namespace")


def path_errors(spark: SparkSession, d: str) -> DataFrame:
    names = V.memos(spark, d).select("namespace").union(V.memos(spark, d).select("key")).distinct()
    return names.select(F.col("namespace").alias("path"), path_error("namespace", max_depth=2).alias("error"))


def namespace_lineage(spark: SparkSession, d: str) -> DataFrame:
    return V.memos(spark, d).select("namespace").distinct().select("namespace", F.array_join(lineage("namespace"), " ").alias("lineage"))


def rename_map(spark: SparkSession, d: str) -> DataFrame:
    return V.memos(spark, d).select("memory_id", renamed("namespace", "support", "help/desk").alias("namespace"))


def scope_closure(spark: SparkSession, d: str) -> DataFrame:
    return P.scope_closure(V.scope_edges(spark, d))


def _customer_scopes(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("memory_id"), F.concat("n_name", F.lit("/"), "c_mktsegment").alias("scope_id"))


def exact_scope(spark: SparkSession, d: str) -> DataFrame:
    members = _customer_scopes(spark, d)
    return P.exact_scope(members.select("memory_id").distinct(), members, ["NATION_0/BUILDING", "NATION_3/MACHINERY", "NATION_3"])


def scope_dag(spark: SparkSession, d: str) -> DataFrame:
    members = _customer_scopes(spark, d)
    return P.scope_dag(members.select("memory_id").distinct(), members, P.scope_closure(V.scope_edges(spark, d)), ["ASIA", "NATION_0"])


def suppression_visible(spark: SparkSession, d: str) -> DataFrame:
    return P.visible(V.memos(spark, d), V.metadata(spark, d)).select("memory_id")


def edge_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Order memos hidden as edges whose customer is suppressed."""
    nodes, edges, _, _ = V.graph(spark, d)
    own = nodes.select("memory_id", "namespace", "suppressed", F.lit(None).cast("string").alias("edge_id"))
    as_edges = edges.select(F.concat(F.lit("e:"), "edge_id").alias("memory_id"), F.lit("links").alias("namespace"), F.lit(False).alias("suppressed"), "edge_id")
    return P.visible(own.unionByName(as_edges), V.metadata(spark, d).limit(0), edges).where("edge_id IS NOT NULL").select("edge_id")


def closest_suppressed(spark: SparkSession, d: str) -> DataFrame:
    return P.hidden_namespaces(V.memos(spark, d), V.metadata(spark, d)).withColumnRenamed("by", "up")


def namespace_catalog(spark: SparkSession, d: str) -> DataFrame:
    return NS.catalog(V.memos(spark, d), V.metadata(spark, d))


def namespace_under_prefix(spark: SparkSession, d: str) -> DataFrame:
    return NS.under_prefix(NS.catalog(V.memos(spark, d), V.metadata(spark, d)), "support").select("namespace")


def _lexical_hits(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(V.chunks(spark, d), "budget", stem=False).select("namespace", F.col("key").alias("memory_key"), F.round(-F.col("score"), 6).alias("score"))


def namespace_rank(spark: SparkSession, d: str) -> DataFrame:
    r = NS.rank(_lexical_hits(spark, d), limit=20)
    return _round(r.select("namespace", "score", "hit_count", "score_max"), "score", "score_max")


def namespace_meta_rank(spark: SparkSession, d: str) -> DataFrame:
    r = NS.rank(_lexical_hits(spark, d), V.metadata(spark, d), "Support notes", limit=20)
    return _round(r.select("namespace", "score", "hit_count"), "score")


def namespace_by_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _round(NS.by_metadata(NS.catalog(V.memos(spark, d), V.metadata(spark, d)), "legal notes desk"), "score")


def namespace_fused(spark: SparkSession, d: str) -> DataFrame:
    names = NS.catalog(V.memos(spark, d), V.metadata(spark, d))
    content = NS.rank(_lexical_hits(spark, d), limit=32)
    meta = NS.by_metadata(names, "support studio notes")
    arms = [R.Arm("nodes", R.ranked(content, "namespace", F.desc(F.round("score", 6)), "namespace", limit=32)), R.Arm("lexical", R.ranked(meta, "namespace", F.desc(F.round("score", 6)), "namespace", limit=32))]
    return _round(R.fuse(arms).orderBy(F.desc("score"), "id").limit(10).select(F.col("id").alias("namespace"), "score"), "score")


def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier, its nation's and fellow customers' best scored nodes: neighbours ranked by account or key."""
    nodes, edges, _, _ = V.graph(spark, d)
    hits = nodes.where("namespace = 'geo/nation'").select(F.col("memory_id").alias("id"), "memory_id", F.lit("crm").alias("namespace"))
    scored = nodes.select(F.col("memory_id").alias("id"), "memory_id", "namespace", F.col("key").cast("double").alias("score"))
    return R.expand(hits, G.neighbours(edges).select("memory_id", "neighbour_id"), scored, cap=5).select("hit_id", "neighbour_id", "rank")


def autolink_edges(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best memos for each source, the memos of chunks whose number is divisible by 100, from the 25 chunks nearest to each."""
    v = V.chunk_vectors(spark, d).join(V.chunks(spark, d).select("id", "key"), "id").select("id", F.concat("namespace", F.lit("::"), "key").alias("name"), "vector")
    asked = v.where("CAST(substring(id, 5) AS BIGINT) % 100 = 0")
    near = R.nearest_each(v, asked.select(F.col("id").alias("query_id"), "vector"), 25, "id")
    hits = R.ranked(near, "id", "distance", "id", per=["query_id"]).select("query_id", "id", (1 / (60 + F.col("rank"))).alias("score"))
    rows = hits.join(asked.select(F.col("id").alias("query_id"), F.col("name").alias("source_key")), "query_id").join(v.select("id", F.col("name").alias("memory_key")), "id")
    links = autolink(rows.select("source_key", "memory_key", F.lit("node").alias("kind"), F.col("id").alias("source_map"), "score"), top_k=10)
    return _round(links.select("source_key", "memory_key", "source_map", "score", "rank"), "score")


QUERIES = {f.__name__: f for f in (
    knn_cosine, knn_max_distance, knn_scoped, knn_dim_filter, knn_cosine_each, knn_max_distance_each, knn_scoped_each, knn_dim_filter_each, ann_lsh, bm25_topk, bm25_scoped_global_idf, bm25_stemmed, rrf_two_arms, rrf_weights, rrf_item_boost, rrf_contributions, hybrid_search,
    hybrid_label_all_some, hybrid_min_score, hybrid_asof, hybrid_allowlist, search_neighbours, search_ann, hybrid_text_and_vector, path_subtree, path_errors, namespace_lineage, rename_map, scope_closure, exact_scope, scope_dag, suppression_visible,
    edge_suppression, closest_suppressed, namespace_catalog, namespace_under_prefix, namespace_rank, namespace_meta_rank, namespace_by_metadata, namespace_fused, neighbor_expand, autolink_edges)}

_Q7 = "q AS (SELECT vector AS qv FROM embeds WHERE id = 'v-7')"
_DIST = "round(1 - list_dot_product(vector, qv) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(qv, qv))), 6) + 0.0"


def _knn(where: str = "true", n: int = 10) -> str:
    return f"{V.sql('embeds')}, {_Q7} SELECT id, {_DIST} AS distance FROM embeds, q WHERE {where} ORDER BY 2, 1 LIMIT {n}"


def _knn_each(where: str = "true", n: int = 10, views: str = V.sql("embeds"), rows: str = "embeds", asked: str = "CAST(substr(id, 3) AS BIGINT) % 100 = 0") -> str:
    return f"""{views}, q AS (SELECT id AS query_id, vector AS qv FROM {rows} WHERE {asked}),
far AS (SELECT query_id, id, round(1 - list_dot_product(vector, qv) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(qv, qv))), 12) AS dist FROM {rows} JOIN q ON len(vector) = len(qv) WHERE {where})
SELECT query_id, id, round(dist, 6) + 0.0 AS distance FROM far WHERE isfinite(dist) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) <= {n}"""


def _bm25(query: str) -> str:
    """CTEs up to `hits` (chunks columns, score): exact and prefix phrase of each word."""
    words = query.split()
    tfs = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS e{i}, len(list_filter(w, lambda x: starts_with(x, '{t}'))) AS p{i}" for i, t in enumerate(words))
    dfs = ", ".join(f"count(*) FILTER (e{i} > 0) AS de{i}, count(*) FILTER (p{i} > 0) AS dp{i}" for i in range(len(words)))
    idf = lambda c: f"greatest(ln((n - {c} + 0.5) / ({c} + 0.5)), 1e-6)"
    score = " ".join(f"- {idf('d' + c)} * {c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)) for c in (f"e{i}", f"p{i}"))
    match = " AND ".join(f"(e{i} > 0 OR p{i} > 0)" for i in range(len(words)))
    return f"""worded AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM chunks),
counted AS (SELECT * EXCLUDE (w), len(w) AS dl, {tfs} FROM worded),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {dfs} FROM counted),
hits AS (SELECT id, memory_id, namespace, key, lang, source, _ts_created, 0.0 {score} AS score FROM counted, stats WHERE {match})"""


_ARMS = f"""{V.sql('embeds')}, {_Q7},
near AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS rank FROM (SELECT id, 1 - list_dot_product(vector, qv) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(qv, qv))) AS dist FROM embeds, q) ORDER BY dist, id LIMIT 25),
lab AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM embeds WHERE label = 3 ORDER BY id LIMIT 25)"""


_FAR = "1 - list_dot_product(vector, qv) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(qv, qv)))"


def _arms_sql(inside: str = "true", far: str = "true", n: int = 50, weight: float = 1.0) -> str:
    """CTEs up to fused (id, score): both arms over the rows for which `inside` holds."""
    return f"""{V.sql('chunks', 'embeds', 'chunk_vectors')}, {_Q7}, {_bm25(QUERY)},
lexall AS (SELECT id, memory_id, namespace, score FROM hits WHERE {inside}),
farall AS (SELECT id, memory_id, namespace, {_FAR} AS dist FROM cvec, q WHERE {inside} AND {_FAR} <= {far}),
lex AS (SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM lexall QUALIFY rank <= {n}),
vec AS (SELECT id, row_number() OVER (ORDER BY dist, id) AS rank FROM farall QUALIFY rank <= {n}),
fused AS (SELECT id, sum(s) AS score FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM lex UNION ALL SELECT id, {weight}::DOUBLE / (60 + rank) FROM vec) GROUP BY id)"""


def _hybrid_sql(where: str = "true", inside: str = "true", far: str = "2.5", n: int = 10, weight: float = 1.0) -> str:
    return f"""{_arms_sql(inside, far, max(5 * n, 25), weight)}
SELECT f.id, round(score, 6) + 0.0 AS score FROM fused f JOIN chunks c USING (id) WHERE {where} ORDER BY f.score DESC, f.id LIMIT {n}"""


_CLOSURE = """,
nodes_ AS (SELECT parent AS id FROM scopes UNION SELECT child FROM scopes),
closure AS (SELECT id AS ancestor, id AS descendant FROM nodes_ UNION SELECT c.ancestor, s.child FROM closure c JOIN scopes s ON s.parent = c.descendant)"""
_MEMBERS = ", members AS (SELECT c_custkey AS memory_id, n_name || '/' || c_mktsegment AS scope_id FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_UNDER = lambda c, r: f"({c} = '{r}' OR starts_with({c}, '{r}/'))"
_HIDDEN = ", hidden AS (SELECT DISTINCT m.namespace, x.namespace AS up FROM memos m JOIN metadata x ON x.suppressed AND (m.namespace = x.namespace OR starts_with(m.namespace, x.namespace || '/')))"
_CATALOG = """,
names AS (SELECT DISTINCT namespace FROM memos UNION SELECT namespace FROM metadata),
catalog AS (SELECT n.namespace, x.alias, coalesce(x.description, '') AS description, coalesce(x.suppressed, false) AS suppressed,
  EXISTS (SELECT 1 FROM metadata y WHERE y.suppressed AND (n.namespace = y.namespace OR starts_with(n.namespace, y.namespace || '/'))) AS effective
  FROM names n LEFT JOIN metadata x USING (namespace))"""
_NSHITS = f"{V.sql('memos', 'metadata', 'chunks')}, {_bm25('budget')}, nshits AS (SELECT namespace, key, round(-score, 6) AS score FROM hits), per AS (SELECT namespace, count(*) AS hit_count, sum(score) AS score_sum, max(score) AS score_max FROM nshits GROUP BY 1)"


def _share(query: str, text: str) -> str:
    words = sorted(set(query.lower().split()))
    hits = " + ".join(f"CAST(list_contains(regexp_extract_all(lower({text}), '[a-z0-9_]+'), '{w}') AS INT)" for w in words)
    return f"(({hits}) / {len(words)}::DOUBLE)"


_META_TEXT = "coalesce(alias, '') || ' ' || coalesce(description, '') || ' ' || replace(namespace, '/', ' ')"

SQL = {
    "knn_cosine": _knn(),
    "knn_max_distance": f"{V.sql('embeds')}, {_Q7} SELECT id, {_DIST} AS distance FROM embeds, q WHERE 1 - list_dot_product(vector, qv) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(qv, qv))) <= 0.8 ORDER BY 2, 1 LIMIT 25",
    "knn_scoped": _knn("namespace IN ('vec/label1', 'vec/label3')"),
    "knn_dim_filter": f"""{V.sql('vectors')}, fit AS (SELECT id, CAST(vector AS DOUBLE[]) AS vector FROM vectors WHERE len(vector) = 768 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0),
q AS (SELECT vector AS qv FROM fit ORDER BY id LIMIT 1) SELECT id, {_DIST} AS distance FROM fit, q WHERE list_dot_product(vector, vector) > 0 ORDER BY 2, 1 LIMIT 10""",
    "knn_cosine_each": _knn_each(),
    "knn_max_distance_each": _knn_each("1 - list_dot_product(vector, qv) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(qv, qv))) <= 0.8", 25),
    "knn_scoped_each": _knn_each("namespace IN ('vec/label1', 'vec/label3')"),
    "knn_dim_filter_each": _knn_each(views=f"{V.sql('vectors')}, fit AS (SELECT id, CAST(vector AS DOUBLE[]) AS vector FROM vectors WHERE len(vector) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)", rows="fit", asked="CAST('0x' || substr(id, 4) AS HUGEINT) % 100 = 0"),
    "bm25_topk": f"{V.sql('chunks')}, {_bm25(QUERY)} SELECT id, round(score, 6) + 0.0 AS score FROM hits ORDER BY hits.score, id LIMIT 10",
    "bm25_scoped_global_idf": f"{V.sql('chunks')}, {_bm25('budget')} SELECT id, namespace, round(score, 6) + 0.0 AS score FROM hits WHERE {_UNDER('namespace', 'support')} OR {_UNDER('namespace', 'orbit/sales')} ORDER BY hits.score, id LIMIT 25",
    "rrf_two_arms": f"{_ARMS} SELECT id, round(sum(s), 6) + 0.0 AS score FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM near UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM lab) GROUP BY id",
    "rrf_weights": f"{_ARMS} SELECT id, round(sum(s), 6) + 0.0 AS score FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM near UNION ALL SELECT id, 2.0::DOUBLE / (60 + rank) FROM lab WHERE rank <= 10) GROUP BY id",
    "rrf_item_boost": f"{_ARMS} SELECT id, round(sum(s) * CASE WHEN max(label) = 1 THEN 3 ELSE 1 END, 6) + 0.0 AS score FROM (SELECT id, 1.0::DOUBLE / (60 + rank) AS s FROM near UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank) FROM lab) JOIN embeds USING (id) GROUP BY id",
    "rrf_contributions": f"{_ARMS} SELECT id, 'vector' AS arm, CAST(rank AS INT) AS rank, round(1.0::DOUBLE / (60 + rank), 6) + 0.0 AS score FROM near UNION ALL SELECT id, 'label', CAST(rank AS INT), round(1.0::DOUBLE / (60 + rank), 6) + 0.0 FROM lab",
    "hybrid_search": _hybrid_sql(),
    "hybrid_label_all_some": _hybrid_sql("c.lang = 'en' AND c.source IN ('session-log', 'import-ops', 'agent-ops', 'import-agents', 'mail-ops')"),
    "hybrid_min_score": _hybrid_sql("f.score >= 0.014"),
    "hybrid_asof": _hybrid_sql(inside="_ts_created >= 1735689600000 AND _ts_created <= 1767225600000"),
    "hybrid_allowlist": _hybrid_sql(inside=f"({_UNDER('namespace', 'support')} OR {_UNDER('namespace', 'orbit/sales')})", far="1.0", n=5, weight=0.5),
    "search_neighbours": f"""{_arms_sql(far="2.5")}, {V.SQL['chunk_neighbours']},
top AS (SELECT f.id AS hit_id, c.memory_id AS own, c.namespace AS ns FROM fused f JOIN chunks c USING (id) ORDER BY f.score DESC, f.id LIMIT 10),
pairs AS (SELECT DISTINCT hit_id, ns, neighbour_id AS memory_id FROM top JOIN cnext ON cnext.memory_id = own),
nl AS (SELECT hit_id, id, memory_id, row_number() OVER (PARTITION BY hit_id ORDER BY score, id) AS rank FROM lexall l JOIN pairs p USING (memory_id) WHERE l.namespace = ns OR starts_with(l.namespace, ns || '/') QUALIFY rank <= 25),
nv AS (SELECT hit_id, id, memory_id, row_number() OVER (PARTITION BY hit_id ORDER BY dist, id) AS rank FROM farall f JOIN pairs p USING (memory_id) WHERE f.namespace = ns OR starts_with(f.namespace, ns || '/') QUALIFY rank <= 25),
nf AS (SELECT hit_id, id, memory_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT * FROM nl UNION ALL SELECT * FROM nv) GROUP BY 1, 2, 3),
one AS (SELECT * FROM nf QUALIFY row_number() OVER (PARTITION BY hit_id, memory_id ORDER BY s DESC, id) = 1)
SELECT hit_id, memory_id, id, CAST(row_number() OVER (PARTITION BY hit_id ORDER BY s DESC, id) AS INT) AS rank, round(s, 6) + 0.0 AS score FROM one QUALIFY rank <= 4""",
    "path_subtree": f"{V.sql('memos')} SELECT memory_id, namespace FROM memos WHERE {_UNDER('namespace', 'support')} OR {_UNDER('namespace', 'orbit/sales')}",
    "path_errors": f"""{V.sql('memos')} SELECT path, CASE WHEN path = '' THEN 'empty' WHEN length(path) > 512 THEN 'max_length' WHEN NOT regexp_full_match(path, '[a-z0-9_-]+(/[a-z0-9_-]+)*') THEN 'invalid'
      WHEN len(string_split(path, '/')) > 2 THEN 'max_depth' END AS error FROM (SELECT namespace AS path FROM memos UNION SELECT key FROM memos)""",
    "namespace_lineage": f"{V.sql('memos')} SELECT DISTINCT namespace, array_to_string(list_transform(range(1, len(string_split(namespace, '/')) + 1), lambda n: array_to_string(string_split(namespace, '/')[1:n], '/')), ' ') AS lineage FROM memos",
    "rename_map": f"{V.sql('memos')} SELECT memory_id, CASE WHEN {_UNDER('namespace', 'support')} THEN 'help/desk' || substr(namespace, 8) ELSE namespace END AS namespace FROM memos",
    "scope_closure": f"{V.sql('scopes', recursive=True)}{_CLOSURE} SELECT ancestor, descendant FROM closure",
    "exact_scope": f"WITH members AS (SELECT c_custkey AS memory_id, n_name || '/' || c_mktsegment AS scope_id FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT memory_id FROM members WHERE scope_id IN ('NATION_0/BUILDING', 'NATION_3/MACHINERY', 'NATION_3')",
    "scope_dag": f"{V.sql('scopes', recursive=True)}{_CLOSURE}{_MEMBERS} SELECT DISTINCT memory_id FROM members JOIN closure ON scope_id = descendant WHERE ancestor IN ('ASIA', 'NATION_0')",
    "suppression_visible": f"{V.sql('memos', 'metadata')}{_HIDDEN} SELECT memory_id FROM memos WHERE NOT suppressed AND namespace NOT IN (SELECT namespace FROM hidden)",
    "edge_suppression": f"{V.sql('nodes', 'edges')} SELECT edge_id FROM edges_ e WHERE NOT EXISTS (SELECT 1 FROM nodes_ n WHERE n.suppressed AND n.memory_id IN (e.from_id, e.to_id))",
    "closest_suppressed": f"{V.sql('memos', 'metadata')}{_HIDDEN} SELECT namespace, arg_max(up, length(up)) AS up FROM hidden GROUP BY 1",
    "namespace_catalog": f"{V.sql('memos', 'metadata')}{_CATALOG} SELECT * FROM catalog",
    "namespace_under_prefix": f"{V.sql('memos', 'metadata')}{_CATALOG} SELECT namespace FROM catalog WHERE {_UNDER('namespace', 'support')} AND NOT effective",
    "namespace_rank": f"{_NSHITS} SELECT namespace, round(score_sum * (1 + ln(1 + hit_count)), 6) + 0.0 AS score, hit_count, round(score_max, 6) + 0.0 AS score_max FROM per ORDER BY score_sum * (1 + ln(1 + hit_count)) DESC, per.score_max DESC, hit_count DESC, namespace LIMIT 20",
    "namespace_meta_rank": f"{_NSHITS} SELECT namespace, round(score, 6) + 0.0 AS score, hit_count FROM (SELECT per.*, score_sum * (1 + ln(1 + hit_count)) * (1 + 0.5 * {_share('support notes', _META_TEXT)}) AS score FROM per LEFT JOIN metadata USING (namespace)) t ORDER BY t.score DESC, score_max DESC, hit_count DESC, namespace LIMIT 20",
    "namespace_by_metadata": f"{V.sql('memos', 'metadata')}{_CATALOG} SELECT namespace, round({_share('legal notes desk', _META_TEXT)}, 6) + 0.0 AS score FROM catalog WHERE {_share('legal notes desk', _META_TEXT)} > 0",
    "namespace_fused": f"""{_NSHITS}{_CATALOG},
content AS (SELECT namespace, row_number() OVER (ORDER BY round(score_sum * (1 + ln(1 + hit_count)), 6) DESC, namespace) AS rank FROM per QUALIFY rank <= 32),
scored AS (SELECT namespace, round({_share('support studio notes', _META_TEXT)}, 6) AS s FROM catalog),
meta AS (SELECT namespace, row_number() OVER (ORDER BY s DESC, namespace) AS rank FROM scored WHERE s > 0 QUALIFY rank <= 32),
fused AS (SELECT namespace, sum(s) AS score FROM (SELECT namespace, 1.0::DOUBLE / (60 + rank) AS s FROM content UNION ALL SELECT namespace, 1.0::DOUBLE / (60 + rank) FROM meta) GROUP BY 1)
SELECT namespace, round(score, 6) + 0.0 AS score FROM fused ORDER BY fused.score DESC, namespace LIMIT 10""",
    "neighbor_expand": f"""{V.sql('nodes', 'edges')},
pairs AS (SELECT from_id AS a, to_id AS b FROM edges_ UNION SELECT to_id, from_id FROM edges_),
found AS (SELECT p.a AS hit_id, p.b AS neighbour_id, CAST(n.key AS DOUBLE) AS score FROM pairs p JOIN nodes_ h ON h.memory_id = p.a AND h.namespace = 'geo/nation' JOIN nodes_ n ON n.memory_id = p.b WHERE starts_with(n.namespace, 'crm/'))
SELECT hit_id, neighbour_id, CAST(row_number() OVER (PARTITION BY hit_id ORDER BY score DESC, neighbour_id) AS INT) AS rank FROM found QUALIFY rank <= 5""",
    "autolink_edges": f"""{V.sql('chunks', 'embeds', 'chunk_vectors')}, named AS (SELECT v.id, v.namespace || '::' || c.key AS name, v.vector FROM cvec v JOIN chunks c USING (id)),
q AS (SELECT id AS query_id, name AS source_key, vector AS qv FROM named WHERE CAST(substr(id, 5) AS BIGINT) % 100 = 0),
near AS (SELECT query_id, source_key, id, name AS memory_key, row_number() OVER (PARTITION BY query_id ORDER BY round({_FAR}, 12), id) AS place FROM named, q QUALIFY place <= 25),
best AS (SELECT source_key, memory_key, id AS source_map, 1.0::DOUBLE / (60 + place) AS s FROM near WHERE memory_key <> source_key QUALIFY row_number() OVER (PARTITION BY source_key, memory_key ORDER BY place, id DESC) = 1)
SELECT source_key, memory_key, source_map, round(s, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY source_key ORDER BY s DESC, memory_key) - 1 AS INT) AS rank FROM best QUALIFY rank < 10""",
}
