"""Queries over the provenance log and the outbox: pages, time travel, evacuation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.operators import replay as R
from stratamem.plans import views as V
from stratamem.sources.tables import table

UNTIL = 1_751_000_000_000.0
NAMESPACE = "support/studio"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return R.log(table(spark, d, "memory_provenance"))


def prov_head(spark: SparkSession, d: str) -> DataFrame:
    return R.head(_log(spark, d))


def prov_events_page(spark: SparkSession, d: str) -> DataFrame:
    return R.events_page(_log(spark, d), namespace=NAMESPACE, before=(UNTIL, "prov_8"), limit=50)


def prov_chain_page(spark: SparkSession, d: str) -> DataFrame:
    """The hundred rows before the last one that isn't newer than UNTIL."""
    log = _log(spark, d)
    at = log.where(F.col("_ts_created") <= UNTIL).agg(F.max_by("root", "at").alias("root")).first()["root"]
    return R.chain_page(log, before_root=at)


def prov_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind and namespace as the event text names them; cut-off texts have a null namespace."""
    return _log(spark, d).groupBy("event_type", R.event("namespace").alias("namespace")).agg(F.count("*").alias("n"))


def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    return R.verify_chain(_log(spark, d)).groupBy("links", "hashes").agg(F.count("*").alias("n"))


def _state(spark: SparkSession, d: str, facet: str, until: float | None = None) -> DataFrame:
    return R.state(R.changes_at(table(spark, d, "memory_tip_outbox"), facet, until), facet)


def content_at_time(spark: SparkSession, d: str) -> DataFrame:
    return R.with_blobs(_state(spark, d, "content", UNTIL), table(spark, d, "memory_tip_blobs")).select("namespace", "memory_key", "source_key", "payload", "location")


def vector_at_time(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d, "vector", UNTIL).select("namespace", "memory_key", "source_key", "payload")


def graph_at_time(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d, "graph", UNTIL).select("namespace", "memory_key", "edge_id")


def store_now(spark: SparkSession, d: str) -> DataFrame:
    """The live fields of every facet, counted by namespace."""
    rows = None
    for facet in R.FIELDS:
        one = _state(spark, d, facet).groupBy("namespace").agg(F.count("*").alias("n")).withColumn("facet", F.lit(facet))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def evacuate_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.evacuable(_log(spark, d), table(spark, d, "memory_tip_outbox"), table(spark, d, "memory_tip_blobs"))


def evacuated(spark: SparkSession, d: str) -> DataFrame:
    """Blobs by location after the evacuation to a cold store."""
    blobs = table(spark, d, "memory_tip_blobs")
    return R.to_cold(blobs, evacuate_candidates(spark, d), F.concat(F.lit("cold://"), "content_sha256")).groupBy("location").agg(F.count("*").alias("n"), F.count("payload").alias("payloads"))


QUERIES = {f.__name__: f for f in (prov_head, prov_events_page, prov_chain_page, prov_event_counts, chain_verify, content_at_time, vector_at_time, graph_at_time, store_now, evacuate_candidates, evacuated)}

_LOG = V.sql("log")
_KIND = "upper(trim(event_type, E' \\t\\n'))"


def _sql_state(facet: str, until: str = "true") -> str:
    f = ", ".join(R.FIELDS[facet])
    return f"""ch_{facet} AS (SELECT {f}, {V._n('root_hex')} AS root, {_KIND} AS kind, nullif({V._n('payload_sha256')}, '') AS payload, min(_ts_created) AS ts FROM memory_tip_outbox WHERE facet = '{facet}' AND {until} GROUP BY ALL),
st_{facet} AS (SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY {f} ORDER BY ts DESC, root DESC, payload DESC NULLS LAST) AS rn FROM ch_{facet} WHERE kind = 'MERGE_MEMORY') m
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ch_{facet} x WHERE x.kind = 'DELETE_MEMORY' AND x.namespace = m.namespace AND x.memory_key = m.memory_key AND (x.ts > m.ts OR (x.ts = m.ts AND x.root >= m.root))))"""


_PAGE = "ORDER BY _ts_created DESC, _id DESC LIMIT"
_EVAC = f"""{_LOG}, tips AS (SELECT root FROM log {_PAGE} 256),
live AS (SELECT {V._n('payload_sha256')} AS p FROM memory_tip_outbox WHERE {V._n('root_hex')} IN (SELECT root FROM tips) AND payload_sha256 IS NOT NULL),
cand AS (SELECT DISTINCT {V._n('content_sha256')} AS content_sha256 FROM memory_tip_blobs WHERE location = 'hot' AND {V._n('content_sha256')} NOT IN (SELECT p FROM live))"""
_JSON = "CASE WHEN json_valid(event_json) THEN event_json->>'$.namespace' END"

SQL = {
    "prov_head": f"{_LOG} SELECT root, _ts_created FROM log {_PAGE} 1",
    "prov_events_page": f"{_LOG} SELECT _id, _ts_created, event_type, root FROM log WHERE {_JSON} = '{NAMESPACE}' AND (_ts_created < {UNTIL} OR (_ts_created = {UNTIL} AND _id < 'prov_8')) {_PAGE} 50",
    "prov_chain_page": f"{_LOG}, c AS (SELECT _ts_created AS t, _id AS i FROM log WHERE _ts_created <= {UNTIL} {_PAGE} 1) SELECT _id, _ts_created, parent, root FROM log, c WHERE _ts_created < t OR (_ts_created = t AND _id < i) {_PAGE} 100",
    "prov_event_counts": f"{_LOG} SELECT event_type, {_JSON} AS namespace, count(*) AS n FROM log GROUP BY 1, 2",
    "chain_verify": f"""{_LOG}, v AS (SELECT (parent IS NULL OR parent IN ('', repeat('0', 64)) OR EXISTS (SELECT 1 FROM log p WHERE p.root = l.parent)) AS links,
  coalesce(root = sha256(unhex(CASE WHEN parent IS NULL OR parent = '' THEN repeat('0', 64) WHEN regexp_full_match(parent, '([0-9a-f]{{2}})*') THEN parent END || sha256('STRATAMEM_EVENT_LEAF_v1' || chr(0) || event_json))), false) AS hashes FROM log l) SELECT links, hashes, count(*) AS n FROM v GROUP BY 1, 2""",
    "content_at_time": f"WITH {_sql_state('content', f'_ts_created <= {UNTIL}')}, b AS (SELECT {V._n('content_sha256')} AS payload, min(location) AS location FROM memory_tip_blobs GROUP BY 1) SELECT namespace, memory_key, source_key, payload, location FROM st_content LEFT JOIN b USING (payload)",
    "vector_at_time": f"WITH {_sql_state('vector', f'_ts_created <= {UNTIL}')} SELECT namespace, memory_key, source_key, payload FROM st_vector",
    "graph_at_time": f"WITH {_sql_state('graph', f'_ts_created <= {UNTIL}')} SELECT namespace, memory_key, edge_id FROM st_graph",
    "store_now": "WITH " + ", ".join(_sql_state(f) for f in R.FIELDS) + " " + " UNION ALL ".join(f"SELECT namespace, count(*) AS n, '{f}' AS facet FROM st_{f} GROUP BY 1" for f in R.FIELDS),
    "evacuate_candidates": f"{_EVAC} SELECT content_sha256 FROM cand",
    "evacuated": f"""{_EVAC}, moved AS (SELECT b.*, {V._n('content_sha256')} IN (SELECT content_sha256 FROM cand) AND coalesce(sha256(payload) = {V._n('content_sha256')}, false) AS go FROM memory_tip_blobs b)
SELECT CASE WHEN go THEN 'cold' ELSE location END AS location, count(*) AS n, count(payload) FILTER (NOT go) AS payloads FROM moved GROUP BY 1""",
}
