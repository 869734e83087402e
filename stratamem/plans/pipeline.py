"""Queries p1, p3 and p4: orphan references, current content, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.operators import changes as C
from stratamem.operators import hierarchy as H
from stratamem.operators import references as R
from stratamem.sources.tables import keep, table


def _references(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of the pointing rows of the three tables and of their targets."""
    return R.ledger(
        R.ref_deltas(table(spark, d, "memory_tip_outbox"), "memory_tip_outbox", "_id", "payload_sha256", "_ts_created"),
        R.ref_deltas(table(spark, d, "nodes"), "nodes", "_id", "memory_id", "_ts_created"),
        R.ref_deltas(table(spark, d, "database_ontology_links"), "database_ontology_links", "link_id", "ontology_hash", "linked_at_ms"),
        R.exist_deltas(table(spark, d, "memory_tip_blobs"), "memory_tip_outbox", "content_sha256", "_ts_created", F.col("location") != "dropped"),
        R.exist_deltas(table(spark, d, "memory_rows"), "nodes", "_id", "_ts_created"),
        R.exist_deltas(table(spark, d, "ontologies"), "database_ontology_links", "ontology_hash", "created_at_ms"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_rows(_references(spark, d)).select("child_table", "child_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return R.report(R.orphan_rows(_references(spark, d)))


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    return H.links(table(spark, d, "memory_provenance"), "root_hex", "parent_root_hex")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    changed = keep(C.changes(table(spark, d, "memory_tip_outbox")), "changes")
    return C.current(changed, C.order(changed, C.links(table(spark, d, "memory_provenance"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_provenance(spark, d)).where("cycle IS NOT NULL").select(F.col("node").alias("root_hex"), F.col("cycle").alias("cycle_hex"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_provenance(spark, d)).select(F.col("node").alias("root_hex"), F.col("parent").alias("parent_hex"), F.col("root").alias("start_hex"), "depth", F.col("cycle").alias("cycle_hex"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return H.paths(_provenance(spark, d)).select(F.col("node").alias("root_hex"), F.size("path").cast("long").alias("depth"), F.array_join("path", "/").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.paths(_provenance(spark, d))).select(F.col("node").alias("root_hex"), F.col("later").alias("later_hex"), F.col("distance").cast("long").alias("distance"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p4_found, p4_hierarchy, p4_paths, p4_descendants)}


def _n(col: str) -> str:
    return f"regexp_replace(lower(trim({col}, E' \\t\\n')), '^0x', '')"


_ORPHANS = f"""
WITH refs AS (
  SELECT 'memory_tip_outbox' AS child_table, _id AS child_id, {_n('payload_sha256')} AS key, _ts_created AS ts FROM memory_tip_outbox
  UNION SELECT 'nodes', _id, {_n('memory_id')}, _ts_created FROM nodes
  UNION SELECT 'database_ontology_links', CAST(link_id AS VARCHAR), {_n('ontology_hash')}, CAST(linked_at_ms AS DOUBLE) FROM database_ontology_links),
usable AS (
  SELECT 'memory_tip_outbox' AS child_table, {_n('content_sha256')} AS key, min(_ts_created) AS since FROM memory_tip_blobs WHERE location <> 'dropped' GROUP BY 2
  UNION ALL SELECT 'nodes', {_n('_id')}, min(_ts_created) FROM memory_rows GROUP BY 2
  UNION ALL SELECT 'database_ontology_links', {_n('ontology_hash')}, CAST(min(created_at_ms) AS DOUBLE) FROM ontologies GROUP BY 2),
orphans AS (
  SELECT r.*, u.since FROM refs r LEFT JOIN usable u ON r.child_table = u.child_table AND r.key = u.key
  WHERE r.key <> '' AND (u.key IS NULL OR u.since > r.ts))
"""

_LINKS = f"""
links AS (
  SELECT DISTINCT {_n('root_hex')} AS node, CASE WHEN {_n('parent_root_hex')} NOT IN ('', repeat('0', 64)) THEN {_n('parent_root_hex')} END AS parent
  FROM memory_provenance WHERE {_n('root_hex')} <> '')
"""

_TREE = f"""
WITH RECURSIVE {_LINKS},
starts AS (SELECT l.node, l.parent FROM links l WHERE l.parent IS NULL OR NOT EXISTS (SELECT 1 FROM links p WHERE p.node = l.parent)),
tree AS (
  SELECT node, parent, node AS root, CAST(1 AS BIGINT) AS depth, node AS path FROM starts
  UNION ALL SELECT l.node, l.parent, t.root, t.depth + 1, t.path || '/' || l.node FROM tree t JOIN links l ON l.parent = t.node)
"""

_LOOPS = """,
bound AS (SELECT node, parent FROM links WHERE node NOT IN (SELECT node FROM tree)),
walk AS (SELECT node, parent AS up FROM bound UNION SELECT w.node, b.parent FROM walk w JOIN bound b ON b.node = w.up),
ring AS (SELECT node FROM walk WHERE node = up),
cycles AS (SELECT w.node, min(w.up) AS cycle FROM walk w JOIN ring r ON w.up = r.node GROUP BY w.node)
"""

SQL = {
    "p1_found": _ORPHANS + "SELECT child_table, child_id FROM orphans",
    "p1_report": _ORPHANS + """
SELECT child_table, strftime(epoch_ms(CAST(floor(ts) AS BIGINT)), '%Y-%m') AS month, CASE WHEN since IS NULL THEN 'absent' ELSE 'late' END AS missing,
       count(*) AS n_rows, count(DISTINCT key) AS n_keys FROM orphans GROUP BY 1, 2, 3""",
    "p3_found": f"""
WITH RECURSIVE {_LINKS},
changes AS (
  SELECT {_n('root_hex')} AS root, namespace, memory_key, source_key, upper(trim(event_type, E' \\t\\n')) AS kind, min(_ts_created) AS ts
  FROM memory_tip_outbox WHERE facet = 'content' AND upper(trim(event_type, E' \\t\\n')) IN ('MERGE_MEMORY', 'DELETE_MEMORY') GROUP BY 1, 2, 3, 4, 5),
ties AS (SELECT namespace, memory_key, ts FROM changes GROUP BY 1, 2, 3 HAVING count(DISTINCT root) > 1),
tied AS (SELECT DISTINCT c.root, c.namespace, c.memory_key, c.ts FROM changes c JOIN ties USING (namespace, memory_key, ts)),
above AS (
  SELECT l.node, l.parent AS up FROM links l WHERE l.node IN (SELECT root FROM tied) AND l.parent IS NOT NULL
  UNION SELECT a.node, l.parent FROM above a JOIN links l ON l.node = a.up WHERE l.parent IS NOT NULL),
placed AS (
  SELECT c.*, (SELECT count(*) FROM tied t JOIN above a ON a.node = c.root AND a.up = t.root
    WHERE t.root <> c.root AND t.namespace = c.namespace AND t.memory_key = c.memory_key AND t.ts = c.ts) AS place FROM changes c),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY namespace, memory_key, source_key, kind ORDER BY ts DESC, place DESC, root DESC) AS rn,
    row_number() OVER (PARTITION BY namespace, memory_key ORDER BY ts, place, root) AS pos FROM placed),
gone AS (SELECT namespace, memory_key, max(pos) AS pos FROM ranked WHERE kind = 'DELETE_MEMORY' GROUP BY 1, 2)
SELECT r.namespace, r.memory_key, r.source_key, r.root AS root_hex FROM ranked r LEFT JOIN gone g USING (namespace, memory_key)
WHERE r.kind = 'MERGE_MEMORY' AND r.rn = 1 AND (g.pos IS NULL OR r.pos > g.pos)""",
    "p4_found": _TREE + _LOOPS + "SELECT node AS root_hex, cycle AS cycle_hex FROM cycles",
    "p4_hierarchy": _TREE + _LOOPS + """
SELECT node AS root_hex, parent AS parent_hex, root AS start_hex, depth, NULL AS cycle_hex FROM tree
UNION ALL SELECT b.node, b.parent, NULL, NULL, c.cycle FROM bound b JOIN cycles c USING (node)""",
    "p4_paths": _TREE + "SELECT node AS root_hex, depth, path FROM tree",
    "p4_descendants": f"WITH RECURSIVE {_LINKS}" + """,
looped AS (
  WITH RECURSIVE straight AS (
    SELECT node FROM links l WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM links p WHERE p.node = l.parent)
    UNION ALL SELECT l.node FROM straight s JOIN links l ON l.parent = s.node)
  SELECT node FROM links WHERE node NOT IN (SELECT node FROM straight)),
pairs AS (
  SELECT p.node, l.node AS later, CAST(1 AS BIGINT) AS distance FROM links l JOIN links p ON p.node = l.parent WHERE l.node NOT IN (SELECT node FROM looped)
  UNION ALL SELECT p.node, l.node, p.distance + 1 FROM pairs p JOIN links l ON l.parent = p.later)
SELECT node AS root_hex, later AS later_hex, distance FROM pairs""",
}
