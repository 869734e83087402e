"""Applying a stream of merges and deletes: column-wise last writer wins, in SQL only.

A change is one (root, namespace, memory_key, source_key); repeats and other spellings fold into it with their earliest
time. Each source_key is one field of its memory: its value is the max_by over the changes that set it, taken in the
order (time, place in the history, root), and it lives if that is after the latest delete of the memory.

The place in the history matters only between changes of one memory with equal times. A tie whose roots but one have their
parent among them is ordered by these links alone; for any other tie the depths of all roots are worked out. Both is pointer
doubling in SQL: as many rounds as the longest line has binary digits, each one join, at any number of rows.

Defined cases: event types are trimmed and in upper case, others than MERGE_MEMORY and DELETE_MEMORY are ignored; null
namespaces, keys and source_keys are values like any other; a change without a time or root is older than any with one;
of several parents of a root the smallest is kept; on a cycle of parents no root comes first, and the roots themselves
decide; roots without a common history go by their depths, then by themselves; an empty outbox gives no rows. A memory with very many changes
is reduced map-side and never gathered in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratamem.sources.tables import keep

NORMAL = "regexp_replace(lower(trim(BOTH ' \\t\\n' FROM {0})), '^0x', '')"

CHANGES = """
SELECT {root} AS root, namespace, memory_key, source_key, upper(trim(BOTH ' \\t\\n' FROM event_type)) AS kind,
       min(_ts_created) AS ts
FROM {outbox} WHERE facet = '{facet}' AND upper(trim(BOTH ' \\t\\n' FROM event_type)) IN ('MERGE_MEMORY', 'DELETE_MEMORY')
GROUP BY 1, 2, 3, 4, 5
"""

LINKS = """
SELECT node, CASE WHEN parent NOT IN ('', repeat('0', 64)) THEN parent END AS parent
FROM (SELECT {node} AS node, coalesce({parent}, '') AS parent FROM {provenance}) WHERE node <> ''
"""

TIED = """
WITH ties AS (
  SELECT namespace, memory_key, ts FROM {changes} GROUP BY 1, 2, 3 HAVING min(root) <> max(root))
SELECT DISTINCT c.namespace, c.memory_key, c.ts, c.root FROM {changes} c JOIN ties t
ON c.namespace <=> t.namespace AND c.memory_key <=> t.memory_key AND c.ts <=> t.ts WHERE c.root IS NOT NULL
"""

NEAR = """
WITH own AS (
  SELECT l.node, min(coalesce(l.parent, '')) AS parent FROM {links} l LEFT SEMI JOIN {tied} t ON l.node = t.root GROUP BY 1)
SELECT t.*, to_json(struct(t.namespace, t.memory_key, t.ts, t.root)) AS node,
       CASE WHEN h.root IS NOT NULL THEN to_json(struct(t.namespace, t.memory_key, t.ts, h.root)) END AS up
FROM {tied} t LEFT JOIN own o ON o.node = t.root
LEFT JOIN {tied} h ON h.root = o.parent AND h.root <> t.root AND h.namespace <=> t.namespace AND h.memory_key <=> t.memory_key AND h.ts <=> t.ts
"""

OPEN = "SELECT namespace, memory_key, ts FROM {near} GROUP BY 1, 2, 3 HAVING count_if(up IS NULL) <> 1"

DOUBLED = """
SELECT a.node, b.up, a.steps + coalesce(b.steps, 0) AS steps FROM {now} a LEFT JOIN {now} b ON a.up = b.node
"""

CUT = """
SELECT l.node, CASE WHEN r.node IS NULL THEN l.up END AS up
FROM {links} l LEFT SEMI JOIN {bound} b ON l.node = b.node LEFT JOIN {ring} r ON l.node = r.node
"""

PLACED_BY_DEPTH = """
SELECT n.namespace, n.memory_key, n.ts, n.root, s.steps AS place FROM {near} n
JOIN {open} o ON n.namespace <=> o.namespace AND n.memory_key <=> o.memory_key AND n.ts <=> o.ts JOIN {steps} s ON s.node = n.root
"""

CURRENT = """
WITH placed AS (
  SELECT c.*, struct(c.ts AS ts, coalesce(o.place, 0) AS place, c.root AS root) AS at
  FROM {changes} c LEFT JOIN {order_view} o ON c.root = o.root AND c.namespace <=> o.namespace AND c.memory_key <=> o.memory_key AND c.ts <=> o.ts),
latest AS (
  SELECT namespace, memory_key, source_key, kind, max(at) AS at FROM placed GROUP BY 1, 2, 3, 4),
deletes AS (
  SELECT namespace, memory_key, max(at) AS gone FROM latest WHERE kind = 'DELETE_MEMORY' GROUP BY 1, 2)
SELECT f.namespace, f.memory_key, f.source_key, f.at.root AS root_hex
FROM (SELECT * FROM latest WHERE kind = 'MERGE_MEMORY') f
LEFT JOIN deletes d ON f.namespace <=> d.namespace AND f.memory_key <=> d.memory_key
WHERE d.gone IS NULL OR f.at > d.gone
"""


def _view(df: DataFrame, name: str) -> str:
    name = f"{name}_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(name)
    return name


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(text.format(**{k: _view(df, k) for k, df in tables.items()}))


def changes(outbox: DataFrame, facet: str = "content") -> DataFrame:
    """One row per change: root, namespace, memory_key, source_key, kind, ts."""
    return outbox.sparkSession.sql(CHANGES.format(root=NORMAL.format("root_hex"), outbox=_view(outbox, "outbox"), facet=facet))


def links(provenance: DataFrame, node: str = "root_hex", parent: str = "parent_root_hex") -> DataFrame:
    """(node, parent) of a log in normal form; parent is null where it points at nothing."""
    return provenance.sparkSession.sql(LINKS.format(node=NORMAL.format(node), parent=NORMAL.format(parent), provenance=_view(provenance, "provenance")))


def steps(up: DataFrame) -> DataFrame:
    """(node, steps) to the top of each node's line by pointer doubling; up: (node, up), one row a node.

    Where only lines that never end are left, the nodes their pointers reach are the cycles (the set of them no longer
    shrinks): those are at 0, and what leads to them is counted up to there."""
    spark = up.sparkSession
    now = keep(_sql(spark, "SELECT node, up, CAST(CASE WHEN up IS NULL THEN 0 ELSE 1 END AS BIGINT) AS steps FROM {up}", up=up), "steps")
    reached, before = _reached(now), None
    while reached and reached != before:
        now = keep(_sql(spark, DOUBLED, now=now), "steps")
        before, reached = reached, _reached(now)
    done = _sql(spark, "SELECT node, steps FROM {now} WHERE up IS NULL", now=now)
    if not reached:
        return done
    bound = _sql(spark, "SELECT node FROM {now} WHERE up IS NOT NULL", now=now)
    ring = _sql(spark, "SELECT DISTINCT up AS node FROM {now} WHERE up IS NOT NULL", now=now)
    return done.unionByName(steps(_sql(spark, CUT, links=up, bound=bound, ring=ring)))


def _reached(now: DataFrame) -> int:
    return _sql(now.sparkSession, "SELECT count(DISTINCT up) AS n FROM {now}", now=now).first()["n"]


def order(changed: DataFrame, linked: DataFrame) -> DataFrame:
    """(namespace, memory_key, ts, root, place) of the changes of one memory with equal times: an ancestor's place is smaller than
    its descendants'. changed: `changes(...)`, linked: `links(...)`."""
    spark = changed.sparkSession
    tied = keep(_sql(spark, TIED, changes=changed), "tied")
    near = keep(_sql(spark, NEAR, tied=tied, links=linked), "near")
    left = _sql(spark, OPEN, near=near)
    placed = _sql(spark, "SELECT n.namespace, n.memory_key, n.ts, n.root, s.steps AS place FROM {near} n JOIN {steps} s ON n.node = s.node", near=near, steps=steps(near.select("node", "up")))
    if not left.take(1):
        return placed
    single = _sql(spark, "SELECT node, nullif(min(coalesce(parent, '')), '') AS up FROM {linked} GROUP BY 1", linked=linked)
    far = _sql(spark, PLACED_BY_DEPTH, near=near, open=left, steps=steps(keep(single, "links")))
    return _sql(spark, "SELECT p.* FROM {placed} p LEFT ANTI JOIN {open} o ON p.namespace <=> o.namespace AND p.memory_key <=> o.memory_key AND p.ts <=> o.ts UNION ALL SELECT * FROM {far}", placed=placed, open=left, far=far)


def current(changed: DataFrame, order: DataFrame) -> DataFrame:
    """namespace, memory_key, source_key, root_hex of the fields that live. order: as `order(...)` gives it."""
    return _sql(changed.sparkSession, CURRENT, changes=changed, order_view=order)
