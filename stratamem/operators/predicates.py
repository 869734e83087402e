"""Which memos a read may see: namespace and scope predicates, time bounds, suppression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.functions.paths import lineage, under_any
from stratamem.sources.tables import keep

MAX_ADDITIONAL = 32


def namespaces_of(namespace: str | None, additional: list[str] | None = None) -> list[str]:
    """The distinct namespaces of a search; more than 32 additional ones are refused."""
    extra = list(dict.fromkeys(additional or []))
    if len(extra) > MAX_ADDITIONAL:
        raise ValueError(f"at most {MAX_ADDITIONAL} additional namespaces")
    return list(dict.fromkeys([*([namespace] if namespace else []), *extra]))


def path_subtree(df: DataFrame, roots: list[str], col: str = "namespace") -> DataFrame:
    """Rows at or below any root; no roots, no rows. The predicate reaches the scan."""
    return df.where(under_any(col, roots))


def exact_scope(memos: DataFrame, memory_scopes: DataFrame, scopes: list[str]) -> DataFrame:
    """Memos attached to one of the scopes itself."""
    return memos.join(memory_scopes.where(F.col("scope_id").isin(scopes)), "memory_id", "left_semi")


def scope_dag(memos: DataFrame, memory_scopes: DataFrame, closure: DataFrame, roots: list[str]) -> DataFrame:
    """Memos attached to a root scope or to one reachable from it."""
    reach = closure.where(F.col("ancestor").isin(roots)).select(F.col("descendant").alias("scope_id")).distinct()
    return memos.join(memory_scopes.join(reach, "scope_id", "left_semi"), "memory_id", "left_semi")


def scope_closure(edges: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """(ancestor, descendant): the reflexive, transitive closure of (parent, child), by doubling; cycles end."""
    nodes = edges.select(F.col("parent").alias("id")).union(edges.select("child"))
    nodes = (nodes if scopes is None else nodes.union(scopes.select("id"))).distinct()
    now = keep(nodes.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant")).union(edges.select("parent", "child")).distinct(), "closure")
    n = now.count()
    while True:
        on = now.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("far"))
        now = keep(now.union(now.join(on, "descendant").select("ancestor", "far")).distinct(), "closure")
        before, n = n, now.count()
        if n == before:
            return now


def closes_cycle(closure: DataFrame, parent: str, child: str) -> bool:
    """Whether the edge parent -> child would make a cycle."""
    return parent == child or bool(closure.where((F.col("ancestor") == child) & (F.col("descendant") == parent)).take(1))


def as_of(gt: float | None = None, gte: float | None = None, lt: float | None = None, lte: float | None = None, col: str = "_ts_created") -> Column:
    """Bounds on the time of creation; none, non-finite or contradictory bounds are refused."""
    bounds = {k: v for k, v in {"gt": gt, "gte": gte, "lt": lt, "lte": lte}.items() if v is not None}
    if not bounds or not all(math.isfinite(v) for v in bounds.values()):
        raise ValueError("as-of needs finite bounds")
    low, high = max([v for k, v in bounds.items() if k[0] == "g"], default=-math.inf), min([v for k, v in bounds.items() if k[0] == "l"], default=math.inf)
    if low > high:
        raise ValueError("as-of bounds exclude each other")
    c, ops = F.col(col), {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
    out = F.lit(True)
    for k, v in bounds.items():
        out = out & getattr(c, ops[k])(v)
    return out


def hidden_namespaces(namespaces: DataFrame, metadata: DataFrame) -> DataFrame:
    """(namespace, by): the distinct namespaces at or below a suppressed one, and the closest such."""
    flagged = metadata.where("suppressed").select(F.col("namespace").alias("by")).distinct()
    each = namespaces.select("namespace").distinct().withColumn("by", F.explode(lineage("namespace")))
    return each.join(flagged, "by").groupBy("namespace").agg(F.max_by("by", F.length("by")).alias("by"))


def visible(memos: DataFrame, metadata: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Memos that are not suppressed, nor in or below a suppressed namespace, nor edges with such an end.

    memos: memory_id, namespace, suppressed, edge_id; edges: edge_id, from_id, to_id."""
    hidden = hidden_namespaces(memos, metadata).select("namespace")
    open_ = memos.where("NOT coalesce(suppressed, false)").join(hidden, "namespace", "left_anti")
    if edges is None:
        return open_
    closed = memos.select("memory_id").join(open_.select("memory_id"), "memory_id", "left_anti")
    bad = edges.select("edge_id", F.explode(F.array("from_id", "to_id")).alias("memory_id")).join(closed, "memory_id", "left_semi").select("edge_id")
    return open_.join(bad.distinct(), "edge_id", "left_anti")


def has_labels(kinds: str = "kinds", all_: list[str] | None = None, some: list[str] | None = None) -> Column:
    """Every kind of `all_` and any of `some`, on an array of kinds; empty lists ask nothing."""
    out = F.lit(True)
    for k in all_ or []:
        out = out & F.array_contains(kinds, k)
    return out & (F.arrays_overlap(kinds, F.array(*map(F.lit, some))) if some else F.lit(True))
