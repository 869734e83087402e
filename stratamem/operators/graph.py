"""Property-graph reads and profiles over nodes (memory_id, namespace, key, suppressed), edges (edge_id, from_id, to_id) and
label rows (edge_id or memory_id, kind). Ends are joined by id, so equal keys in two namespaces stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.sources.tables import keep


def with_kinds(df: DataFrame, labels: DataFrame, id_: str) -> DataFrame:
    """`df` with the sorted array of its label kinds; empty where it has none."""
    kinds = labels.groupBy(id_).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return df.join(kinds, id_, "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def edges_of(edges: DataFrame, nodes: DataFrame, labels: DataFrame, namespace: Column | None = None) -> DataFrame:
    """edge_id, from_key, to_key, from_ns, to_ns, kinds of the edges with an end for which `namespace` (a predicate on
    namespace) holds; an edge without both ends is left out."""
    near = nodes.where("NOT coalesce(suppressed, false)").select("memory_id", "key", "namespace")
    a = near.select(F.col("memory_id").alias("from_id"), F.col("key").alias("from_key"), F.col("namespace").alias("from_ns"))
    b = near.select(F.col("memory_id").alias("to_id"), F.col("key").alias("to_key"), F.col("namespace").alias("to_ns"))
    rows = edges.select("edge_id", "from_id", "to_id").join(a, "from_id").join(b, "to_id")
    if namespace is not None:
        inside = near.where(namespace).select("namespace").distinct()
        rows = rows.join(inside.withColumnRenamed("namespace", "from_ns"), "from_ns", "left_semi").unionByName(rows.join(inside.withColumnRenamed("namespace", "to_ns"), "to_ns", "left_semi")).dropDuplicates(["edge_id"])
    return with_kinds(rows, labels, "edge_id").select("edge_id", "from_key", "from_ns", "to_key", "to_ns", "kinds")


def neighbours(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(memory_id, neighbour_id, edge_id, direction): every edge from both of its ends; a loop once, as out."""
    out = edges.select(F.col("from_id").alias("memory_id"), F.col("to_id").alias("neighbour_id"), "edge_id", F.lit("out").alias("direction"))
    back = edges.where("from_id <> to_id").select(F.col("to_id").alias("memory_id"), F.col("from_id").alias("neighbour_id"), "edge_id", F.lit("in").alias("direction"))
    return out.unionByName(back)


def constrained(pairs: DataFrame, nodes: DataFrame, edge_labels: DataFrame, node_labels: DataFrame, edge_kind: str | None = None, direction: str | None = None,
                all_: list[str] | None = None, some: list[str] | None = None) -> DataFrame:
    """Neighbour pairs whose edge kind, direction and neighbour labels are as asked; suppressed neighbours are left out."""
    from stratamem.operators.predicates import has_labels

    rows = pairs if direction is None else pairs.where(F.col("direction") == direction)
    if edge_kind is not None:
        rows = rows.join(edge_labels.where(F.col("kind") == edge_kind).select("edge_id"), "edge_id", "left_semi")
    seen = with_kinds(nodes.where("NOT coalesce(suppressed, false)").select("memory_id"), node_labels, "memory_id").where(has_labels("kinds", all_, some))
    return rows.join(seen.select(F.col("memory_id").alias("neighbour_id")), "neighbour_id", "left_semi").select("memory_id", "neighbour_id", "edge_id", "direction")


def capped(pairs: DataFrame, n: int) -> DataFrame:
    """The first n neighbours of each memory by id: a paging operator."""
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy("neighbour_id", "edge_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def stats(nodes: DataFrame, edges: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """namespace, nodes, suppressed_nodes, edges, suppressed_edges. An edge counts in each namespace it touches; it is
    suppressed there if an end is. All of a hidden namespace is suppressed."""
    n = nodes.select("memory_id", "namespace", F.coalesce("suppressed", F.lit(False)).alias("off"))
    if hidden is not None:
        n = n.join(hidden.select("namespace", F.lit(True).alias("h")), "namespace", "left").select("memory_id", "namespace", (F.col("off") | F.coalesce("h", F.lit(False))).alias("off"))
    per_node = n.groupBy("namespace").agg(F.count_if(~F.col("off")).alias("nodes"), F.count_if("off").alias("suppressed_nodes"))
    ends = edges.select("edge_id", F.explode(F.array("from_id", "to_id")).alias("memory_id")).join(n, "memory_id")
    off = ends.groupBy("edge_id").agg(F.bool_or("off").alias("off"), F.collect_set("namespace").alias("ns"))
    per_edge = off.select("edge_id", "off", F.explode("ns").alias("namespace")).groupBy("namespace").agg(F.count_if(~F.col("off")).alias("edges"), F.count_if("off").alias("suppressed_edges"))
    return per_node.join(per_edge, "namespace", "left").fillna(0, ["edges", "suppressed_edges"])


def roll_up(per_namespace: DataFrame, lineage: Column) -> DataFrame:
    """The sums of all numbers over each namespace's subtree, for every prefix."""
    numbers = [c for c in per_namespace.columns if c != "namespace"]
    return per_namespace.withColumn("namespace", F.explode(lineage)).groupBy("namespace").agg(*[F.sum(c).alias(c) for c in numbers])


def histogram(labels: DataFrame, id_: str) -> DataFrame:
    """kind, n: labelled things per kind, each once."""
    return labels.select(id_, "kind").distinct().groupBy("kind").agg(F.count("*").alias("n"))


def centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """memory_id, degree, centrality (degree over the largest; 0 without edges). A loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("memory_id"))
    deg = nodes.select("memory_id").join(ends.groupBy("memory_id").agg(F.count("*").alias("degree")), "memory_id", "left").fillna(0, ["degree"])
    most = deg.agg(F.max("degree").alias("m")).scalar()
    return deg.select("memory_id", "degree", F.coalesce(F.col("degree") / F.nullif(most, F.lit(0)), F.lit(0.0)).alias("centrality"))


def meta_text(edges: DataFrame, nodes: DataFrame, node_labels: DataFrame, edge_labels: DataFrame) -> DataFrame:
    """memory_id, text: sorted, distinct lines node:<kind> and edge in|out:<neighbour key>:<kinds joined by |>."""
    own = node_labels.select("memory_id", F.concat(F.lit("node:"), "kind").alias("line"))
    per = neighbours(edges).join(edge_labels.select("edge_id", "kind"), "edge_id").groupBy("memory_id", "neighbour_id", "direction").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))
    keyed = per.join(nodes.select(F.col("memory_id").alias("neighbour_id"), "key"), "neighbour_id")
    lines = own.unionByName(keyed.select("memory_id", F.concat(F.lit("edge "), "direction", F.lit(":"), "key", F.lit(":"), "kinds").alias("line")))
    return lines.groupBy("memory_id").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("text"))


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id of each connected component of the pairs. Each round takes the least label of the
    neighbours and then the label's own label; labels are merged map-side, so hubs are no hot spots."""
    both = keep(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(b, a)).distinct(), "pairs")
    now = keep(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("id"), "label"), "labels")
    while True:
        near = both.join(now, both["y"] == now["id"]).groupBy("x").agg(F.min("label").alias("near"))
        hooked = now.join(near, now["id"] == near["x"]).select("id", F.least("label", "near").alias("label"))
        jump = keep(hooked, "labels")
        far = jump.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = keep(jump.join(far, "label", "left").select("id", F.coalesce("further", "label").alias("label")), "labels")
        moved = new.join(now.withColumnRenamed("label", "old"), "id").where("label <> old").take(1)
        now = new
        if not moved:
            return now.select("id", F.col("label").alias("component"))
