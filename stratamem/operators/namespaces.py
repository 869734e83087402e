"""The namespace catalog and the search over namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamem.functions.paths import lineage, under
from stratamem.functions.text import share_of_query

MAX_LIMIT, DEFAULT_LIMIT, DEFAULT_BOOST = 32, 10, 0.5


def catalog(memos: DataFrame, metadata: DataFrame) -> DataFrame:
    """namespace, alias, description, suppressed (its own flag) and effective (flag of itself or an ancestor) of every
    namespace that holds memos or has metadata."""
    names = memos.select("namespace").distinct()
    rows = names.join(metadata.select("namespace", "alias", "description", "suppressed"), "namespace", "full_outer")
    rows = rows.select("namespace", "alias", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("suppressed", F.lit(False)).alias("suppressed"))
    flagged = rows.where("suppressed").select(F.col("namespace").alias("up"))
    hidden = rows.select("namespace", F.explode(lineage("namespace")).alias("up")).join(flagged, "up", "left_semi").select("namespace", F.lit(True).alias("hit")).distinct()
    return rows.join(hidden, "namespace", "left").select("namespace", "alias", "description", "suppressed", F.coalesce("hit", F.lit(False)).alias("effective"))


def under_prefix(names: DataFrame, prefix: str, include_suppressed: bool = False) -> DataFrame:
    """Catalog rows at or below a prefix; suppressed ones, also by an ancestor, only if asked for."""
    rows = names.where(under("namespace", prefix))
    return rows if include_suppressed else rows.where("NOT effective")


def rank(hits: DataFrame, metadata: DataFrame | None = None, query: str = "", boost: float | None = None, root: str | None = None, top_hits: int = 3, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Namespaces by the volume and score of their hits (namespace, memory_key, score): hit_count, score_sum, score_max,
    score = sum * (1 + ln(1 + count)), times 1 + boost * (share of the query's words in the metadata). top_hits holds the
    best keys. Ties by score_max, hit_count and name."""
    limit, top_hits = max(1, min(MAX_LIMIT, int(limit))), max(1, min(MAX_LIMIT, int(top_hits)))
    if root:
        hits = hits.where(under("namespace", root))
    agg = hits.groupBy("namespace").agg(F.count("*").alias("hit_count"), F.sum("score").alias("score_sum"), F.max("score").alias("score_max"))
    order = Window.partitionBy("namespace").orderBy(F.desc("score"), "memory_key")
    best = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top_hits).groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct("n", "memory_key"))).alias("t"))
    rows = agg.join(best, "namespace").select("*", F.transform("t", lambda x: x["memory_key"]).alias("top_hits"))
    score = F.col("score_sum") * (1 + F.log(1 + F.col("hit_count")))
    boost = max(0.0, boost) if boost is not None else DEFAULT_BOOST if query.strip() and metadata is not None else 0.0
    if metadata is not None and boost > 0 and query.strip():
        rows = rows.join(metadata.select("namespace", "alias", "description"), "namespace", "left")
        score = score * (1 + boost * share_of_query(query, F.coalesce("alias", F.lit("")), F.coalesce("description", F.lit("")), F.replace("namespace", F.lit("/"), F.lit(" "))))
    rows = rows.withColumn("score", score)
    return rows.orderBy(F.desc("score"), F.desc("score_max"), F.desc("hit_count"), "namespace").limit(limit).select("namespace", lineage("namespace").alias("lineage"), "score", "hit_count", "score_sum", "score_max", "top_hits")


def by_metadata(names: DataFrame, query: str) -> DataFrame:
    """namespace, score: the share of the query's words in alias, description and path, where there is one."""
    s = share_of_query(query, F.coalesce("alias", F.lit("")), "description", F.replace("namespace", F.lit("/"), F.lit(" ")))
    return names.select("namespace", s.alias("score")).where("score > 0")
