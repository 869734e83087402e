"""Auto-links and layout: edges proposed from search hits, and where to draw the nodes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def autolink(hits: DataFrame, top_k: int = 10, min_score: float | None = None, skip_edges: bool = True) -> DataFrame:
    """source_key, memory_key, source_map, score, rank (from 0): the best hit of each other memory, the top_k best of them.

    hits: source_key, memory_key, kind, source_map, score. Hits of the source itself and of edge memos are left out."""
    rows = hits.where("memory_key <> source_key")
    if skip_edges:
        rows = rows.where("coalesce(kind, 'node') <> 'edge'")
    best = rows.groupBy("source_key", "memory_key").agg(F.max_by("source_map", F.struct("score", "source_map")).alias("source_map"), F.max("score").alias("score"))
    if min_score is not None:
        best = best.where(F.col("score") >= min_score)
    rank = F.row_number().over(Window.partitionBy("source_key").orderBy(F.desc("score"), "memory_key")) - 1
    return best.withColumn("rank", rank).where(F.col("rank") < max(0, top_k))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """`df` with i, its place from 0 by `order`, without one task for all rows: counts per range partition, then ranks."""
    from stratamem.sources.tables import keep

    ranged = keep(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()), "numbered")
    before = ranged.groupBy("_p").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("_p")) - F.col("n"))  # a row a partition
    i = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return ranged.withColumn("_i", i).join(F.broadcast(before.drop("n")), "_p").withColumn("i", F.col("_i") + F.col("before")).drop("_p", "_i", "before")


def fibonacci_sphere(nodes: DataFrame, id_: str) -> DataFrame:
    """id, x, y, z: the nodes, in order of id, spread evenly on a sphere, each axis scaled to [-1, 1]."""
    n = F.lit(float(max(1, nodes.count())))
    i = F.col("i").cast("double")
    at = numbered(nodes.select(id_), id_)
    y = 1 - (i + 0.5) / n * 2
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    phi = i * (math.pi * (3 - math.sqrt(5)))
    return scaled(at.select(id_, (F.cos(phi) * r).alias("x"), y.alias("y"), (F.sin(phi) * r).alias("z")), ["x", "y", "z"])


def scaled(df: DataFrame, axes: list[str]) -> DataFrame:
    """Each axis to [-1, 1] by its least and largest value; a flat axis to 0."""
    ends = df.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for a in axes:
        lo, hi = ends[f"lo_{a}"], ends[f"hi_{a}"]
        out[a] = F.lit(0.0) if lo is None or lo == hi else (F.col(a) - lo) / (hi - lo) * 2 - 1
    return df.withColumns(out)


def pca3(vectors: DataFrame, id_: str, vector: str = "vector") -> DataFrame:
    """id, x, y, z: the first three principal components, scaled; a linear stand-in for a neighbourhood layout."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(id_, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=3, inputCol="v", outputCol="p").fit(rows)
    p = vector_to_array("p")
    return scaled(model.transform(rows).select(id_, p[0].alias("x"), p[1].alias("y"), p[2].alias("z")), ["x", "y", "z"])


def approximate_nearest(vectors: DataFrame, query: list[float], k: int, id_: str, vector: str = "vector", bucket: float = 0.6, tables: int = 8) -> DataFrame:
    """(id, distance): about the k nearest by cosine distance, found by random-projection hashing of unit vectors. Filters
    are for afterwards: fewer than k may then be left."""
    import numpy as np
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    from stratamem.functions.vectors import l2_normalised

    q = np.asarray(query, float)
    unit = vectors.where(F.size(vector) == len(query)).select(id_, array_to_vector(l2_normalised(vector)).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=7).fit(unit)
    near = model.approxNearestNeighbors(unit, Vectors.dense(q / (np.linalg.norm(q) or 1)), k, distCol="d")
    return near.select(id_, (F.col("d") * F.col("d") / 2).alias("distance"))


def approximate_nearest_each(vectors: DataFrame, queries: DataFrame, k: int, id_: str, vector: str = "vector", bucket: float = 0.6, tables: int = 8) -> DataFrame:
    """(query_id, id, distance): `approximate_nearest` for every row of `queries` (query_id, vector). All vectors are of one
    length. Pairs that share a bucket are joined, then ranked per query."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from stratamem.functions.vectors import l2_normalised
    from stratamem.operators.retrieval import best_each

    unit = vectors.select(F.col(id_).alias("id"), array_to_vector(l2_normalised(vector)).alias("v"))
    asked = queries.select(F.col("query_id").alias("id"), array_to_vector(l2_normalised(vector)).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=7).fit(unit)
    pairs = model.approxSimilarityJoin(asked, unit, 2.1, distCol="d")  # unit vectors are at most 2 apart
    return best_each(pairs.select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("id"), (F.col("d") * F.col("d") / 2).alias("distance")), k)
