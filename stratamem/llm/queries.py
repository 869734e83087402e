"""Queries p2, p5, p6, p7 and p8, with the SQL of those that SQL can state over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import leaks as L
from stratamem.llm import neighbours as N
from stratamem.llm import packing as K
from stratamem.llm import residue as R
from stratamem.llm import splitting as S
from stratamem.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return S.counts(table(spark, d, "text_to_content")).where("n_pieces > 1").select("input_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return S.pieces(table(spark, d, "text_to_content"))


def p2_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.recount(table(spark, d, "text_to_content"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return N.neighbours(table(spark, d, "vector_features").select(F.col("source_map_id").alias("id"), "vector"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return N.pairs(_neighbours(spark, d)).select(F.col("a").alias("source_map_id_a"), F.col("b").alias("source_map_id_b"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select(F.col("id").alias("source_map_id"), "rank", "neighbour", "similarity")


def p6_batches(spark: SparkSession, d: str) -> DataFrame:
    return K.pack(K.token_counts(table(spark, d, "documents")))


def p6_waste(spark: SparkSession, d: str) -> DataFrame:
    return K.waste(p6_batches(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The passages of p7_near that differ in no word."""
    return p7_near(spark, d).where("edits = 0").select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Also passages that differ in up to NEAR_EDITS words."""
    return L.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return R.residue(table(spark, d, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    return R.residue(table(spark, d, "documents"))


def p8_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How many documents the model and the weak labels alone call residue, by what each says."""
    return R.residue(table(spark, d, "documents"), labels=True).groupBy("kind", "by_labels").agg(F.count("*").alias("n"))


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    return R.train(table(spark, d, "documents"))[1]


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_chunk_counts, p5_found, p5_neighbours, p6_batches, p6_waste, p7_found, p7_near, p8_found, p8_kinds, p8_agreement, p8_validation)}

_NEAR = """
WITH one AS (SELECT source_map_id AS id, any_value(vector) AS v FROM vector_features
  WHERE source_map_id IS NOT NULL AND len(vector) IN (512, 768) AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1),
unit AS (SELECT id, CAST(v AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS n FROM one),
near AS (SELECT a.id, b.id AS neighbour, list_dot_product(a.v, b.v) / (a.n * b.n) AS s, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v) / (a.n * b.n), 12) DESC, b.id) AS rank
  FROM unit a JOIN unit b ON len(a.v) = len(b.v) AND a.id <> b.id QUALIFY rank <= 5)"""  # brute force

SQL = {
    "p5_found": _NEAR + " SELECT DISTINCT least(id, neighbour) AS source_map_id_a, greatest(id, neighbour) AS source_map_id_b FROM near",
    "p2_found": """
SELECT DISTINCT input_id FROM text_to_content
WHERE length(trim(replace(text, E'\\r\\n', E'\\n'), E' \\t\\n')) > CASE WHEN max_chunk_chars >= 1 THEN max_chunk_chars ELSE 2000 END""",
}
