"""Files in and out: text export, file ingest, cold blobs, embedding batches, the graph projection codec."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.functions.text import paragraph_chunks

EMBED_BATCH = 100
TEXT_SUFFIXES = (".txt", ".md", ".json", ".csv", ".yaml", ".yml", ".html", ".xml")


def export_texts(chunks: DataFrame, path: str) -> None:
    """Writes memory_id, source_key, text as JSON lines."""
    chunks.select("memory_id", "source_key", "text").write.mode("overwrite").json(path)


def text_chunks(df: DataFrame, text: str, prefix: str | Column = "chunk", limit: int = 2000) -> DataFrame:
    """`df` without its text, with source_key (prefix:number) and the text of each paragraph chunk."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return df.select(*[c for c in df.columns if c != text], F.posexplode(paragraph_chunks(text, limit)).alias("n", "_text")).withColumn("source_key", F.concat(p, F.lit(":"), "n")).withColumnRenamed("_text", text).drop("n")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the text-like files below a folder; other files have a null text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    texty = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in TEXT_SUFFIXES) + ")$")
    return raw.select("path", F.when(texty, F.nullif(F.btrim(F.col("content").cast("string")), F.lit(""))).alias("text"))


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> DataFrame:
    """`df` with `vector`: the model is called for up to `batch` texts at a time and must give as many vectors."""
    schema = df.withColumn("vector", F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            for a in range(0, len(pdf), batch):
                texts = pdf[text].iloc[a : a + batch].tolist()
                vectors = model(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(texts)} texts, {len(vectors)} vectors")
                out += vectors
            yield pdf.assign(vector=out)

    return df.mapInPandas(run, schema)


def write_cold(blobs: DataFrame, path: str) -> None:
    """Adds blobs (content_sha256, payload) to the cold store, if the payload has that hash."""
    blobs.where(F.sha2("payload", 256) == F.col("content_sha256")).select("content_sha256", "payload").write.mode("append").parquet(path)


def read_cold(wanted: DataFrame, path: str) -> DataFrame:
    """content_sha256, payload of the wanted blobs, each once; a payload with another hash is left out. A cold store to which
    nothing was written yet is empty."""
    spark = wanted.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content_sha256 string, payload binary")
    cold = spark.read.parquet(path).where(F.sha2("payload", 256) == F.col("content_sha256"))
    return cold.join(wanted.select("content_sha256").distinct(), "content_sha256", "left_semi").dropDuplicates(["content_sha256"])


def write_projection(edges: DataFrame, path: str, gzip: bool = True) -> None:
    """Writes a graph projection, version 1, as JSON lines."""
    edges.select(F.lit(1).alias("version"), *edges.columns).write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def read_projection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reads it back; another version is refused."""
    rows = spark.read.schema(f"version int, {schema}").json(path)
    return rows.withColumn("version", F.when(F.col("version") == 1, 1).otherwise(F.raise_error(F.lit("unknown version")).cast("int"))).drop("version")
