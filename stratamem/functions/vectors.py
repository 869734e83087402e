"""Vector arithmetic: column expressions for single distances, Arrow batches where rows are wide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column | str, b: Column | str) -> Column:
    pair = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine similarity; null where a vector is null, or has no direction."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distances_to(vector: Column | str, query: list[float]) -> Column:
    """Cosine distance of each row's vector to one query, in Arrow batches; null for another length or no direction."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf(T.DoubleType())
    def far(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = np.full(len(s), np.nan)
            fit = [i for i, v in enumerate(s) if v is not None and len(v) == len(q)]
            if fit:
                x = np.stack([s.iloc[i] for i in fit]).astype(np.float64)
                n = np.sqrt((x * x).sum(1))
                with np.errstate(all="ignore"):
                    out[fit] = 1 - (x @ q) / n
            yield pd.Series(out).where(np.isfinite(out), None)

    return far(vector)


def l2_normalised(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


HELD_MB = 64  # of sums, in each Python worker


def mean_pool(df: DataFrame, key: str, vector: str, per_length: bool = False) -> DataFrame:
    """(key, n, mean): the component means of each key's vectors, over those of its shortest length; with `per_length` one
    row for each length (key, length, n, mean). Null and empty vectors are left out; a null component makes its mean NaN.

    Each task adds up its vectors per key and length, and only these sums are shuffled, as bytes: a key with very many
    vectors is no hot spot, and no component is a row."""
    kind = df.schema[key].dataType

    def rows(held: dict) -> pa.RecordBatch:
        ks = list(held)
        arrow = pa.array([k for k, _ in ks], to_arrow_type(kind))
        return pa.RecordBatch.from_arrays([arrow, pa.array([m for _, m in ks], pa.int32()), pa.array([held[k][0] for k in ks], pa.int64()), pa.array([held[k][1].tobytes() for k in ks], pa.binary())], ["k", "length", "n", "s"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for b in batches:
            codes, names = pd.factorize(np.array(b.column(0).to_pylist(), object), use_na_sentinel=False)
            column = b.column(1)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            lens = np.diff(offsets)
            for m in np.unique(lens):
                own = np.flatnonzero(lens == m)
                own = own[np.argsort(codes[own], kind="stable")]
                x = values[offsets[own][:, None] + np.arange(m)].astype(np.float64)
                groups, first, count = np.unique(codes[own], return_index=True, return_counts=True)
                for g, n, s in zip(groups, count, np.add.reduceat(x, first, axis=0)):
                    if (at := (names[g], int(m))) in held:
                        held[at][0] += int(n)
                        held[at][1] += s
                    else:
                        held[at] = [int(n), s.copy()]
                        size += s.nbytes
            if size > HELD_MB * 2**20:
                yield rows(held)
                held, size = {}, 0
        if held:
            yield rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for b in batches:
            done: dict[tuple, list] = {}
            for k, m, n, s in zip(*(c.to_pylist() for c in b.columns)):
                if last is not None and (k, m) != last:
                    done |= held
                    held = {}
                s = np.frombuffer(s, np.float64)
                held[k, m] = [held[k, m][0] + n, held[k, m][1] + s] if (k, m) in held else [n, s]
                last = (k, m)
            if done:
                yield rows(done)
        if held:
            yield rows(held)

    schema = T.StructType([T.StructField("k", kind), T.StructField("length", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.BinaryType())])
    parts = df.where(F.size(vector) > 0).select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(partial, schema)
    sums = parts.repartition("k").sortWithinPartitions("k", "length").mapInArrow(merge, schema)
    if not per_length:
        sums = sums.withColumn("first", F.min("length").over(Window.partitionBy("k"))).where("length = first")
    mean = _means("s", "n")
    return sums.select(F.col("k").alias(key), *(["length"] if per_length else []), "n", mean.alias("mean"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _means(sums: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(s, np.float64) / m for s, m in zip(sums, n)], dtype=object)


@F.pandas_udf(T.BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """The bytes of a vector as little-endian float32."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(v: pd.Series) -> pd.Series:
    return v.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f4"))


SKETCH_DIM = 32


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 code units, as a long."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    start = F.lit(2166136261).cast("long")
    return F.aggregate(units, start, lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def property_features(prefix: Column, props: Column) -> Column:
    """prefix + key=value for every member of a JSON object, in order of the keys, values as compact JSON; else none."""
    members = F.map_entries(F.try_variant_get(F.try_parse_json(props), "$", "map<string,variant>"))
    named = F.transform(members, lambda e: F.concat(prefix, e["key"], F.lit("="), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    return F.coalesce(F.array_sort(named), F.array().cast("array<string>"))


def label_features(kind: Column, props: Column) -> Column:
    """The features of one label: its kind and its properties."""
    own = F.when(kind.isNotNull(), F.array(F.concat(F.lit("label:"), kind))).otherwise(F.array().cast("array<string>"))
    return F.concat(own, property_features(F.concat(F.lit("labelProp:"), kind, F.lit(":")), props))


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x worked out once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def sketch(features: Column, dim: int = SKETCH_DIM) -> Column:
    """A signed hash sketch of a list of features at length 1; zeros where there are none. Each feature adds to two places, the
    second by half, if they are different ones."""
    unit = dim**-0.5
    part = lambda h, i, x: F.when(F.pmod(h, F.lit(dim)) == i, F.when(h % 2 == 0, F.lit(x)).otherwise(F.lit(-x))).otherwise(0.0)
    both = lambda h: lambda x, i: x + part(h["a"], i, unit) + F.when(F.pmod(h["a"], F.lit(dim)) != i, part(h["b"], i, unit / 2)).otherwise(0.0)
    hashes = lambda f: F.struct(fnv1a(f).alias("a"), fnv1a(F.concat(f, F.lit("\0#"))).alias("b"))
    added = lambda v, f: _bound(hashes(f), lambda h: F.transform(v, both(h)))
    unit_length = lambda v: _bound(F.struct(v.alias("v"), norm(v).alias("n")), lambda r: F.transform(r["v"], lambda x: F.when(r["n"] > 0, x / r["n"]).otherwise(0.0)))
    return F.aggregate(features, F.array_repeat(F.lit(0.0), dim), added, unit_length)
