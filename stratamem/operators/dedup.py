"""Semantic duplicates: clusters, threshold graph, connected components, survivors.

items: id, vector, text, created_at. Exact copies (equal vector and text) are one item for the pair search and rejoin it
as links to their smallest id, so a large group of copies makes no pairs. Links are only searched within a cluster, in
blocks of rows: a cluster of any size is spread over many tasks and no task holds more than two blocks, nor gives more links
than these have rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamem.functions.text import preview, tokens
from stratamem.operators.graph import components
from stratamem.operators.links import numbered
from stratamem.sources.tables import keep, spread

BLOCK = 2_048
MAX_ROUNDS = 40
DRIVER_BYTES = 32 << 20  # of sums that the tasks of a k-means round may send without a shuffle


def default_k(n: int) -> int:
    """Clusters for n items: the larger of 16 and the smaller of n / 32 and the root of n, from 1 to n."""
    return 1 if n <= 1 else max(1, min(n, max(16, min(max(1, n // 32), max(1, math.isqrt(n))))))


def seeded(seed: int):
    """The mulberry32 generator of numbers in [0, 1)."""
    state, full = seed & 0xFFFFFFFF, 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & full
        t = ((state ^ state >> 15) * (1 | state)) & full
        t ^= (t + ((t ^ t >> 7) * (61 | t) & full)) & full
        return ((t ^ t >> 14) & full) / 4294967296

    return draw


def _closest(unit: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The first of the closest centroids; products equal to 12 places are ties, as the order of a sum differs with the block."""
    return (unit @ c.T).round(12).argmax(1)


def centroids(unit: np.ndarray, k: int, rounds: int = MAX_ROUNDS, seed: int = 1) -> np.ndarray:
    """Spherical k-means: seeds are drawn rows, an empty cluster keeps its centroid, ties go to the first one."""
    n = len(unit)
    if not n:
        return unit[:0]
    draw, picked = seeded(seed), []
    while len(picked) < max(1, min(k, n)):
        i = int(draw() * n)
        if i not in picked:
            picked.append(i)
    c, old = unit[picked].copy(), None
    for _ in range(rounds):
        at = _closest(unit, c)
        for j in np.unique(at):
            mean = unit[at == j].mean(0)
            c[j] = mean / (np.linalg.norm(mean) or 1)
        if old is not None and (at == old).all():
            break
        old = at
    return c


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if len(x) else x


@F.pandas_udf(T.BinaryType())
def _packed(v: pd.Series) -> pd.Series:
    """Unit vectors as bytes, which pass between the JVM and Python without a step per component."""
    return pd.Series([x.tobytes() for x in _unit(v)], dtype=object)


def _moved(packed: DataFrame, c: np.ndarray, tasks: int) -> np.ndarray:
    """The centroids after one round over all rows: sums and counts per cluster and task, added up per cluster in the order
    of the tasks, so that equal assignments give equal centroids."""
    k, dim = c.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros((k, dim)), np.zeros(k, np.int64)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(0).to_pylist())).reshape(-1, dim)
            if not len(x):
                continue
            at = _closest(x, c)
            order = np.argsort(at, kind="stable")
            own, first = np.unique(at[order], return_index=True)
            s[own] += np.add.reduceat(x[order], first, axis=0)
            n += np.bincount(at, minlength=k)
        own = np.flatnonzero(n)
        task = np.full(len(own), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(task, pa.int32()), pa.array(n[own], pa.int64()), pa.array([s[i].tobytes() for i in own], pa.binary())], ["j", "task", "n", "s"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b) for b in pdf.sort_values("task")["s"]], axis=0)
        return pd.DataFrame({"j": pdf["j"].iloc[:1], "task": 0, "n": [pdf["n"].sum()], "s": [total.tobytes()]})

    sums, out = packed.mapInArrow(part, "j int, task int, n long, s binary"), c.copy()
    if tasks * k * dim * 8 > DRIVER_BYTES:
        sums = sums.groupBy("j").applyInPandas(add, "j int, task int, n long, s binary")
    got: dict[int, list] = {}
    for r in sums.collect():  # k centroids, or as many from each task if they are known to be few bytes
        got.setdefault(r["j"], []).append((r["task"], r["n"], np.frombuffer(bytes(r["s"]))))
    for j, parts in got.items():
        mean = np.sum([x for _, _, x in sorted(parts, key=lambda p: p[0])], axis=0) / sum(n for _, n, _ in parts)
        out[j] = mean / (np.linalg.norm(mean) or 1)
    return out


def assign(items: DataFrame, k: int | None = None, kept: bool = False) -> DataFrame:
    """`items` with `cluster`: `centroids` over all items at any number of them. Only the seeds are drawn, by number in order
    of id; each round is a pass over every item. kept: `items` is a written table. Items of different lengths of vector are
    refused."""
    items = items if kept else keep(items, "items")
    n = items.count()
    lens = [r[0] for r in items.select(F.size("vector")).distinct().limit(2).collect()]
    if len(lens) > 1:
        raise ValueError("vectors of different lengths")
    if not n:
        return items.withColumn("cluster", F.lit(None).cast("int"))
    draw, picked = seeded(1), {}
    while len(picked) < max(1, min(k or default_k(n), n)):
        picked.setdefault(int(draw() * n), len(picked))
    drawn = items.sparkSession.createDataFrame(list(picked.items()), "i long, place int")
    ids = numbered(items.select("id"), "id").join(F.broadcast(drawn), "i").select("id", "place")
    seeds = items.join(F.broadcast(ids), "id").orderBy("place").select("vector").collect()  # k of them
    c = _unit([r["vector"] for r in seeds])
    packed = keep(spread(items.select("vector")).select(_packed("vector").alias("x")), "packed")
    tasks = packed.rdd.getNumPartitions()
    for _ in range(MAX_ROUNDS):
        old, c = c, _moved(packed, c, tasks)
        if np.array_equal(old, c):
            break

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(_closest(_unit(v), c) if len(v) else [], dtype="int32")

    return items.withColumn("cluster", nearest("vector"))


def copies(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items with the smallest id of each group of exact copies, and the links (a, b) of the others to it."""
    keyed = items.withColumn("_same", F.xxhash64("vector", "text"))
    least = keyed.groupBy("cluster", "_same").agg(F.min_by(F.struct("id", "vector", "text"), "id").alias("r"))
    tied = keyed.join(least, ["cluster", "_same"])
    same = F.col("vector").eqNullSafe(F.col("r.vector")) & F.col("text").eqNullSafe(F.col("r.text"))
    return tied.where(~same | (F.col("id") == F.col("r.id"))).select(*items.columns), tied.where(same & (F.col("id") != F.col("r.id"))).select(F.col("r.id").alias("a"), F.col("id").alias("b"))


def _met(items: DataFrame) -> DataFrame:
    """`items` (cluster and others) once for each pair of blocks (i, j) of its cluster that its own block is in."""
    sizes = items.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = items.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def similar_pairs(items: DataFrame, epsilon: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of one cluster with cosine similarity of at least 1 - epsilon."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        s = _unit(left["vector"]) @ _unit(right["vector"]).T
        x, y = np.nonzero(s >= 1 - epsilon)
        a, b = left["id"].to_numpy()[x], right["id"].to_numpy()[y]
        ok = a < b if i == j else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a[ok], b[ok]), "b": np.maximum(a[ok], b[ok]), "similarity": s[x, y][ok]})

    kind = dict(items.dtypes)["id"]
    return _met(items.select("id", "vector", "cluster")).groupBy("cluster", "i", "j").applyInPandas(run, f"a {kind}, b {kind}, similarity double")


def _forest(s: np.ndarray, least: float, same: bool, alike: Callable[[int, int], bool]) -> tuple[np.ndarray, np.ndarray]:
    """The most similar links between rows and columns (of one block, if `same`) that join what is joined by the pairs of at least
    `least` that are alike: as many as there are rows at most, with which each threshold above gives the same groups."""
    x, y = np.nonzero(s >= least)
    if same:
        x, y = x[x < y], y[x < y]
    order = np.argsort(-s[x, y], kind="stable")
    x, y = x[order], y[order]
    off = 0 if same else s.shape[0]
    group, took = np.arange(off + s.shape[1]), []
    for c in range(0, len(x), 4096):
        rest = np.arange(c, min(c + 4096, len(x)))
        for k in rest[group[x[rest]] != group[y[rest] + off]]:
            a, b = group[x[k]], group[y[k] + off]
            if a != b and alike(x[k], y[k]):
                group[group == b] = a
                took.append(k)
    return x[took], y[took]


def links(items: DataFrame, epsilon: float, min_jaccard: float = 0.0) -> DataFrame:
    """(a, b, similarity): links that join within each cluster what is joined by all pairs with cosine similarity of at least 1 -
    epsilon whose texts' token sets overlap by at least min_jaccard. A block gives no more links than it has rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        s = _unit(left["vector"]) @ _unit(right["vector"]).T
        lw, rw = (side["words"].map(frozenset).to_list() for side in (left, right))

        def alike(x: int, y: int) -> bool:
            both = len(lw[x] & rw[y])
            return min_jaccard <= 0 or (both >= min_jaccard * (len(lw[x]) + len(rw[y]) - both) if lw[x] or rw[y] else min_jaccard <= 1)

        x, y = _forest(s, 1 - epsilon, i == j, alike)
        return pd.DataFrame({"a": left["id"].to_numpy()[x], "b": right["id"].to_numpy()[y], "similarity": s[x, y]})

    kind = dict(items.dtypes)["id"]
    words = F.transform(F.array_distinct(tokens("text")), lambda w: F.xxhash64(w)) if min_jaccard > 0 else F.array().cast("array<bigint>")
    return _met(items.select("id", "vector", "cluster", words.alias("words"))).groupBy("cluster", "i", "j").applyInPandas(run, f"a {kind}, b {kind}, similarity double")


def groups(items: DataFrame, epsilon: float = 0.05, min_jaccard: float = 0.1, without: DataFrame | None = None) -> DataFrame:
    """id, component, keep, n: the members of duplicate groups, one row each; `keep` marks the survivor (newest, then longest
    text, then smallest id). items carry cluster; an id may be in several clusters, with other vectors. `without`: ids left out, for a looser second band."""
    if without is not None:
        items = items.join(without.select("id"), "id", "left_anti")
    items = keep(items, "dedup")
    apart, tied = copies(items)
    members = components(links(apart, epsilon, min_jaccard).select("a", "b").union(tied))
    rows = members.join(items.select("id", "created_at", F.length(F.coalesce("text", F.lit(""))).alias("len")).dropDuplicates(["id"]), "id")
    best = rows.groupBy("component").agg(F.max(F.struct("created_at", "len")).alias("m"), F.count("*").alias("n"))
    first = rows.join(best, "component").where((F.col("created_at") == F.col("m.created_at")) & (F.col("len") == F.col("m.len"))).groupBy("component").agg(F.min("id").alias("kept"), F.first("n").alias("n"))
    return members.join(first, "component").select("id", "component", (F.col("id") == F.col("kept")).alias("keep"), "n")


def applied(items: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`items` without the duplicates, and (id, kept): what each duplicate is to be replaced by."""
    out = grouped.where("NOT keep").select("id", "component").join(grouped.where("keep").select("component", F.col("id").alias("kept")), "component").select("id", "kept")
    return items.join(out.select("id"), "id", "left_anti"), out


def keep_fraction(items: DataFrame, grouped: DataFrame) -> float:
    n, dropped = items.count(), grouped.where("NOT keep").count()
    return 1.0 if not n else (n - dropped) / n


def calibrate(items: DataFrame, target: float, min_jaccard: float = 0.1, rounds: int = 32, widest: float = 0.5) -> float:
    """The epsilon whose keep fraction comes closest to the target from above, by bisection over pairs computed once."""
    items = keep(items, "calibrate")
    apart, tied = copies(items)
    pairs = keep(links(apart, widest, min_jaccard), "pairs")  # the most similar ones: right for every narrower threshold
    n, low, high = items.count(), 0.0, widest
    for _ in range(rounds):
        mid = (low + high) / 2
        members = components(pairs.where(F.col("similarity") >= 1 - mid).select("a", "b").union(tied))
        r = members.agg(F.count("*").alias("n"), F.count_distinct("component").alias("c")).first()
        low, high = (mid, high) if n and (n - (r["n"] - r["c"])) / n >= target else (low, mid)
        if high - low < 1e-4:
            break
    return low


def previews(items: DataFrame, n: int = 240) -> DataFrame:
    return items.select("id", preview("text", n).alias("preview"))
