"""Ranked retrieval: BM25 and vector arms, Reciprocal Rank Fusion, the hybrid search with neighbour expansion."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.functions.text import porter, stems, tokens, unicode_words
from stratamem.functions.vectors import distances_to
from stratamem.schema import DEFAULT_TOP_K, RRF_K
from stratamem.sources.tables import keep, spread

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
ROW_BLOCK, QUERY_BLOCK = 8_192, 1_024


@dataclass(frozen=True)
class Phrase:
    """Words in a row; with `prefix` the last stands for all words that begin with it."""

    words: tuple[str, ...]
    prefix: bool = False


def parse_query(text: str, stem: bool) -> list[list[Phrase]]:
    """All groups must match, by any of their phrases: a plain word of three letters or more also as a prefix."""
    groups = []
    for raw in text.split():
        words = tuple(porter(w) if stem else w for w in unicode_words(raw))
        groups.append([Phrase(words), *([Phrase(words, True)] if raw.isalnum() and len(raw) >= 3 else [])])
    return groups


def _hits(words: Column, p: Phrase) -> Column:
    """How often a phrase occurs in an array of words."""
    if not p.words:
        return F.lit(0)
    if len(p.words) == 1:
        w = p.words[0]
        return F.size(F.filter(words, lambda x: x.startswith(w) if p.prefix else x == w))
    n = len(p.words)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.slice(words, i, F.lit(n)) == F.array(*map(F.lit, p.words)))
    return F.size(at)


def bm25(chunks: DataFrame, query: str, stem: bool = True, text: str = "text", words: str | None = None) -> DataFrame:
    """`chunks` with a `score` (negative, best least) where the query matches. Counts and lengths are those of all of
    `chunks`, so restrict the scope of the result, not the input. One pass; nothing is exploded. `words` names a column that
    holds the stems (or tokens) already, as the store writes them; then no text is read."""
    groups = parse_query(query, stem)
    phrases = [p for g in groups for p in g]
    if not phrases or any(not g[0].words for g in groups):
        return chunks.withColumn("score", F.lit(0.0)).where(F.lit(False))
    parted = chunks.withColumn("_w", F.col(words)) if words else spread(chunks).withColumn("_w", stems(text)) if stem else chunks.withColumn("_w", tokens(text))
    counted = parted.select(*chunks.columns, F.size("_w").alias("_dl"), *[_hits(F.col("_w"), p).alias(f"_tf{i}") for i, p in enumerate(phrases)])
    stats = counted.agg(F.count("*").alias("n"), F.sum("_dl").alias("len"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))]).first()
    n, mean = stats["n"] or 0, (stats["len"] or 0) / max(1, stats["n"] or 0)
    score, at, match = F.lit(0.0), 0, F.lit(True)
    for g in groups:
        any_ = F.lit(False)
        for _ in g:
            df, tf = stats[f"df{at}"] or 0, F.col(f"_tf{at}")
            idf = F.greatest(F.log((F.lit(float(n - df)) + 0.5) / (F.lit(float(df)) + 0.5)), F.lit(IDF_FLOOR))
            score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.lit(mean or 1.0)))
            any_, at = any_ | (tf > 0), at + 1
        match = match & any_
    return counted.where(match).select(*chunks.columns, score.alias("score"))


def nearest(vectors: DataFrame, query: list[float], k: int, id_: str, vector: str = "vector", max_distance: float | None = None) -> DataFrame:
    """(id, distance): the k nearest rows by cosine distance, among those of the query's length; ties by id."""
    far = vectors.where(F.size(vector) == len(query)).select(id_, distances_to(vector, query).alias("distance")).where("distance IS NOT NULL")
    if max_distance is not None:
        far = far.where(F.col("distance") <= max_distance)
    return far.orderBy("distance", id_).limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, id_: str, vector: str = "vector", max_distance: float | None = None) -> DataFrame:
    """(query_id, id, distance): `nearest` for every row of `queries` (query_id, vector), each among the rows of its own
    length; distances equal to 12 places are ties. Blocks of queries meet blocks of rows, so a task holds one of each; the
    best of the blocks are merged per query. Queries without direction find nothing."""
    sized = lambda df, i: df.where(F.size(vector) > 0).select(F.col(i).alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("length"))
    rows, asked = sized(vectors, id_), sized(queries, "query_id")
    blocks = lambda df, each, name: df.groupBy("length").agg(F.ceil(F.count("*") / each).cast("int").alias(name))
    sizes = F.broadcast(blocks(rows, ROW_BLOCK, "nr").join(blocks(asked, QUERY_BLOCK, "nq"), "length"))  # a row a length
    at = lambda df, n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kind, asked_kind = dict(rows.dtypes)["id"], dict(asked.dtypes)["id"]
    left = rows.join(sizes, "length").withColumn("r", at(rows, "nr")).withColumn("q", all_("nq")).select("length", "r", "q", "id", "vector")
    right = asked.join(sizes, "length").withColumn("q", at(asked, "nq")).withColumn("r", all_("nr")).select("length", "r", "q", "id", "vector")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": b["id"].iloc[:0], "id": a["id"].iloc[:0], "distance": []})
        x, y = (np.stack(v["vector"].to_list()).astype(np.float64) for v in (a, b))
        with np.errstate(all="ignore"):
            far = 1 - (y @ x.T) / (np.sqrt((y * y).sum(1))[:, None] * np.sqrt((x * x).sum(1)))
        far = np.where(np.isfinite(far) & (far <= (np.inf if max_distance is None else max_distance)), far.round(12), np.inf)
        last = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1]
        i, j = np.nonzero((far <= last[:, None]) & np.isfinite(far))
        return pd.DataFrame({"query_id": b["id"].to_numpy()[i], "id": a["id"].to_numpy()[j], "distance": far[i, j]})

    by = ["length", "r", "q"]
    found = left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(meet, f"query_id {asked_kind}, id {kind}, distance double")
    return best_each(found, k)


def best_each(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; ties by id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "distance")


def ranked(df: DataFrame, id_: str, *order: Column | str, per: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(per..., id, rank): 1-based positions. A global rank is given to the first `limit` rows only."""
    if not per:
        if limit is None:
            raise ValueError("a global rank needs a limit")
        df = df.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*(per or [F.lit(0)])).orderBy(*order))
    out = df.select(*(per or []), F.col(id_).alias("id"), rank.alias("rank"))
    return out if limit is None else out.where(F.col("rank") <= limit)


@dataclass
class Arm:
    """A ranked list (id, rank and perhaps boost, and the columns of `per`)."""

    name: str
    rows: DataFrame
    weight: float = 1.0
    limit: int | None = None
    per: list[str] = field(default_factory=list)


def fuse(arms: list[Arm], k: int = RRF_K, item_boosts: DataFrame | None = None) -> DataFrame:
    """(per..., id, score, contributions): weight * boosts / (k + rank), summed in the order of the arms."""
    rows, per = None, arms[0].per
    for i, a in enumerate(arms):
        r = a.rows if a.limit is None else a.rows.where(F.col("rank") <= a.limit)
        boost = F.col("boost") if "boost" in r.columns else F.lit(1.0)
        r = r.select(*per, "id", F.lit(i).alias("arm_no"), F.lit(a.name).alias("arm"), F.col("rank").cast("int").alias("rank"), boost.alias("boost"), F.lit(float(a.weight)).alias("weight"))
        rows = r if rows is None else rows.unionByName(r)
    if item_boosts is not None:
        rows = rows.join(item_boosts.select("id", F.col("boost").alias("item_boost")), "id", "left").fillna(1.0, ["item_boost"])
    else:
        rows = rows.withColumn("item_boost", F.lit(1.0))
    rows = rows.withColumn("score", F.col("weight") * F.col("boost") * F.col("item_boost") / (F.lit(k) + F.col("rank")))
    parts = F.array_sort(F.collect_list(F.struct("arm_no", "rank", "arm", "score")))  # as many as arms
    fused = rows.groupBy(*per, "id").agg(parts.alias("parts"))
    return fused.select(*per, "id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["score"]).alias("score"),
                        F.transform("parts", lambda x: F.struct(x["arm"].alias("arm"), x["rank"].alias("rank"), x["score"].alias("score"))).alias("contributions"))


def overfetch(top_k: int) -> int:
    return max(5 * top_k, 25)


def resolve_method(requested: str | None = None, available: tuple[str, ...] = ("ann", "knn")) -> str | None:
    """How vectors are searched: what is asked for, if it is available (else not at all); without a wish ann before knn."""
    if requested is not None:
        return requested if requested in available else None
    return next((m for m in ("ann", "knn") if m in available), None)


def distances(vectors: DataFrame, query: list[float], max_distance: float | None = None) -> DataFrame:
    """`vectors` of the query's length with `distance`, without their vectors."""
    far = vectors.where(F.size("vector") == len(query)).select(*[c for c in vectors.columns if c != "vector"], distances_to("vector", query).alias("distance")).where("distance IS NOT NULL")
    return far if max_distance is None else far.where(F.col("distance") <= max_distance)


def hybrid_search(chunks: DataFrame, vectors: DataFrame | None, *, text: str | None, vector: list[float] | None = None, top_k: int = DEFAULT_TOP_K, scope: DataFrame | None = None, memory_ids: list[str] | None = None,
                  where: Column | None = None, labels: tuple[list[str], list[str]] | None = None, min_score: float | None = None, weights: tuple[float, float] = (1.0, 1.0), max_distance: float | None = None,
                  stem: bool = True, words: str | None = None, method: str | None = "knn", neighbours: DataFrame | None = None, max_neighbours: int | None = None) -> DataFrame:
    """(id, score, memory_id, kinds): fused hits of a lexical and a vector arm over source maps, best first.

    chunks: id, memory_id, text, kinds; vectors: id, memory_id, vector. What may be seen is settled before the arms are ranked:
    scope (a table of memory_ids), memory_ids (a short list; an empty one allows nothing) and `where` (a predicate on the
    columns of both tables, such as as-of bounds). Word statistics are those of all chunks. Arms fetch five times top_k (25 at
    least); with the method ann the vector arm is cut to as many before what may be seen is settled. Labels (all, some) and
    min_score are applied to the fused list, then top_k.

    With neighbours (memory_id, neighbour_id) each hit has `neighbours`: the memos next to its own, inside the hit's
    namespace, that match the same query, ranked by the same arms among themselves (`neighbour_search`); chunks and vectors
    then have a namespace too."""
    n, method = overfetch(top_k), resolve_method(method)
    rule = F.lit(True) if where is None else where
    rule = rule if memory_ids is None else rule & F.col("memory_id").isin(memory_ids)
    inside = (lambda d: d.where(rule) if scope is None else d.where(rule).join(scope.select("memory_id").distinct(), "memory_id", "left_semi"))
    lexical = inside(bm25(chunks, text, stem, words=words)) if text and weights[0] > 0 else None
    asked = vector is not None and vectors is not None and weights[1] > 0 and method is not None
    far = inside(distances(vectors, vector, max_distance)) if asked else None
    if (lexical is None and far is None) or top_k <= 0:
        none = chunks.select("id", F.lit(0.0).alias("score"), "memory_id", "kinds").where(F.lit(False))
        return none if neighbours is None else none.withColumn("neighbours", F.lit(None).cast(NEIGHBOURS))
    near = far
    if asked and method == "ann":
        from stratamem.operators.links import approximate_nearest

        near = approximate_nearest(vectors, vector, n, "id").join(inside(vectors).select("id"), "id", "left_semi")
        near = near if max_distance is None else near.where(F.col("distance") <= max_distance)
    arms = [Arm("lexical", ranked(lexical, "id", "score", "id", limit=n), weights[0])] if lexical is not None else []
    arms += [Arm("vector", ranked(near, "id", "distance", "id", limit=n), weights[1])] if near is not None else []
    hits = fuse(arms).drop("contributions")
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    rows = hits.join(chunks.select("id", "memory_id", "kinds", *(["namespace"] if neighbours is not None else [])), "id")
    if labels:
        from stratamem.operators.predicates import has_labels

        rows = rows.where(has_labels("kinds", *labels))
    rows = rows.orderBy(F.desc("score"), "id").limit(top_k)
    if neighbours is None:
        return rows
    rows = keep(rows, "hits")
    found = neighbour_search(rows, neighbours, lexical, far, weights=weights, min_score=min_score, cap=max_neighbours)
    lists = found.groupBy("hit_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "memory_id", "id", "score"))).alias("neighbours"))  # of top_k hits
    out = rows.join(lists.withColumnRenamed("hit_id", "id"), "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(NEIGHBOURS)))
    return out.select("id", "score", "memory_id", "kinds", "neighbours").orderBy(F.desc("score"), "id")


NEIGHBOURS = "array<struct<rank: int, memory_id: string, id: string, score: double>>"


def neighbour_search(hits: DataFrame, neighbours: DataFrame, lexical: DataFrame | None, far: DataFrame | None, *, weights: tuple[float, float] = (1.0, 1.0), min_score: float | None = None, cap: int | None = None) -> DataFrame:
    """(hit_id, memory_id, id, score, rank): the neighbours of each hit, ranked for the same query.

    hits: id, memory_id, namespace; lexical: id, memory_id, namespace, score (least best); far: the same with distance. The arms are
    ranked among the chunks of a hit's neighbours alone, each to five times the cap (without one: the number of neighbours, 10
    at least) or 25; of a neighbour only its best chunk counts. Neighbours without a match, and those outside the hit's
    namespace, vanish."""
    pairs = hits.select(F.col("id").alias("hit_id"), "memory_id", F.col("namespace").alias("hit_ns")).join(neighbours.select("memory_id", "neighbour_id").distinct(), "memory_id")
    pairs = pairs.select("hit_id", "hit_ns", F.col("neighbour_id").alias("memory_id"))
    most = F.greatest(F.lit(25), 5 * (F.lit(cap) if cap is not None else F.greatest(F.lit(10), F.count("*").over(Window.partitionBy("hit_id")))))
    pairs = keep(pairs.withColumn("most", most), "neighbours")
    inside = (F.col("namespace") == F.col("hit_ns")) | F.col("namespace").startswith(F.concat("hit_ns", F.lit("/")))

    def arm(name: str, rows: DataFrame, by: str, weight: float) -> Arm:
        met = rows.select("id", "memory_id", "namespace", by).join(pairs, "memory_id").where(inside)
        place = F.row_number().over(Window.partitionBy("hit_id").orderBy(by, "id"))
        return Arm(name, met.withColumn("rank", place).where(F.col("rank") <= F.col("most")).select("hit_id", "id", "rank"), weight, per=["hit_id"])

    arms = [arm("lexical", lexical, "score", weights[0])] if lexical is not None else []
    arms += [arm("vector", far, "distance", weights[1])] if far is not None else []
    fused = fuse(arms).drop("contributions")
    fused = fused if min_score is None else fused.where(F.col("score") >= min_score)
    owner = [d.select("id", "memory_id") for d in (lexical, far) if d is not None]
    owned = fused.join((owner[0] if len(owner) == 1 else owner[0].union(owner[1])).distinct(), "id")
    first = owned.groupBy("hit_id", "memory_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b")).select("hit_id", "memory_id", "b.id", (-F.col("b.s")).alias("score"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("hit_id").orderBy(F.desc("score"), "id")))
    return out.select("hit_id", "memory_id", "id", "score", "rank") if cap is None else out.where(F.col("rank") <= cap).select("hit_id", "memory_id", "id", "score", "rank")


def expand(hits: DataFrame, neighbours: DataFrame, scored: DataFrame, cap: int | None = None, inside: bool = True) -> DataFrame:
    """Neighbours of each hit, ranked for the same query: (hit_id, neighbour_id, id, score, rank).

    hits: id, memory_id, namespace; neighbours: memory_id, neighbour_id; scored: id, memory_id, namespace, score (greater is
    better) of chunks that match the query. Only the best chunk of a neighbour counts; neighbours without one vanish, as do
    those outside the hit's own namespace subtree (`inside`)."""
    pairs = hits.select(F.col("id").alias("hit_id"), "memory_id", F.col("namespace").alias("hit_ns")).join(neighbours.select("memory_id", "neighbour_id").distinct(), "memory_id")
    found = pairs.drop("memory_id").join(scored.select(F.col("memory_id").alias("neighbour_id"), "id", F.col("namespace").alias("ns"), "score"), "neighbour_id")
    if inside:
        found = found.where((F.col("ns") == F.col("hit_ns")) | F.col("ns").startswith(F.concat("hit_ns", F.lit("/"))))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("hit_id", "neighbour_id").orderBy(F.desc("score"), "id"))).where("n = 1")
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy("hit_id").orderBy(F.desc("score"), "id"))).select("hit_id", "neighbour_id", "id", "score", "rank")
    return out if cap is None else out.where(F.col("rank") <= cap)
