"""Filling containers of fixed capacity with texts of varying length.

Sizes are whole tokens from 1 to the capacity, so a problem of any number of texts is its histogram: at most `capacity`
counts, which alone come to the driver. There Martello and Toth's reduction fixes the sets that dominate all others
(batch-wise: what holds for one item holds for all of its size), and best-fit decreasing packs the rest. The plan, whose
size depends on the capacity only, then gives each text its container from its rank among texts of equal size; the
ranks are counted in salted groups, so that no size gathers in one task.

Defined cases: a text larger than the capacity fills containers of its own, and what is left over is an item like any
other (piece_no counts them); rows aren't told apart by doc_id, so equal and null ids are placed row by row; null and empty texts have no tokens and no container (null batch_id); ties are broken by
doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamem.sources.tables import keep, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 1024
ITEMS_PER_TASK = 500_000


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id and n_tokens of every document, over its whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    named = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return named.mapInPandas(run, "doc_id string, n_tokens long").withColumn("doc_id", F.col("doc_id").cast("long"))


def reduce_dominated(count: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes from `count` the item sets that dominate all other sets with their largest item; (sizes, times) of each."""
    fixed = []

    def take(sizes: tuple[int, ...]) -> None:
        need = Counter(sizes)
        times = min(count[s] // n for s, n in need.items())
        for s, n in need.items():
            count[s] -= n * times
            if not count[s]:
                del count[s]
        fixed.append((sizes, times))

    for j in sorted(count, reverse=True):
        while count[j]:
            count[j] -= 1
            free = sorted(s for s, n in count.items() if n)
            room = capacity - j
            least = [s for s in free[:3] for _ in range(min(3, count[s]))][:3]
            fitting = [s for s in free if s <= room]
            best = fitting[-1] if fitting else None
            count[j] += 1
            if best is None:
                take((j,))
            elif best == room or len(least) < 2 or least[0] + least[1] > room:
                take((j, best))
            elif len(least) < 3 or sum(least) > room:
                own = count - Counter([j])
                pair = _best_pair(fitting, own, room)
                if pair is None or best >= sum(pair):
                    take((j, best))
                    continue
                a, b = pair
                between = [s for s in free if b < s < a]
                before = [s for s in between for _ in range(min(2, own[s]))][:2] + [a] * min(2, own[a]) if b != a else []
                if best == a and (b == a or sum(own[s] for s in between) <= 1 or (len(before) > 1 and before[0] + before[1] > room)):
                    take((j, a, b))
                else:
                    break
            else:
                break
    return fixed


def _best_pair(fitting: list[int], own: Counter, room: int) -> tuple[int, int] | None:
    """The two free sizes (a >= b) with the largest sum within the room."""
    best, lo, hi = None, 0, len(fitting) - 1
    while lo <= hi:
        a, b = fitting[hi], fitting[lo]
        if a + b > room or (lo == hi and own[a] < 2):
            hi -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        lo += 1
    return best


def best_fit(count: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal items go into equal containers together."""
    open_: dict[int, dict[tuple, int]] = defaultdict(dict)

    def add(room: int, content: tuple, times: int) -> None:
        if times:
            open_[room][content] = open_[room].get(content, 0) + times

    for size in sorted(count, reverse=True):
        left = count[size]
        while left:
            rooms = [r for r in open_ if r >= size and open_[r]]
            if rooms:
                room = min(rooms)
                content, times = open_[room].popitem()
            else:
                room, content, times = capacity, (), -(-left // (capacity // size))
            each = room // size
            full = min(times, left // each)
            add(room - each * size, content + (size,) * each, full)
            left -= full * each
            if full < times:
                add(room - left * size, content + (size,) * left, 1)
                if content:
                    add(room, content, times - full - 1)
                left = 0
    return [(content, times) for contents in open_.values() for content, times in contents.items() if content]


def plan(count: Counter, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(sizes, times): containers with these sizes, so many times."""
    count = Counter({s: n for s, n in count.items() if n > 0})
    return reduce_dominated(count, capacity) + best_fit(count, capacity)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """(size, first ranks, containers they start at, items a container): where the ranks of a size go."""
    at, rank, slots = 0, Counter(), defaultdict(list)
    for sizes, times in patterns:
        for size, each in Counter(sizes).items():
            slots[size].append((rank[size], at, each))
            rank[size] += each * times
        at += times
    return [(size, [list(x) for x in rows]) for size, rows in slots.items()]


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece_no, n_tokens, batch_id of (doc_id, n_tokens)."""
    spark, sizes = sizes.sparkSession, keep(sizes, "sizes")
    items = keep(sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.expr(f"CAST((n_tokens - 1) DIV {capacity} AS INT)"))).alias("piece_no", "k")).select(
        "doc_id", "piece_no", F.least(F.lit(capacity), F.col("n_tokens") - F.col("k") * capacity).cast("int").alias("size")), "items")
    count = Counter({r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()})  # at most `capacity` rows
    slots = spark.createDataFrame(_slots(plan(count, capacity)), "size int, slots array<array<long>>")
    salts = max(16, sum(count.values()) // ITEMS_PER_TASK)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))
    ahead = salted.groupBy("size", "salt").agg(F.count("*").alias("n")).withColumn("ahead", F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n"))
    ranked = salted.withColumn("in_group", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece_no")) - 1).join(ahead.drop("n"), ["size", "salt"])
    slot = F.expr("element_at(filter(slots, s -> s[0] <= rank), -1)")
    placed = ranked.withColumn("rank", F.col("ahead") + F.col("in_group")).join(F.broadcast(slots), "size").withColumn("slot", slot)  # slots: bounded by the capacity
    packed = placed.select("doc_id", "piece_no", F.col("size").cast("long").alias("n_tokens"), F.expr("slot[1] + (rank - slot[0]) DIV slot[2]").alias("batch_id"))
    none = sizes.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("batch_id"))
    return packed.unionByName(none)


def waste(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least containers possible by volume, and the share of unused space."""
    per = packed.where("batch_id IS NOT NULL").groupBy("batch_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("n_batches"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.max("used").alias("fullest")).select(
        "n_batches", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / capacity).alias("least_batches"),
        (1 - F.col("n_tokens") / F.nullif(F.col("n_batches"), F.lit(0)) / capacity).alias("unused_share"))
