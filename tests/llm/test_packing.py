import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratamem.llm import packing as K


def used(plan):
    return Counter(s for sizes, n in plan for s in sizes for _ in range(n))


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 20), max_size=12))
def test_plan_places_every_item_once(count):
    plan = K.plan(Counter(count), 30)
    assert all(sum(sizes) <= 30 and n > 0 for sizes, n in plan) and used(plan) == Counter(count)


def best(items, capacity):
    """The least number of containers, by search."""
    items = sorted(items, reverse=True)
    found = [len(items)]

    def go(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(items):
            found[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return found[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_never_costs_a_container(items):
    count = Counter(items)
    fixed = K.reduce_dominated(count, 20)
    assert sum(n for _, n in fixed) + best(list(count.elements()), 20) == best(items, 20)


def test_large_histogram_is_close_to_full():
    rng = random.Random(1)
    count = Counter(min(1024, int(rng.lognormvariate(5, 1)) + 1) for _ in range(200_000))
    plan = K.plan(count)
    n, least = sum(n for _, n in plan), -(-sum(s * c for s, c in count.items()) // 1024)
    assert n <= least * 1.01 and len(plan) < 20_000


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(K, "ITEMS_PER_TASK", 5)
    rows = [(i, n) for i, n in enumerate([0, 3, 3, 3, 10, 25, 7, 7, 1, 9] * 12)]
    out = K.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 10).collect()
    sums, parts = defaultdict(int), defaultdict(list)
    for r in out:
        parts[r["doc_id"]].append((r["piece_no"], r["n_tokens"]))
        if r["batch_id"] is not None:
            sums[r["batch_id"]] += r["n_tokens"]
    assert max(sums.values()) <= 10 and set(sums) == set(range(len(sums)))
    for i, n in rows:
        assert sum(t for _, t in parts[i]) == n and len(parts[i]) == max(1, -(-n // 10)) and sorted(k for k, _ in parts[i]) == list(range(len(parts[i])))
    assert K.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "a" * 100_000), (1, "Hello world"), (None, "Hello"), (2**60 + 1, "Hello")], "doc_id long, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in K.token_counts(df).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1000 and n[None] == n[2**60 + 1] == 1
    w = K.waste(K.pack(K.token_counts(df.where("doc_id BETWEEN 2 AND 4")))).first()
    assert w["n_tokens"] == n[4] and w["fullest"] <= K.CAPACITY and w["n_batches"] == w["least_batches"]
    assert K.waste(K.pack(K.token_counts(df.limit(0)))).first()["n_batches"] == 0
