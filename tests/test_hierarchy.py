import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stratamem.operators import hierarchy as H


def _links(spark, rows, parts=4):
    return H.links(spark.createDataFrame(rows, "root string, up string, node int").repartition(parts) if rows else spark.createDataFrame([], "root string, up string, node int"), "root", "up")


def brute(pairs):
    parent = {}
    for n, p in pairs:
        parent[n] = min(parent.get(n, p or ""), p or "")
    out = {}
    for n in parent:
        way, x = [n], n
        while parent[x] in parent and parent[x] not in way:
            x = parent[x]
            way.append(x)
        nxt = parent[x]
        if nxt in way:
            ring = way[way.index(nxt):]
            out[n] = (None, None, min(ring))
        else:
            out[n] = (x, len(way), None)
    return out


def solved(df):
    return {r["node"]: (r["root"], r["depth"], r["cycle"]) for r in df.collect()}


def _case(seed, n=60):
    rng = random.Random(seed)
    names = [f"{i:03d}" for i in range(n)]
    rng.shuffle(names)
    pairs = []
    for i, name in enumerate(names):
        kind = rng.random()
        up = None if kind < 0.05 else "zz" if kind < 0.08 else rng.choice(names) if kind < 0.15 else names[max(0, i - rng.randint(1, 3))]
        pairs.append((name, up))
    return pairs


@pytest.mark.parametrize(("seed", "limit"), [(0, 2), (1, 9), (0, 1000), (1, 1000)])
def test_against_brute_force(spark, seed, limit):
    pairs = _case(seed)
    assert solved(H.hierarchy(_links(spark, [(*p, 1) for p in pairs]), group_limit=limit)) == brute(pairs)


def test_a_long_line_in_disorder(spark):
    """A line, a loop and a hub, 3,000 rows in no order: many levels of groups of 200."""
    pairs = [(f"{i:04d}", f"{i - 1:04d}" if i else None) for i in range(1000)] + [(f"c{i:03d}", f"c{(i + 1) % 500:03d}") for i in range(500)] + [(f"h{i:04d}", "0500" if i % 2 else "c007") for i in range(1500)]
    random.Random(4).shuffle(pairs)
    assert solved(H.hierarchy(_links(spark, [(*p, 1) for p in pairs]), group_limit=200)) == brute(pairs)


@pytest.mark.parametrize("few", [0, 10])
def test_contradictions_keep_the_order(spark, few):
    rows = [(f"{i:03d}", f"{i - 1:03d}" if i else None, 1) for i in range(50)] + [("010", "050", 1), ("020", None, 1)]
    kept = [(r["node"], r["parent"]) for r in H.single_parent(_links(spark, rows, 1), few).collect()]
    assert [k[0] for k in kept] == [f"{i:03d}" for i in range(50) if i != 20] + ["020"] and dict(kept)["010"] == "009" and dict(kept)["020"] is None


def test_spellings_copies_and_contradictions(spark):
    rows = [("0xAA", "0" * 64, 1), (" aa ", "0" * 64, 1), ("bb", "AA", 1), ("bb", "cc", 1), ("", "aa", 1), (None, "aa", 1), ("dd", "dd", 1), ("ee", " ", 1)]
    assert solved(H.hierarchy(_links(spark, rows))) == {"aa": ("aa", 1, None), "bb": ("aa", 2, None), "dd": (None, None, "dd"), "ee": ("ee", 1, None)}


def test_empty(spark):
    assert H.hierarchy(_links(spark, [])).count() == 0
    assert H.paths(_links(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_paths_and_descendants(spark, seed):
    pairs = _case(seed + 10)
    want = brute(pairs)
    parent = dict(pairs)
    paths = H.paths(_links(spark, [(*p, 1) for p in pairs]))
    got = {r["node"]: r["path"] for r in paths.collect()}
    assert set(got) == {n for n, v in want.items() if v[0]}
    for n, path in got.items():
        assert path[-1] == n and path[0] == want[n][0] and len(path) == want[n][1]
        assert all(parent[b] == a for a, b in zip(path, path[1:]))
    pairs_ = {(r["node"], r["later"], r["distance"]) for r in H.descendants(paths).collect()}
    assert pairs_ == {(a, n, len(p) - 1 - i) for n, p in got.items() for i, a in enumerate(p[:-1])}


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from([None, *"abcdefghz"])), max_size=8, unique_by=lambda t: t[0]))
def test_contract_alone(pairs):
    import pandas as pd

    pdf = pd.DataFrame({"node": [p[0] for p in pairs], "root": [p[0] for p in pairs], "steps": 0, "tgt": [p[1] for p in pairs], "low": [p[0] for p in pairs], "looped": False}, dtype=object).astype({"steps": int, "looped": bool})
    got = {r.node: (None, None, r.low) if r.looped else (r.root, r.steps + 1, None) for r in H._contract(pdf).itertuples()}
    assert got == brute(pairs)
