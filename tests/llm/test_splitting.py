import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratamem.llm import splitting as S


def check(text, limit, overlap):
    whole, spans = S.in_order(text), S.split(text, limit, overlap)
    limit = limit if limit and limit >= 1 else S.DEFAULT_LIMIT
    over = min(max(overlap or 0, 0), limit - 1)
    assert (len(spans) > 1) == (len(whole) > limit) and bool(spans) == bool(whole)
    assert all(0 < hi - lo <= limit for lo, hi in spans)
    assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(whole))
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c == b - over and d > b and c >= a
    assert "".join(whole[lo + (over if i else 0):hi] for i, (lo, hi) in enumerate(spans)) == whole
    return [whole[lo:hi] for lo, hi in spans]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab. \n\r#-é́漢🔗", max_size=200), st.one_of(st.none(), st.integers(-1, 40)), st.one_of(st.none(), st.integers(-2, 45)))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_at_the_coarsest_boundary():
    text = "# One\n\nAlpha beta. Gamma delta.\n\n# Two\n\nEpsilon zeta."
    assert check(text, 40, 0) == ["# One\n\nAlpha beta. Gamma delta.\n\n", "# Two\n\nEpsilon zeta."]
    assert check("one two three four", 9, 0) == ["one two ", "three ", "four"] or all(" " in p or p == "four" for p in check("one two three four", 9, 0))
    assert check("First one. Second one. Third.", 12, 0) == ["First one. ", "Second one. ", "Third."]
    assert [len(p) for p in check("a" * 25, 10, 3)] == [7, 10, 10, 7]


def test_very_long_and_combining():
    check("x" * 300_000, 2000, 200)
    check("word " * 60_000, None, None)
    assert all(not p.startswith("́") for p in check("é" * 30, 7, 0))


def test_frames(spark):
    rows = [(1, "a b " * 10, 8, 2, 3, "clash"), (1, "a b " * 10, 8, 2, 3, "clash"), (2, None, 5, None, None, "x"), (3, " \t\n", 5, 1, 0, "x"), (4, "short", None, None, 1, "x"), (5, "漢字" * 5, 4, 9, None, "x"), (None, "null id", 3, None, 2**30, "x"), (2**60 + 1, "large id", None, None, 1, "x")]
    df = spark.createDataFrame(rows, "input_id long, text string, max_chunk_chars int, overlap_chars int, chunk_count int, piece_no string")
    n = {r["input_id"]: r["n_pieces"] for r in S.counts(df).collect()}
    assert n[2] == n[3] == 0 and n[4] == 1 and n[1] > 1
    got = S.pieces(df).collect()
    assert {r["input_id"] for r in got} == {1, 4, 5, None, 2**60 + 1} and sum(r["input_id"] == 1 for r in got) == n[1]
    stale = {r["input_id"]: r["stale"] for r in S.recount(df).collect()}
    assert stale == {1: True, 2: True, 3: False, 4: False, 5: True, None: True, 2**60 + 1: False}
    assert S.counts(df.limit(0)).count() == 0 and S.pieces(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [". " * 100_000, "." * 200_000, " \n" * 100_000 + "x", "x" + " " * 200_000 + "y", "\n" * 200_000 + "z", "# " * 90_000, "。" * 150_000, "<p" * 100_000])
def test_time_is_in_proportion(text):
    import time

    t = time.time()
    check("a" + text, 2000, 100)
    assert time.time() - t < 5
