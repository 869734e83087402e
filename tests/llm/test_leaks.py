import random
import unicodedata

import numpy as np
import pytest

from stratamem.llm import leaks as L

WORDS = [f"w{i}" for i in range(300)]


def exact(docs, items, width=12):
    out = set()
    for i, item in items:
        ws = L.words(item)
        n = min(width, len(ws))
        grams = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if n else set()
        for d, text in docs:
            dw = L.words(text)
            if any(tuple(dw[k : k + n]) in grams for k in range(len(dw) - n + 1)) and n:
                out.add((d, i))
    return out


def free_end(a, b):
    """The least distance of a to a beginning of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def _changed(rng, ws, edits, kinds):
    ws = list(ws)
    for _ in range(edits):
        kind, at = rng.choice(kinds), rng.randrange(1, len(ws) - 1)
        if kind == "sub":
            ws[at] = f"x{rng.randrange(999)}"
        elif kind == "ins":
            ws.insert(at, f"x{rng.randrange(999)}")
        else:
            del ws[at]
    return ws


def _corpus(seed, edits, kinds=("sub",), n=20, each=60, lengths=(6, 12, 30)):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice(lengths)))) for i in range(n)]
    docs = []
    for d in range(each):
        ws = rng.choices(WORDS, k=40)
        if d % 3:
            src = rng.choice(items)[1].split()
            at = rng.randrange(max(1, len(src) - 13))
            ws[10:10] = _changed(rng, src[at : at + 13], rng.randint(0, edits), kinds)
        docs.append((d, " ".join(ws)))
    return docs, items


def _found(spark, docs, items, **o):
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int")
    return {(r["doc_id"], r["item_id"]): r["edits"] for r in L.leaks(d, spark.createDataFrame(items, "item_id long, text string"), **o).collect()}


@pytest.mark.parametrize("block", [4_000_000, 400])
def test_exact_passages(spark, monkeypatch, block):
    """The rows with 0 edits are exact, also over several blocks of items and batches of documents."""
    monkeypatch.setattr(L, "BLOCK_CHARS", block)
    monkeypatch.setattr(L, "BATCH_WORDS", 500)
    docs, items = _corpus(1, 2)
    assert {k for k, e in _found(spark, docs, items).items() if e == 0} == exact(docs, items)
    assert set(_found(spark, docs, items, edits=0)) == exact(docs, items)


def test_near_recall(spark):
    """Against every start of every document, with a free end; insertions, deletions and substitutions mixed."""
    docs, items = _corpus(2, 2, ("sub", "ins", "del"))
    want = {}
    for i, item in items:
        iw = item.split()
        n = min(12, len(iw))
        most = min(2, (n - 1) // 4)
        for d, text in docs:
            dw = text.split()
            for k in range(len(dw)):
                near = dw[k : k + n + most]
                for p in (iw[k : k + n] for k in range(len(iw) - n + 1)):
                    if len(set(near) & set(p)) >= len(set(p)) - most and (e := free_end(p, near)) <= most:
                        want[d, i] = min(e, want.get((d, i), e))
    have = _found(spark, docs, items)
    assert set(have) <= set(want) and len(have) >= 0.9 * len(want) and all(have[k] >= want[k] for k in have)


@pytest.mark.parametrize("edits", [1, 2])
@pytest.mark.parametrize("kind", ["sub", "ins", "del"])
def test_recall_of_each_edit(kind, edits):
    rng = random.Random(edits)
    items = [(i, " ".join(rng.choices(WORDS, k=12))) for i in range(300)]
    hashes = L.Hashes()
    lines = [rng.choices(WORDS, k=5) + _changed(rng, t.split(), edits, [kind]) + rng.choices(WORDS, k=5) for _, t in items]
    stream, owner = [hashes[w] for ws in lines for w in ws], [i for i, ws in enumerate(lines) for _ in ws]
    found = {(o, i) for o, i, _ in L.Passages(items, 12, 2, 4, L.REPEATS, L.DRAWS, L.SAMPLED).find(np.array(stream, np.uint64), np.array(owner))}
    assert sum((i, i) in found for i in range(300)) >= 0.95 * 300


def test_edit_distance_and_embedding():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (200, 7)).astype(np.uint64), rng.integers(0, 4, (200, 9)).astype(np.uint64)
    assert L.edit_distance(a, b, 2).tolist() == [min(3, free_end(x, y)) for x, y in zip(a.tolist(), b.tolist())]
    assert (L.embed(a, 1, 21) == L.embed(a.copy(), 1, 21)).all() and L.embed(a, 1, 21).shape == (200, 21)


def test_words():
    assert L.words("Ｆｕｌｌ_width Straße pag\xade №5, é") == ["full", "width", "straße", "page", "no5", "é"]
    assert L.words(None) == L.words(" \n") == L.words("--") == []


def test_dirty(spark):
    items = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "--")]
    docs = [(1, None), (2, ""), (3, "x ONE, two y"), (3, "one-two"), (4, "one " * 100_000), (None, "one two"), (2**60 + 1, "one two")]
    assert _found(spark, docs, [*items, (None, "one")]) == {(3, 3): 0, (None, 3): 0, (2**60 + 1, 3): 0}
    assert _found(spark, [], items) == {} and _found(spark, docs, []) == {}
