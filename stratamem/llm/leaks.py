"""Evaluation texts leaking into training text: CGK embedding, bit-sampling LSH, exact verification.

Texts become words (NFKC, lower case, format characters dropped, longest runs of letters and digits). A passage is a window of
`width` consecutive words of an item, or the whole of a shorter item. It leaks into a document that holds a stretch of words
within `edits` word edits of it (insertions, deletions, substitutions; so stretches of width - edits to width + edits words).

A sequence is embedded by the walk of Chakraborty, Goldenberg and Koucky: in each step the current word is put out, and a
shared random bit of (step, word) says whether to move on. A document is embedded from each start that may begin such a
stretch, so one walk stands for the stretches of all lengths from there. Sequences at edit distance e are at Hamming
distance O(e^2) with good probability, and equal ones at 0 always. Each of `repeats` walks is hashed `draws` times on
`sampled` of its steps; starts that meet a passage in any hash are verified exactly, by word edit distance with a free end.
Passages found with 0 edits are therefore exact; of the others the share found is measured against brute force in the tests.

A stretch within e edits of n words holds at least one of any e + 1 disjoint pieces of the passage unchanged: only starts
near a run of n // (e + 1) words that some item has too are embedded. That loses nothing.

The documents are only mapped, in one pass: each batch of them meets the items block by block, as they lie in the shared
folder, so a task holds one block (about BLOCK_CHARS of items, or one longer item). Words are compared by 64-bit hashes.

An item of n words may differ by (n - 1) // words_per_edit words at most: one of a few words would else be found anywhere.

Defined cases: null, blank and wordless texts hold and leak nothing; ids may repeat, a
null doc_id is an id like any other, items without an id are left out; empty tables give no rows; a passage
of several items counts for each of them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.sources.tables import SharedFiles, shared_path, spread

WIDTH = 12
BLOCK_CHARS = 4_000_000
NEAR_EDITS = 2
WORDS_PER_EDIT = 4
REPEATS = 24  # walks
DRAWS = 4  # hashes of each walk
SAMPLED = 4  # steps in each hash
WINDOWS_AT_ONCE = 50_000
PAIRS_AT_ONCE = 200_000
BATCH_WORDS = 1_000_000
KNOWN_WORDS = 500_000  # hashes of words kept in each Python worker
PAD = np.uint64(0)

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
        return _WORD.findall(unicodedata.normalize("NFKC", text.lower()))
    return _WORD.findall(text.lower())


class Hashes(dict):
    """Words to their hashes, never PAD; the last KNOWN_WORDS or so are kept."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big") or 1
        return h

    def of(self, text: str | None) -> list[int]:
        return [self[w] for w in words(text)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs to equal, others to unrelated values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def embed(sequences: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The walk numbered `walk` over each row of word hashes: (rows, steps); PAD stands behind a sequence's end."""
    n, w = sequences.shape
    padded = np.concatenate([sequences, np.full((n, 1), PAD)], 1)
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, steps), np.uint64)
    for step in range(steps):
        out[:, step] = word = padded[rows, at]
        bit = _mix(word + np.uint64((walk * 4099 + step + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), w)
    return out


def _folded(columns: Iterator[np.ndarray], seed: int, n: int) -> np.ndarray:
    h = np.full(n, seed, np.uint64)
    for c in columns:
        h = _mix(h * np.uint64(31) + c + np.uint64(1))
    return h


def _keys(sequences: np.ndarray, n: int, edits: int, repeats: int, draws: int, sampled: int) -> Iterator[np.ndarray]:
    """The hashes of the sampled steps of each walk. On average a walk moves on in every other step, so the steps drawn from
    are those in which the end of a passage of n words, from where on only its own continuation agrees, is not yet near."""
    steps = max(1, 2 * (n - edits) - 1)
    for walk in range(repeats):
        e = embed(sequences, walk, steps)
        for d in range(draws):
            drawn = np.sort(np.random.default_rng(1000 * walk + d).choice(steps, min(sampled, steps), replace=False))
            yield _folded((e[:, k] for k in drawn), walk * 64 + d, len(e))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The least word edit distance of each row of a to a beginning of that row of b, as far as `most`; larger ones come out as
    most + 1. b is at least as long as a."""
    n, w, v = len(a), a.shape[1], b.shape[1]
    big = most + 1
    row = np.tile(np.minimum(np.arange(v + 1), big), (n, 1))
    for i in range(1, w + 1):
        new = np.full_like(row, big)
        if i <= most:
            new[:, 0] = i
        for j in range(max(1, i - most), min(v, i + most) + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j - 1] + (a[:, i - 1] != b[:, j - 1]), row[:, j] + 1), np.minimum(new[:, j - 1] + 1, big))
        row = new
    return row.min(1)


def _within(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Whether all but `most` words of passage x[j] stand in y[i] at most `most` places off: no pair within that distance is lost."""
    n = x.shape[1]
    there = np.zeros(len(i), np.int64)
    for k in range(n):
        word, found = x[j, k], np.zeros(len(i), bool)
        for at in range(max(0, k - most), min(y.shape[1], k + most + 1)):
            found |= y[i, at] == word
        there += found
        alive = there + (n - 1 - k) >= n - most
        if not alive.all():
            i, j, there = i[alive], j[alive], there[alive]
            kept = np.flatnonzero(alive) if k == 0 else kept[alive]
        elif k == 0:
            kept = np.arange(len(i))
    return kept


def _grams(stream: np.ndarray, g: int) -> np.ndarray:
    """Hashes of the runs of g words that begin at each place."""
    n = len(stream) - g + 1
    return _folded((stream[k : k + n] for k in range(g)), g, n) if n > 0 else np.zeros(0, np.uint64)


class Passages:
    """The passages of a block of items, ready for looking up documents."""

    def __init__(self, items: list[tuple[int, str]], width: int, edits: int, per_edit: int, repeats: int, draws: int, sampled: int):
        self.drawing = repeats, draws, sampled
        by_width: dict[int, list] = defaultdict(list)
        known = Hashes()
        for item, text in items:
            ws = known.of(text)
            n = min(width, len(ws))
            if n:
                by_width[n] += [(ws[i : i + n], item) for i in range(len(ws) - n + 1)]
        self.tables = {}
        for n, rows in by_width.items():
            x, back = np.unique(np.array([r[0] for r in rows], np.uint64), axis=0, return_inverse=True)
            of: dict[int, set] = defaultdict(set)
            for k, (_, item) in zip(back.ravel(), rows):
                of[int(k)].add(item)
            e = min(edits, (n - 1) // per_edit)
            g = n // (e + 1)
            pieces = np.unique(np.concatenate([_grams(p, g)[::g] for p in x]))
            keys = []
            for h in _keys(x, n, e, *self.drawing):
                order = np.argsort(h, kind="stable")
                keys.append((h[order], order))
            self.tables[n] = (x, {k: tuple(v) for k, v in of.items()}, e, g, pieces, keys)

    def find(self, stream: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(owner, item, edits) of the passages within one owner's part of the stream; several of a pair are possible."""
        last = np.searchsorted(owner, owner, "right")  # where each place's owner ends
        for n, (x, of, e, g, pieces, keys) in self.tables.items():
            grams = _grams(stream, g)
            at = np.flatnonzero(pieces[np.minimum(np.searchsorted(pieces, grams), len(pieces) - 1)] == grams)
            at = at[at + g <= last[at]]
            if not len(at):
                continue
            mark = np.zeros(len(stream) + 1, np.int64)
            np.add.at(mark, np.maximum(at - (n - g) - e, 0), 1)
            np.add.at(mark, np.minimum(at + e, len(stream) - 1) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            starts = starts[starts + n - e <= last[starts]]
            for s in range(0, len(starts), WINDOWS_AT_ONCE):
                own = starts[s : s + WINDOWS_AT_ONCE]
                places = own[:, None] + np.arange(n + e)
                y = np.where(places < last[own][:, None], stream[np.minimum(places, len(stream) - 1)], PAD)
                yield from self._met(x, y, owner[own], of, e, keys, n)

    def _met(self, x: np.ndarray, y: np.ndarray, owner: np.ndarray, of: dict, e: int, keys: list, n: int) -> Iterator[tuple[int, int, int]]:
        done, held, size = set(), [], 0
        for k, ((h, order), mine) in enumerate(zip(keys, _keys(y, n, e, *self.drawing)), 1):
            lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            hit = np.flatnonzero(hi > lo)
            count = hi[hit] - lo[hit]
            for c in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS_AT_ONCE)) + 1):
                i = np.repeat(hit[c], count[c])
                j = order[np.repeat(lo[hit[c]], count[c]) + np.arange(len(i)) - np.repeat(np.cumsum(count[c]) - count[c], count[c])]
                held.append(i * len(x) + j)
                size += len(i)
                if size > PAIRS_AT_ONCE or k == len(keys):
                    pairs = np.sort(np.concatenate(held))
                    pairs, held, size = pairs[np.diff(pairs, prepend=-1) > 0], [], 0
                    i, j = pairs // len(x), pairs % len(x)
                    near = _within(x, y, i, j, e)
                    i, j = i[near], j[near]
                    far = edit_distance(x[j], y[i], e)
                    for a, p, d in set(zip(owner[i[far <= e]].tolist(), j[far <= e].tolist(), far[far <= e].tolist())):
                        if (a, p, d) not in done:
                            done.add((a, p, d))
                            for item in of[p]:
                                yield a, item, d


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, edits: int = NEAR_EDITS, words_per_edit: int = WORDS_PER_EDIT, repeats: int = REPEATS, draws: int = DRAWS, sampled: int = SAMPLED) -> DataFrame:
    """doc_id, item_id, edits: each pair once, with the least edit distance found of a passage in the document.

    docs: (doc_id, text), items: (item_id, text)."""
    spark, texts = docs.sparkSession, spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    path = shared_path(spark, "items")
    items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, hashes, kept = SharedFiles(path), Hashes(), {}

        def block(b: int) -> Passages | None:
            if b not in kept:
                kept.clear()
                t = files.read(f"block={b}", ["item_id", "text"])
                kept[b] = t and Passages(list(zip(t["item_id"].to_pylist(), t["text"].to_pylist())), width, edits, words_per_edit, repeats, draws, sampled)
            return kept[b]

        def found(ids: list, stream: list[int], owner: list[int]) -> pd.DataFrame:
            least: dict[tuple[int, int], int] = {}
            s, o = np.array(stream, np.uint64), np.array(owner, np.int64)
            for b in range(blocks):
                if passages := block(b):
                    for at, item, e in passages.find(s, o):
                        least[at, item] = min(e, least.get((at, item), e))
            return pd.DataFrame([(ids[at], item, e) for (at, item), e in least.items()], columns=["doc_id", "item_id", "edits"])

        ids, stream, owner = [], [], []
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ws = hashes.of(text)
                stream += ws
                owner += [len(ids)] * len(ws)
                ids.append(doc)
                if len(stream) >= BATCH_WORDS:
                    yield found(ids, stream, owner)
                    ids, stream, owner = [], [], []
        yield found(ids, stream, owner)

    rows = texts.mapInPandas(run, "doc_id string, item_id long, edits int")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "item_id").agg(F.min("edits").alias("edits"))
