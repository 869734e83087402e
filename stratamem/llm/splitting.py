"""Splitting oversized texts at natural boundaries, by packing the text's structure tree.

The tree has sections by heading rank, paragraphs, outer and inner lines (list items, table rows, markup blocks),
sentences, words and characters. A node within the limit is a whole; an oversized one is descended into, and the packed
parts of siblings are merged from the bottom up while they fit. The tree is only parsed below oversized nodes.

A text is first put in order: CRLF becomes LF, outer spaces, tabs and newlines are dropped. All pieces are spans of it;
each but the first starts `overlap` characters (Unicode code points) before the end of the one before, so that the
pieces without their overlaps give the text again.

Defined cases: a null text gives no piece and count 0, a blank one likewise; a limit that is null or below 1 means
DEFAULT_LIMIT; a null or negative overlap means 0, one of the limit or more means limit - 1; a run without any boundary
is cut at the limit, before no combining mark unless there is no other place; repeated input rows count once; a null
input_id is an id like any other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.sources.tables import spread

DEFAULT_LIMIT = 2000
BLANKS = " \t\n"
_JOINERS = "‍︎️"

#: Where a part starts, from the coarsest level to the finest. A match's end is the place. Runs are matched from their start
#: only and as a whole, so the time is in proportion to the text.
LEVELS = [
    *[re.compile(rf"(?<=\n)(?=#{{{k}}} )|(?<=.)(?=<h{k}\b)", re.I | re.S) for k in range(1, 7)],
    re.compile(r"(?<!\n)\n(?:[ \t]*+\n)++(?=.)", re.S),
    re.compile(r"(?<=\n)(?=\S)|(?<=.)(?=<(?:p|div|section|article|ul|ol|table|pre|blockquote)\b)", re.I | re.S),
    re.compile(r"(?<=\n)(?=.)|(?<=.)(?=<(?:li|tr|dt|dd|br)\b)", re.I | re.S),
    re.compile(r"(?<![.!?…])[.!?…]++[\"'”’»)\]]*+\s++(?=\S)|(?<![。！？])[。！？]++[」』”’）]*+(?=.)", re.S),
    re.compile(r"(?<!\s)\s++(?=\S)"),
]


def _hard(text: str, lo: int, hi: int, cap: int) -> list[tuple[int, int]]:
    out = []
    while hi - lo > cap:
        at = lo + cap
        while at > lo + 1 and (unicodedata.combining(text[at]) or text[at] in _JOINERS or text[at - 1] == "‍"):
            at -= 1
        if at == lo + 1:
            at = lo + cap
        out.append((lo, at))
        lo = at
    return [*out, (lo, hi)]


def _merge(spans: list[tuple[int, int]], cap: int, first: int) -> list[tuple[int, int]]:
    """Adjacent spans joined from the left while they fit; `first` is the room of the first one."""
    out = [spans[0]]
    for lo, hi in spans[1:]:
        if hi - out[-1][0] <= (first if len(out) == 1 else cap):
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _pack(text: str, lo: int, hi: int, level: int, cap: int) -> list[tuple[int, int]]:
    if hi - lo <= cap:
        return [(lo, hi)]
    cuts: list[int] = []
    while level < len(LEVELS) and not cuts:
        cuts = [c for m in LEVELS[level].finditer(text, lo, hi) if lo < (c := m.end()) < hi]
        level += 1
    if not cuts:
        return _hard(text, lo, hi, cap)
    ends = [lo, *dict.fromkeys(cuts), hi]
    parts = [s for a, b in zip(ends, ends[1:]) for s in _pack(text, a, b, level, cap)]
    return _merge(parts, cap, cap)


def in_order(text: str) -> str:
    return text.replace("\r\n", "\n").strip(BLANKS)


def split(text: str | None, limit: int | None = None, overlap: int | None = None) -> list[tuple[int, int]]:
    """The pieces as (start, end) in `in_order(text)`."""
    text = in_order(text or "")
    if not text:
        return []
    limit = DEFAULT_LIMIT if limit is None or limit < 1 else limit
    if len(text) <= limit:
        return [(0, len(text))]
    over = min(max(overlap or 0, 0), limit - 1)
    spans = _merge(_pack(text, 0, len(text), 0, limit - over), limit - over, limit)
    return [(max(0, lo - over), hi) for lo, hi in spans]


def _int(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def _rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    for i, text, limit, over in zip(pdf["input_id"], pdf["text"], pdf["max_chunk_chars"], pdf["overlap_chars"]):
        yield i, text, split(text, _int(limit), _int(over))


def _inputs(df: DataFrame) -> DataFrame:
    return df.select(F.col("input_id").cast("string").alias("input_id"), "text", "max_chunk_chars", "overlap_chars")


def counts(df: DataFrame) -> DataFrame:
    """input_id and n_pieces of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, len(spans)) for i, _, spans in _rows(pdf)], columns=["input_id", "n_pieces"])

    return spread(_inputs(df)).mapInPandas(run, "input_id string, n_pieces int").dropDuplicates(["input_id"]).withColumn("input_id", F.col("input_id").cast("long"))


def pieces(df: DataFrame) -> DataFrame:
    """input_id, piece_no from 0, start, n_chars, text: the pieces of every input, each input once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                rows = []
                for i, text, spans in _rows(pdf.iloc[k : k + 256]):
                    text = in_order(text or "")
                    rows += [(i, n, lo, hi - lo, text[lo:hi]) for n, (lo, hi) in enumerate(spans)]
                yield pd.DataFrame(rows, columns=["input_id", "piece_no", "start", "n_chars", "text"])

    return _inputs(df).dropDuplicates(["input_id"]).mapInPandas(run, "input_id string, piece_no int, start int, n_chars int, text string").withColumn("input_id", F.col("input_id").cast("long"))


def recount(df: DataFrame) -> DataFrame:
    """input_id, chunk_count as it must be, and whether the count of the earlier run is missing or stale."""
    old = df.select("input_id", F.col("chunk_count").alias("old")).dropDuplicates(["input_id"])
    new = counts(df)
    return new.join(old, new["input_id"].eqNullSafe(old["input_id"])).select(new["input_id"], F.col("n_pieces").alias("chunk_count"), (~F.col("old").eqNullSafe(F.col("n_pieces"))).alias("stale"))
