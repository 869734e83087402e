"""Words, stems, lexical scores and text shaping."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tokens(c: Column | str) -> Column:
    """Lower-case runs of ASCII letters, digits and underscore. Null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1)), F.array().cast("array<string>"))


# The suffix rules of Porter's stemmer (1980).
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES2 = sorted((r.split(":") for r in _STEP2.split()), key=lambda r: -len(r[0]))
_RULES3 = sorted((r.split(":") for r in _STEP3.split()), key=lambda r: -len(r[0]))
_RULES4 = sorted(_STEP4.split(), key=len, reverse=True)


def _shape(w: str) -> str:
    """v for vowels, c for the others; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(maxsize=1 << 16)
def porter(w: str) -> str:
    """The stem of a lower-case word; words of up to two letters and those with other characters stay."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ing", "ed"):
            if w.endswith(end):
                if "v" in _shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_RULES2, _RULES3):
        for end, new in rules:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in _RULES4:
        if w.endswith(end):
            if _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def unicode_words(text: str) -> list[str]:
    """Case-folded runs of letters and digits without diacritics."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text.lower())


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The Porter stems of the words of a text; null has none."""
    for s in batches:
        yield s.map(lambda t: [porter(w) for w in unicode_words(t)] if t else [])


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two token sets; two empty ones are alike, one empty one is unlike any other."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(both / F.nullif(F.size(F.array_union(x, y)), F.lit(0)))


def share_of_query(query: str, *texts: Column) -> Column:
    """The fraction of the query's distinct tokens that occur in any of the texts; 0 for a query without tokens."""
    want = list(dict.fromkeys(re.findall("[a-z0-9_]+", query.lower())))
    if not want:
        return F.lit(0.0)
    have = tokens(F.concat_ws(" ", *texts))
    return F.size(F.array_intersect(F.array(*map(F.lit, want)), have)) / F.lit(len(want))


def preview(c: Column | str, n: int) -> Column:
    """At most n characters, the last an ellipsis where something is left out."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def paragraph_chunks(c: Column | str, limit: int = 2000) -> Column:
    """The trimmed, non-empty paragraphs of a text, those above the limit cut hard at it."""
    c = F.regexp_replace(c, "\r\n", "\n")
    trimmed = F.transform(F.split(c, r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    parts = F.filter(trimmed, lambda p: p != "")
    cut = F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / limit).cast("int")), lambda k: F.substring(p, k * limit + 1, F.lit(limit))))
    return F.flatten(cut)


NESTED = 8  # levels of nested properties that are read


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _leaves(v: Column, levels: int = 4) -> Column:
    """The scalars of a variant as texts, those of nested arrays in order; objects within arrays have none."""
    own = F.try_variant_get(v, "$", "string")
    one = F.when(F.schema_of_variant(v).startswith("OBJECT") | own.isNull(), F.array().cast("array<string>")).otherwise(F.array(own))
    if not levels:
        return one
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _leaves(x, levels - 1)))).otherwise(one)


def props_text(kind: Column | str, props: Column | str, formatter: Callable[[Column, Column], Column] | None = None) -> Column:
    """The search text of a label's properties (JSON): a kind line and a line a leaf, "path: value", in order of the path, where a
    path is read with blanks for underscores. A formatter (kind and props columns to a text) goes first where it gives
    something. What is no JSON object or has no leaf gives an empty text. Objects below NESTED levels are left out."""
    kind, props = (F.col(c) if isinstance(c, str) else c for c in (kind, props))
    level = F.transform(F.map_entries(_object(F.try_parse_json(props))), lambda e: F.struct(F.array(e["key"]).alias("path"), e["value"].alias("value")))
    for _ in range(NESTED - 1):
        level = F.flatten(F.transform(level, lambda e: F.when(
            F.schema_of_variant(e["value"]).startswith("OBJECT"),
            F.transform(F.map_entries(_object(e["value"])), lambda x: F.struct(F.concat(e["path"], F.array(x["key"])).alias("path"), x["value"].alias("value")))).otherwise(F.array(e))))
    shown = F.transform(level, lambda e: F.struct(e["path"].alias("path"), F.array_join(F.filter(_leaves(e["value"]), lambda x: x != ""), ", ").alias("text")))
    lines = F.transform(F.array_sort(F.filter(shown, lambda e: e["text"] != "")), lambda e: F.concat(F.translate(F.array_join(e["path"], "."), "_", " "), F.lit(": "), e["text"]))
    plain = F.when(F.size(lines) > 0, F.array_join(F.concat(F.array(F.concat(F.lit("Kind: "), kind)), lines), "\n")).otherwise("")
    if formatter is None:
        return F.coalesce(plain, F.lit(""))
    some = F.size(F.map_keys(_object(F.try_parse_json(props)))) > 0
    return F.coalesce(F.when(some, F.nullif(F.trim(formatter(kind, props)), F.lit(""))), plain, F.lit(""))
