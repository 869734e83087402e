"""Namespace paths: grammar, lineage, prefix tests, canonical roots, renames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratamem.schema import ABSOLUTE_CHARS, ABSOLUTE_DEPTH, MAX_CHARS, MAX_DEPTH

SEGMENTS = r"^[a-z0-9_-]+(/[a-z0-9_-]+)*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_error(c: Column | str, max_depth: int = MAX_DEPTH, max_chars: int = MAX_CHARS) -> Column:
    """Null for a legal path, else the kind of fault: empty, max_length, invalid or max_depth."""
    c = _col(c)
    max_depth, max_chars = min(max_depth, ABSOLUTE_DEPTH), min(max_chars, ABSOLUTE_CHARS)
    return (
        F.when(c.isNull() | (c == ""), "empty").when(F.length(c) > max_chars, "max_length").when(~c.rlike(SEGMENTS), "invalid")
        .when(F.size(F.split(c, "/")) > max_depth, "max_depth")
    )


def under(c: Column | str, root: Column | str) -> Column:
    """The path is the root or below it, at segment boundaries. A str root is a literal."""
    c, root = _col(c), F.lit(root) if isinstance(root, str) else root
    return (c == root) | c.startswith(F.concat(root, F.lit("/")))


def canonical(roots: list[str]) -> list[str]:
    """The roots without those below others, by depth and name."""
    kept: list[str] = []
    for r in sorted(dict.fromkeys(roots), key=lambda r: (r.count("/"), r)):
        if not any(r == k or r.startswith(k + "/") for k in kept):
            kept.append(r)
    return kept


def under_any(c: Column | str, roots: list[str]) -> Column:
    """Below any root; without roots nothing is."""
    return reduce(lambda a, b: a | b, (under(c, r) for r in canonical(roots)), F.lit(False))


def lineage(c: Column | str) -> Column:
    """The cumulative prefixes of a path, root first."""
    seg = F.split(_col(c), "/")
    return F.transform(F.sequence(F.lit(1), F.size(seg)), lambda n: F.array_join(F.slice(seg, F.lit(1), n), "/"))


def renamed(c: Column | str, old: str, new: str, recursive: bool = True) -> Column:
    """The path after `old` is renamed to `new`."""
    c = _col(c)
    moved = F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))
    return F.when(under(c, old) if recursive else c == old, moved).otherwise(c)


def over_quota(present, new, most: int):
    """The namespaces of `new` that would be one more than `most` distinct ones; those already present never are."""
    known = present.select("namespace").distinct()
    room = max(0, most - known.count())
    fresh = new.select("namespace").distinct().join(known, "namespace", "left_anti")
    return fresh.orderBy("namespace").offset(room)
