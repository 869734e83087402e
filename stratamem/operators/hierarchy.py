"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, cycles reported.

Weighted disjoint-set forests: each stretch of at most `group_limit` input rows joins its own links into a forest whose
entries hold a representative, the offset to it and the link that leaves the stretch (`_contract`, path compression by
vectorised pointer jumping). Only nodes another stretch points at go on, level by level (`_solve`). A level links by coins,
which alone takes away a share of any line, and merges neighbouring stretches into groups of at most `group_limit` entries;
the levels end when one group holds all that is left. So every step has the same bound at any size, and levels grow with the
logarithm of what the stretches leave open. Rows keep their arrival order for this, so that most links are local. Paths are
then put together from the local segments by following the few links between stretches (`paths`).

Defined cases: a node starts a hierarchy (depth 1, itself the root) if its parent is null, blank, zeros or held by no
row; a null or blank node is no node; exact copies count once; of several parents the smallest is kept (blank first);
nodes on or below a cycle have no root, but the cycle's smallest node; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamem.sources.tables import keep, normal

GROUP_LIMIT = 200_000  # rows or entries that one task joins
FEW = 100_000  # contradictory nodes that are broadcast
ENTRY = "node string, root string, steps long, tgt string, low string, looped boolean"


def links(df: DataFrame, node: str, parent: str, zeros: str = "0" * 64) -> DataFrame:
    """(node, parent) in normal form, in the order of the rows; parent is null where it points at nothing."""
    p = normal(parent)
    return df.select(normal(node).alias("node"), F.when((p != "") & (p != zeros), p).alias("parent")).where("node <> ''")


def single_parent(linked: DataFrame, few: int = FEW) -> DataFrame:
    """The links without contradictions, in their order: of several parents of one node the smallest is kept."""
    up = F.coalesce("parent", F.lit(""))
    several = keep(linked.groupBy("node").agg(F.min(up).alias("kept"), F.max(up).alias("last")).where("kept <> last").drop("last"), "several")
    n = several.count()
    if not n:
        return linked
    right = "kept IS NULL OR kept = coalesce(parent, '')"
    if n <= few:
        return linked.join(F.broadcast(several), "node", "left").where(right).drop("kept")
    placed = linked.withColumn("at", F.monotonically_increasing_id())
    return placed.join(several.hint("merge"), "node", "left").where(right).repartitionByRange("at").sortWithinPartitions("at").drop("kept", "at")


def _jump_local(nxt: np.ndarray, w: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path compression: the end of each entry's chain, the offset to it and the least `low` up to it (on a loop: an entry of
    the loop, and for those on it the least of the whole loop)."""
    nxt, w, low, span = nxt.copy(), w.copy(), low.copy(), 1
    while span <= 2 * len(nxt):
        further = nxt[nxt]
        w, low = w + w[nxt], np.minimum(low, low[nxt])
        if (further == nxt).all():
            break
        nxt, span = further, span * 2
    return nxt, w, low


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Joins the entries of one group: each gets the representative its chain ends at within the group."""
    pdf = pdf.drop_duplicates("node").reset_index(drop=True)
    n = len(pdf)
    at = pd.Index(pdf["node"]).get_indexer(pdf["tgt"]) if n else np.zeros(0, int)
    at[pdf["tgt"].isna().to_numpy()] = -1
    open_, own, steps = at >= 0, np.arange(n), pdf["steps"].to_numpy(np.int64)
    names, rank = np.unique(pdf["low"].to_numpy(object).astype(str), return_inverse=True)
    end, w, low = _jump_local(np.where(open_, at, own), np.where(open_, steps + 1, 0), rank)
    bent = open_[end]
    looped = bent | pdf["looped"].to_numpy(bool)[end]
    low = np.where(bent, low[end], np.where(looped, rank[end], np.minimum(low, rank[end])))
    pick = lambda c: pd.Series(pdf[c].to_numpy(object)[end], dtype=object)
    return pd.DataFrame({"node": pdf["node"], "root": pick("root").mask(looped, None), "steps": w + steps[end], "tgt": pick("tgt").mask(looped, None), "low": names[low] if n else [], "looped": looped})


def _local(group_limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The forests of the stretches of a partition's links (node, parent, part); part becomes that of the stretch."""

    def joined(pdf: pd.DataFrame, number: int) -> pd.DataFrame:
        part = (int(pdf["part"].iloc[0]) << 24) + number
        pdf = pdf.drop_duplicates("node").reset_index(drop=True)
        out = _contract(pd.DataFrame({"node": pdf["node"], "root": pdf["node"], "steps": 0, "tgt": pdf["parent"], "low": pdf["node"], "looped": False}))
        return out.assign(parent=pdf["parent"], part=part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, number = [], 0, 0
        for b in batches:
            while len(b):
                some, b = b.iloc[: group_limit - size], b.iloc[group_limit - size :]
                held, size = [*held, some], size + len(some)
                if size == group_limit:
                    yield joined(pd.concat(held, ignore_index=True), number)
                    held, size, number = [], 0, number + 1
        if held:
            yield joined(pd.concat(held, ignore_index=True), number)

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    part = int(pdf["part"].iloc[0])
    return _contract(pdf).assign(part=part)


def _boundary(entries: DataFrame) -> DataFrame:
    """The entries at which a chain of another group arrives."""
    return entries.join(entries.where("tgt IS NOT NULL").select(F.col("tgt").alias("node")).distinct(), "node", "left_semi")


def _past(far: DataFrame) -> DataFrame:
    return far.select(F.col("node").alias("tgt"), F.col("root").alias("r2"), F.col("steps").alias("s2"), F.col("tgt").alias("t2"), F.col("low").alias("low2"), F.col("looped").alias("l2"))


def _joined(entries: DataFrame, far: DataFrame, tgt: str) -> DataFrame:
    """Entries continued past their targets, which `far` holds once each; `tgt` is what becomes of the target."""
    met = F.col("s2").isNotNull()
    return entries.join(_past(far), "tgt", "left").withColumns({
        "root": F.when(met, F.col("r2")).otherwise(F.col("root")), "steps": F.when(met, F.col("steps") + 1 + F.col("s2")).otherwise(F.col("steps")),
        "low": F.when(F.col("l2"), F.col("low2")).when(met, F.least("low", "low2")).otherwise(F.col("low")),
        "looped": F.coalesce("l2", "looped"), "tgt": F.expr(tgt)}).drop("r2", "s2", "t2", "low2", "l2")


def _follow(entries: DataFrame, solved: DataFrame) -> DataFrame:
    """Entries continued through what their targets are resolved to; a target held by no row ends the chain."""
    return _joined(entries, solved, "CAST(NULL AS STRING)")


def _coin_linked(entries: DataFrame, level: int) -> DataFrame:
    """Entries continued past targets that are done or whose coin of this level is tails. On a line, a quarter of the entries is
    pointed at no more, whatever the order of the rows."""
    tails = F.xxhash64("node", F.lit(level)) % 2 == 0
    return _joined(entries, entries.where(tails | F.col("tgt").isNull()), "CASE WHEN s2 IS NULL THEN tgt ELSE t2 END")


def _grouped(entries: DataFrame, group_limit: int) -> DataFrame:
    """Entries with neighbouring parts put together, as many as make no more than group_limit entries."""
    places, group, size = [], 0, 0
    for r in entries.groupBy("part").count().orderBy("part").collect():  # a row a part of the input
        group, size = (group, size + r["count"]) if size + r["count"] <= group_limit or not size else (group + 1, r["count"])
        places.append((r["part"], group))
    to = entries.sparkSession.createDataFrame(places, "part long, wide long")
    return entries.join(F.broadcast(to), "part").drop("part").withColumnRenamed("wide", "part")


def _solve(entries: DataFrame, group_limit: int) -> DataFrame:
    """Entries (with their part) resolved among themselves, each node once."""
    now, levels = keep(entries.dropDuplicates(["node"]), "entries"), []
    while now.count() > group_limit:
        linked = keep(_coin_linked(now, len(levels)), "linked")
        merged = keep(_grouped(linked, group_limit).groupBy("part").applyInPandas(_merge, f"{ENTRY}, part long"), "merged")
        levels.append(merged)
        now = keep(_boundary(merged), "entries")
    solved = keep(now.groupBy(F.lit(0).alias("all")).applyInPandas(_contract, ENTRY), "solved")
    for merged in reversed(levels):
        solved = keep(_follow(merged.drop("part"), solved), "solved")
    return solved


def _forest(linked: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    return keep(linked.withColumn("part", F.spark_partition_id().cast("long")).mapInPandas(_local(group_limit), f"{ENTRY}, parent string, part long"), "forest")


def hierarchy(linked: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """node, parent, root, depth, cycle of every node of `links(...)`.

    root and depth (1 at the root) are null on and below cycles; cycle is null elsewhere."""
    forest = _forest(single_parent(linked), group_limit)
    whole = _follow(forest.drop("part"), _solve(_boundary(forest.drop("parent")), group_limit)).dropDuplicates(["node"])
    bent = F.col("looped")
    return whole.select("node", "parent", F.when(~bent, F.col("root")).alias("root"), F.when(~bent, F.col("steps") + 1).alias("depth"), F.when(bent, F.col("low")).alias("cycle"))


PATH_ENTRIES = 200_000


def _in_order(parent: dict[str, str | None]) -> Iterator[str]:
    """The nodes, each before those below it and next to them: rows in this order share long prefixes of their paths."""
    below: dict[str, list[str]] = {}
    for node, up in parent.items():
        if up in parent:
            below.setdefault(up, []).append(node)
    stack = [n for n, up in parent.items() if up not in parent]
    while stack:
        yield (node := stack.pop())
        stack += below.get(node, ())


def _spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths by parent traversal, one part after another. The rows of a part are: paths of its outer targets (kind 0, null
    for one in a loop), links (1), links of nodes that get no path here (2), and nodes with links that do (3)."""

    def spelled(outer: dict, parent: dict, asked: set) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for node in _in_order(parent):  # what is in or below a loop of the part doesn't come
            if node in asked:
                way, x = [node], parent[node]
                while x in parent:
                    way.append(x)
                    x = parent[x]
                if (head := outer.get(x, ())) is not None:
                    rows.append((node, [*head, *reversed(way)]))
                    size += len(rows[-1][1])
                if size > PATH_ENTRIES:
                    yield pd.DataFrame(rows, columns=["node", "path"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["node", "path"])

    now, outer, parent, asked = None, {}, {}, set()
    for pdf in batches:
        for part, kind, node, up, path in zip(pdf["part"], pdf["kind"], pdf["node"], pdf["parent"], pdf["path"]):
            if part != now:
                yield from spelled(outer, parent, asked)
                now, outer, parent, asked = part, {}, {}, set()
            if kind == 0:
                outer[node] = None if path is None else tuple(path)
            elif kind < 3:
                parent[node] = up
            if kind in (1, 3):
                asked.add(node)
    yield from spelled(outer, parent, asked)


def _spelled(*rows: DataFrame) -> DataFrame:
    parts = rows[0]
    for r in rows[1:]:
        parts = parts.unionByName(r)
    return parts.repartition("part").sortWithinPartitions("part", "kind").mapInPandas(_spell, "node string, path array<string>")


def paths(linked: DataFrame) -> DataFrame:
    """node and path (from the root down to the node itself) of every node that has a root, each once."""
    forest = _forest(single_parent(linked))
    none = F.lit(None).cast("array<string>").alias("path")
    border = keep(_boundary(forest).select("part", "node", "tgt", "looped"), "border")
    asked = border.select("part", F.lit(3).alias("kind"), "node", F.lit(None).cast("string").alias("parent"), none)
    wanted = forest.select("part", F.lit(2).alias("kind"), "node", "parent", none).join(asked.select("part").distinct(), "part", "left_semi")
    # What loops within its part stays open for good: its target is itself.
    ends = border.select("node", F.when(F.col("looped"), F.col("node")).otherwise(F.col("tgt")).alias("tgt")).dropDuplicates(["node"])
    own_way = _spelled(wanted, asked).dropDuplicates(["node"])
    now = keep(ends.join(own_way, "node", "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>"))), "way")
    left, before = now.where("tgt IS NOT NULL").count(), -1
    while left and left != before:
        far = now.select(F.col("node").alias("tgt"), F.col("path").alias("p2"), F.col("tgt").alias("t2"))
        now = keep(now.join(far, "tgt", "left").select("node", F.col("t2").alias("tgt"), F.concat(F.coalesce("p2", F.array().cast("array<string>")), "path").alias("path")), "way")
        before, left = left, now.where("tgt IS NOT NULL").count()
    known = border.select("node").distinct().join(now.where("tgt IS NULL").select("node", "path"), "node", "left")
    outer = forest.where("tgt IS NOT NULL").select("part", F.col("tgt").alias("node")).distinct().join(known, "node")
    outer = outer.select("part", F.lit(0).alias("kind"), "node", F.lit(None).cast("string").alias("parent"), "path")
    # A row delivered again in another part is a link there too, but gets its path once; so no path is shuffled.
    again = forest.groupBy("node").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first <> last").drop("last")
    own = forest.join(again, "node", "left").select("part", F.when(F.col("first") < F.col("part"), 2).otherwise(1).alias("kind"), "node", "parent", none)
    return _spelled(outer, own)


def descendants(paths_: DataFrame) -> DataFrame:
    """node, later, distance: every node below each node of `paths(...)`. One row a pair, made without a join."""
    return paths_.select(F.col("node").alias("later"), F.size("path").alias("n"), F.posexplode("path").alias("at", "node")).where("at < n - 1").select("node", "later", (F.col("n") - 1 - F.col("at")).alias("distance"))
