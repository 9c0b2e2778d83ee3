"""Merkle manifest of a dataset: a tree per group of rows, a tree over the group roots, and a proof for every row.

Rows of a group, in a given order, are the leaves. At every level each run of `arity` consecutive nodes (the last
run may be shorter) has one parent, the SHA-256 of its nodes' hex digests, until one node is left: the group's
subroot, which is the leaf itself where a group has one row. Subroots, in the order of their groups, make the leaves of
the tree on top in the same way. Hashes travel as 32 bytes and are hashed as lower-case hex.

How. Every level is a table of nodes (tree, place). Each node looks up each of its siblings by an equijoin of the
level with itself on (tree, computed place of the sibling): place XOR 1 in a binary tree, and the slot shifted by
1 .. arity - 1 otherwise. Rows of slot zero then hold the whole run and emit its parent. Keys of these joins are
unique on both sides, so no tree is skewed however many rows it has. Proofs come back down: a node's path is its own
siblings followed by the path of its parent, one equijoin a level. Places are numbered by a range sort and
per-partition counts, never in one task.

Output, one row per input row: the columns asked for in `keep`, `leaf`, `subroot`, `root` (binary) and `path`, an
array of (left, right) with the digests before and after the node, from its level up to the root.

Defined cases. Null group: a group of its own, before all others. Null order value: before all others. Rows that tie
on the order are ordered by their leaves; equal rows are leaves of their own with the same hash. A single row: its leaf is
the root and its path is empty. Empty table: no rows. A column `keep` may have any name; others of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitpanel.session import materialise

EMPTY = "X''"
STEP = "struct<left: binary, right: binary>"
#: Bits of monotonically_increasing_id that count rows inside a partition.
WITHIN = 33


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(x: Column) -> Column:
    return F.lower(F.hex(x))


def field(x: Column) -> Column:
    """A value with its length in bytes, so that no two rows have one serial form; null is a dash."""
    s = x.cast("string")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def row_digest(*columns: Column) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def fold(leaf: Column, path: Column) -> Column:
    """Hex root that a hex leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(hexed(s["left"]), h, hexed(s["right"])).cast("binary"), 256))


def siblings_hex(path: Column) -> Column:
    """All digests of a path, in order, as one hex string."""
    return F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")


def in_order(df: DataFrame, order: list[str], by: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their partition and position, one span per group and partition): a range sort and its counts.

    A row's place is the rows of its group in earlier partitions (before) plus its position after the group's first
    row in its own (first). Only counts per (group, partition) are summed. `order` starts with `by`.
    """
    at = F.monotonically_increasing_id()
    deal = df.withColumn("__deal", at)  # copies of one row still spread over partitions
    placed = deal.repartitionByRange(*order, "__deal").sortWithinPartitions(*order, "__deal").drop("__deal").withColumn("__at", at)
    rows = materialise(placed.withColumn("__part", F.shiftright("__at", WITHIN)), label)
    spans = rows.groupBy("__part", *by).agg(F.count("*").alias("__c"), F.min("__at").alias("__first"))
    window = Window.partitionBy(*by).orderBy("__part")
    return rows, spans.withColumn("__before", F.sum("__c").over(window) - F.col("__c"))


def placed(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Rows with place and what else the span of their group and partition holds."""
    s = spans.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__part").alias("__p"), *[c for c in spans.columns if c not in (*by, "__part", "__c")])
    same = [rows[c].eqNullSafe(s[f"__b_{c}"]) for c in by]
    found = rows.join(s, reduce(Column.__and__, same, rows["__part"] == s["__p"]))
    place = F.col("__before") + F.col("__at") - F.col("__first")
    return found.withColumn("place", place).drop("__at", "__part", "__p", "__first", "__before", *[f"__b_{c}" for c in by])


def linked(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, place, n, h, ...) of runs, with the digests of the siblings before and after each as left and right."""
    found = nodes.alias("a")
    for s in range(1, arity):
        where = F.col("a.place").bitwiseXOR(F.lit(1)) if arity == 2 else F.expr(f"a.place - a.place % {arity} + (a.place % {arity} + {s}) % {arity}")
        found = found.join(nodes.select("tree", "place", "h").alias(f"s{s}"), (F.col("a.tree") == F.col(f"s{s}.tree")) & (where == F.col(f"s{s}.place")), "left")
    empty = F.expr(EMPTY)
    after = lambda s: F.expr(f"a.place % {arity} + {s} < {arity}")
    part = lambda is_after: F.concat(*[F.when(after(s) == F.lit(is_after), F.coalesce(f"s{s}.h", empty)).otherwise(empty) for s in range(1, arity)])
    return found.select(*[f"a.{c}" for c in nodes.columns], part(False).alias("left"), part(True).alias("right"))


def climb(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The levels of all trees, from the leaves (tree, place, n, h, ...) up to the last root; those of runs have left and right.

    Each level is a written table, so a lost executor repeats one level and no plan holds another level twice.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while True:
        if most <= 1:
            levels.append(nodes.withColumn("left", F.expr(EMPTY)).withColumn("right", F.expr(EMPTY)))
            return levels
        level = materialise(linked(nodes, arity), "nodes")
        levels.append(level)
        up = F.col("n") > 1
        nodes = level.filter(up & (F.col("place") % arity == 0)).select(
            "tree", F.expr(f"place div {arity}").alias("place"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest(F.concat(hexed(F.col("h")), hexed(F.col("right")))).alias("h"),
        )
        most = -(-most // arity)


def descend(levels: list[DataFrame], tops: DataFrame | None, arity: int) -> DataFrame:
    """The lowest level with subroot, root and path; tops (tree, root, path) continues the path of each tree's root."""
    above = None
    kept = [c for c in levels[0].columns if c.startswith("__k")]
    for k, level in reversed(list(enumerate(levels))):
        own = ["tree", "place", "n", "h", *(kept if k == 0 else [])]
        if tops is None:
            ended = level.filter("n = 1").select(*own, F.col("h").alias("subroot"), F.col("h").alias("root"), F.expr(f"cast(array() as array<{STEP}>)").alias("path"))
        else:
            ended = level.filter("n = 1").alias("a").join(tops.alias("t"), F.col("a.tree") == F.col("t.tree"))
            ended = ended.select(*[f"a.{c}" for c in own], F.col("a.h").alias("subroot"), "t.root", "t.path")
        if above is not None:
            up = (F.col("a.tree") == F.col("b.tree")) & (F.expr(f"a.place div {arity}") == F.col("b.place"))
            path = F.concat(F.array(F.struct("a.left", "a.right")), F.col("b.path")).alias("path")
            ended = level.filter("n > 1").alias("a").join(above.alias("b"), up).select(*[f"a.{c}" for c in own], "b.subroot", "b.root", path).union(ended)
        above = ended
    return above


def manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, keep: dict[str, Column], arity: int = 3) -> DataFrame:
    """The columns `keep`, leaf, subroot, root and path of every row; see above."""
    if arity < 2:
        raise ValueError("a tree needs two slots a node at least")
    base = rows.select(*[c.alias(f"__k{i}") for i, c in enumerate(keep.values())], group.alias("__group"), order.alias("__order"), leaf.alias("h"))
    ordered, spans = in_order(materialise(base, "rows"), ["__group", "__order", "h"], ["__group"], "ordered")
    sizes = materialise(spans.groupBy("__group").agg(F.sum("__c").alias("n")), "sizes")
    trees = placed(*in_order(sizes, ["__group"], [], "trees"), [])
    named = trees.select(F.col("__group").alias("__g"), F.col("place").alias("tree"), "n")
    spans = spans.join(named, spans["__group"].eqNullSafe(named["__g"])).drop("__g")
    leaves = placed(ordered, spans, ["__group"]).drop("__group", "__order")
    levels = climb(materialise(leaves, "leaves"), arity)
    subroots = reduce(DataFrame.unionByName, [level.filter("n = 1").select("tree", "h") for level in levels])
    how_many = sizes.count()
    top = materialise(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(how_many).cast("long").alias("n"), "h"), "subroots")
    tops = descend(climb(top, arity), None, arity).select(F.col("place").alias("tree"), "root", "path")
    found = descend(levels, tops, arity)
    return found.select(*[F.col(f"__k{i}").alias(name) for i, name in enumerate(keep)], F.col("h").alias("leaf"), "subroot", "root", "path")

