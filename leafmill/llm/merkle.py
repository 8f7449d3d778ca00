"""A Merkle manifest of a table: a leaf per row, a subtree per language, one root, and a proof for each row.

Rows are numbered within their tree by range partitioning. Slices of 8^4 consecutive rows then share one window: the
node of a level stands on its first leaf, so its siblings stand a fixed number of rows before and after it, and lag and
lead columns, masked by the slot in the run and the length of the run, fetch them. A first child hashes its run to the
parent. What remains of a slice is one row, so the next slices are 4,096 times fewer; the subtrees' roots make a tree
in the same way. Paths come back down by a join per slice, one row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ordering import number_by_range
from leafmill.session import keep

FAN = 8
LEVELS = 4  # levels that one slice of rows climbs
STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A value by its length in bytes and itself, ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def manifest(
    docs: DataFrame,
    columns: list[str],
    tree_col: str = "lang",
    id_col: str = "doc_id",
    tampered: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``path``, ``tampered_leaf``.

    A leaf is the digest of ``columns``; leaves of one ``tree_col`` ascend by ``id_col`` (null first, then by leaf, so
    rows that repeat an id have a place, and equal rows may swap theirs). A null tree is a tree of its own, before all
    others. ``path`` has a step per level from the leaf to the root, with the digests left and right of it in its run;
    it is empty if the table is one row. ``tampered`` replaces columns for ``tampered_leaf``. Empty tables give no
    rows; other columns are dropped. ``levels`` sets the size of a slice and does not change the result.
    """
    given = {c: F.col(f"`{c}`") for c in columns}
    changed = given | (tampered or {})
    tree = F.col(f"`{tree_col}`").cast("string")
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        # Sorts as the values do, null first.
        F.coalesce(F.concat(F.lit("="), tree), F.lit("-")).alias("tree"),
        digest(*[field(c) for c in given.values()]).alias("digest"),
        digest(*[field(c) for c in changed.values()]).alias("tampered_leaf"),
    )
    placed = number_by_range(keep(leaves), ["tree"], [F.col("doc_id"), F.col("digest")], "pos", 0)

    def whole(tops: DataFrame) -> DataFrame:
        return tops.select("tree", "pos", F.array().cast(f"array<{STEP}>").alias("path"), F.col("digest").alias("root"))

    def join_subtrees(tops: DataFrame) -> DataFrame:
        named = number_by_range(tops.select(F.col("tree").alias("name"), "digest"), [], [F.col("name")], "pos", 0)
        proven = _prove(named.withColumn("tree", F.lit("")), whole, levels)
        return proven.select(
            F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root", F.col("digest").alias("subroot")
        )

    proven = _prove(placed, join_subtrees, levels)
    return proven.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "tampered_leaf")


def proof(path: Column) -> Column:
    """Digest of all siblings on the way to the root, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def _prove(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], levels: int) -> DataFrame:
    """``nodes`` (tree, pos, digest, ...) with their path and what ``above`` adds to the single top of each tree."""
    slice_rows = FAN**levels
    climbed = _climb(nodes.withColumn("slice", F.floor(F.col("pos") / slice_rows).cast("long")), levels)
    tops = keep(
        climbed.where(F.col("pos") % slice_rows == 0).select("tree", F.col("slice").alias("pos"), F.col("top").alias("digest"))
    )
    if tops.where("pos > 0").isEmpty():
        parents = above(tops)
    else:
        parents = _prove(tops, above, levels).drop("digest")
    parents = parents.withColumnsRenamed({"pos": "slice", "path": "upper"})
    joined = climbed.join(parents, ["tree", "slice"])
    return joined.withColumn("path", F.concat("steps", "upper")).drop("slice", "steps", "upper", "top")


def _climb(nodes: DataFrame, levels: int) -> DataFrame:
    """Adds ``steps``, the path of each node within its slice, and ``top``, on the slice's first row its last parent.

    All windows share one partitioning and order.
    """
    slice_ = Window.partitionBy("tree", "slice")
    ordered = slice_.orderBy("pos")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = nodes.withColumns({"_rows": F.count(F.lit(1)).over(slice_), "_node": F.col("digest")})
    for level in range(levels):
        span = FAN**level  # leaves, so rows, from one node of the level to the next
        # A level is there while several nodes remain; in a later slice they always do.
        here = (F.col("pos") % span == 0) & ((F.col("slice") > 0) | (F.col("_rows") > span))
        slot = F.floor(F.col("pos") / span) % FAN
        before_run = F.floor(F.col("pos") % FAN**levels / (span * FAN)) * FAN
        run = F.least(F.lit(FAN), F.ceil(F.col("_rows") / span) - before_run)
        node = F.col("_node")
        back = [F.when(slot >= k, F.lag(node, k * span).over(ordered)) for k in range(FAN - 1, 0, -1)]
        ahead = [F.when(slot + k < run, F.lead(node, k * span).over(ordered)) for k in range(1, FAN)]
        rows = rows.withColumns({"_here": here, "_first": slot == 0, "_left": F.concat_ws("", *back), "_right": F.concat_ws("", *ahead)})
        step = F.when(F.col("_here"), F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
        parent = F.when(F.col("_here"), digest(node, F.col("_right"))).otherwise(node)
        rows = rows.withColumns(
            {f"_step{level}": F.last(step, ignorenulls=True).over(so_far), "_node": F.when(F.col("_first") & (F.col("pos") % span == 0), parent)}
        )
    steps = F.array(*[F.col(f"_step{level}") for level in range(levels)])
    return rows.select(*nodes.columns, F.filter(steps, lambda s: s.isNotNull()).cast(f"array<{STEP}>").alias("steps"), F.col("_node").alias("top"))
