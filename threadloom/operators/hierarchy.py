"""Parent-child links of unknown depth to full hierarchies by pointer doubling.

Every node starts with a pointer to its parent. A round replaces the pointer by the pointer
of the node it points to and joins the path segments, so the distance covered doubles: trees of
depth D need ceil(log2 D) + 1 rounds. A round in which no pointer reaches a root proves that all
still-open pointers run in circles (if a tree node at depth >= 2^k were open, so would be its
ancestors at the depths that this round resolves).

Each round joins the open pointers with the whole pointer table on the unique node id and writes the
moved ones only; rows that are resolved stay in the table of their round. A parent that owns a large
share of the rows makes the open side skewed; adaptive execution splits that partition because the
other side has one row per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.durable import cut


def _blank_to_null(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def latest_links(rows: DataFrame, key: str, parent: str, version: str) -> DataFrame:
    """(node, parent) of the row with the greatest ``version`` per ``key``.

    Keys that are null are no nodes. Parents are trimmed; blank ones become null. Among rows tied
    on the version the greatest parent wins, null versions lose. Other columns are not read, so
    clashing names do no harm.
    """
    src = rows.select(F.col(key).alias("node"), _blank_to_null(F.col(parent)).alias("parent"), F.col(version).alias("v"))
    return (
        src.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.max(F.struct(F.col("v"), F.col("parent"))).alias("m"))
        .select("node", F.col("m.parent").alias("parent"))
    )


def resolve_hierarchy(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Path, depth and root of every node.

    ``links`` has one row per node: node, parent (null for a root). Result: node, parent, root,
    depth, path (array of ids, root first). A parent that is no node ends the path: the node is a
    root at depth 0. Nodes on a cycle or below one get root null, depth -1 and an empty path. An
    empty input gives an empty result.
    """
    ids = links.select(F.col("node").alias("known"))
    first = cut(
        links.join(ids, F.col("parent") == F.col("known"), "left").select("node", "parent", F.col("known").alias("at"), F.array("node").alias("path")),
        "hierarchy",
    )
    open_rows, resolved = first.where(F.col("at").isNotNull()), [first.where(F.col("at").isNull())]
    still = open_rows.count()
    for _ in range(max_rounds):
        if not still:
            break
        every = union_all([*resolved, open_rows])
        hop = every.select(F.col("node").alias("h_node"), F.col("at").alias("h_at"), F.col("path").alias("h_path"))
        moved = cut(open_rows.join(hop, F.col("at") == F.col("h_node")).select("node", "parent", F.col("h_at").alias("at"), F.concat("h_path", "path").alias("path")), "hierarchy")
        open_rows = moved.where(F.col("at").isNotNull())
        resolved.append(moved.where(F.col("at").isNull()))
        before, still = still, open_rows.count()
        if still == before:
            break
    state = union_all([*resolved, open_rows])
    looped = F.col("at").isNotNull()
    return state.select(
        "node",
        "parent",
        F.when(~looped, F.element_at("path", 1)).alias("root"),
        F.when(looped, F.lit(-1)).otherwise(F.size("path") - 1).cast("bigint").alias("depth"),
        F.when(looped, F.array().cast("array<string>")).otherwise(F.col("path")).alias("path"),
    )


def resolve_roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node, by pointer doubling without paths, so that a row stays small however
    deep its tree. ``links`` as for :func:`resolve_hierarchy`; nodes on a cycle or below one have a null root."""
    ids = links.select(F.col("node").alias("known"))
    # at: the pointer, itself for a root; done: whether it is a root
    state = cut(links.join(ids, F.col("parent") == F.col("known"), "left").select("node", F.coalesce("known", "node").alias("at"), F.col("known").isNull().alias("done")), "roots")
    still = state.where("not done").count()
    resolved, open_rows = [state.where("done")], state.where("not done")
    for _ in range(max_rounds):
        if not still:
            break
        hop = union_all([*resolved, open_rows]).select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("done").alias("h_done"))
        moved = cut(open_rows.join(hop, "at").select("node", F.col("next").alias("at"), F.col("h_done").alias("done")), "roots")
        resolved.append(moved.where("done"))
        open_rows = moved.where("not done")
        before, still = still, open_rows.count()
        if still == before:
            break
    return union_all([*resolved, open_rows]).select("node", F.when(F.col("done"), F.col("at")).alias("root"))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for all pairs of a resolved hierarchy, cycles excluded."""
    return tree.select(
        F.col("node").alias("descendant"),
        F.posexplode("path").alias("pos", "ancestor"),
        F.col("depth"),
    ).where(F.col("pos") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(tree: DataFrame) -> DataFrame:
    """One row per node that lies on no cycle: number of children and of all descendants."""
    pairs = descendants(tree)
    counts = pairs.groupBy("ancestor").agg(
        F.count_if(F.col("distance") == 1).alias("n_children"),
        F.count("*").alias("n_descendants"),
        F.max("distance").alias("height"),
    )
    own = tree.where(F.col("depth") >= 0).select("node", "depth")
    return own.join(counts, own["node"] == counts["ancestor"], "left").select(
        "node",
        "depth",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_children", "n_descendants", "height")],
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name of at least one frame."""
    return reduce(DataFrame.unionByName, frames)
