"""Merkle dataset manifest by cogrouped subtree exchange.

Every row is a leaf; leaves of a group stand in the order of a column, and every two consecutive nodes become their parent
until one is left, the group's subroot (a lone leaf is that itself). Subroots, in the order of their groups, give the root likewise.

Leaves are numbered within their group, so 1,024 consecutive ones are a superblock whatever the group's size. A superblock is
reduced to one node, superblocks of those nodes again, until every group has one. On the way back, nodes and what they need
from outside (the siblings on the way to the root) are cogrouped by superblock: one function reduces the leaves once more, joins
local to outer siblings and folds each leaf's claim to a root. So a task holds a superblock and one path, whatever the input.

Rows are not told apart by ids: of equal order values (null comes first) the smaller digest comes first, and equal rows are
equal leaves. A null group is a group of its own, before all others; groups are ordered by their UTF-8 bytes. An empty table has no
rows and no root. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.ordered import number

from .common import bound_batches, claim, discard, materialize, small

#: Levels of a superblock, if not told otherwise: it has 2 ** 10 leaves.
LEVELS = 10
EXACT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
#: A path holds one text for each level: how the sibling stands and its digest, or nothing where a node has none.
LEFT, RIGHT = "<", ">"
PATHS = "grp string, place long, path array<string>, subroot string, root string"


def field(column: Column) -> Column:
    """A value as a digest's input: its bytes counted, then itself; - for null."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(columns: list[Column]) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes and, level by level, their ancestors."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([hashed("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def height_of(n: int, alone: bool, levels: int) -> int:
    """Levels of a superblock of n nodes: as many as one node takes, and all where its group has other superblocks."""
    return (n - 1).bit_length() if alone else levels


def local_paths(tree: list[list[str]]) -> list[list[str]]:
    """For each leaf of a reduced superblock, its siblings from below."""
    out = []
    for leaf in range(len(tree[0])):
        path = []
        for level, nodes in enumerate(tree[:-1]):
            other = (leaf >> level) ^ 1
            path.append((LEFT if other < leaf >> level else RIGHT) + nodes[other] if other < len(nodes) else "")
        out.append(path)
    return out


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        leaf = hashed(step[1:] + leaf if step[:1] == LEFT else leaf + step[1:])
    return leaf


def _parents(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes (grp, place, node, alone: the group is one superblock) of the next level of superblocks."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        claim(__name__)
        rows = rows.sort_values("place")
        top = reduced(list(rows["node"]), height_of(len(rows), bool(rows["alone"].iloc[0]), levels))[-1]
        return pd.DataFrame({"grp": [key[0]], "place": [key[1]], "node": top})

    up = nodes.select("grp", "place", "node", "alone", F.shiftright("place", levels).alias("block"))
    return up.groupBy("grp", "block").applyInPandas(run, "grp string, place long, node string")


def _with_alone(nodes: DataFrame, name: str, levels: int) -> tuple[DataFrame, bool]:
    """nodes, written, with whether their group is one superblock; and whether every group is one node."""
    written = materialize(nodes, f"{name}-nodes")
    size = written.groupBy("grp").agg((F.max("place") < 1 << levels).alias("alone"), F.max("place").alias("last"))
    sized = materialize(size, f"{name}-groups")
    ended = not sized.where("last > 0").limit(1).collect()
    # A group is a row here and may have any share of the rows there; where there are too many groups to broadcast, adaptive execution splits it.
    return written.join(small(sized.select("grp", "alone")), "grp"), ended


def _climb(nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """The levels of superblocks over nodes (grp, place, node), each written, from nodes to one node a group."""
    out = []
    while True:
        found, ended = _with_alone(nodes, name, levels)
        out.append(found)
        if ended:
            return out
        nodes = _parents(found, levels)


def _exchange(nodes: DataFrame, outer: DataFrame, finish, schema: str, levels: int) -> DataFrame:
    """Cogroups nodes (grp, place, node, alone) with what is outside of their superblocks (PATHS), by superblock.
    finish gets the sorted nodes, their siblings up to the root, and the outer row."""

    def run(key: tuple, rows: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        claim(__name__)
        rows, outside = rows.sort_values("place"), outside.iloc[0]
        tree = reduced(list(rows["node"]), height_of(len(rows), bool(rows["alone"].iloc[0]), levels))
        above = list(outside["path"])
        return finish(rows, [p + above for p in local_paths(tree)], outside)

    left = nodes.withColumn("block", F.shiftright("place", levels)).groupBy("grp", "block")
    right = outer.select("grp", F.col("place").alias("block"), "path", "subroot", "root").groupBy("grp", "block")
    return left.cogroup(right).applyInPandas(run, schema)


def _paths(rows: pd.DataFrame, paths: list, outside: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"grp": rows["grp"], "place": rows["place"], "path": paths, "subroot": outside["subroot"], "root": outside["root"]})


def _descend(tables: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """From what each group's one node has outside to what each superblock of the lowest level has."""
    for found in reversed(tables[1:]):
        outer = materialize(_exchange(found, outer, _paths, PATHS, levels), "outer")
    return outer


def _ranges(df: DataFrame, *order) -> DataFrame:
    """df, written in ranges of order, with the number of each row's range."""
    return materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def prove(
    leaves: DataFrame, group: Column, order: Column, leaf: Column, claimed: Column | None = None, keep: tuple[Column, ...] | list[Column] = (), levels: int = LEVELS,
) -> DataFrame:
    """The manifest of leaves: keep's columns, position (from 0 in the group), leaf, subroot, root, proof (the siblings from below,
    each as it stands, < or >, and its digest; '' on a level where the node has none), folded_root and verified.

    claimed is the digest to be checked, by default the leaf: folded_root is what it gives with the siblings of the leaf, and it is
    verified if that is the root.
    """
    bound_batches(leaves.sparkSession)
    names = leaves.select(*keep).columns
    # As JSON, as pandas would make long numbers with nulls beside them inexact.
    shown = F.struct(F.lit(True).alias("x"), *(c.alias(f"k{i}") for i, c in enumerate(keep)))
    kind = leaves.select(shown.alias("kept")).schema["kept"].dataType
    text = group.cast("string")
    # Read once, and written with numbers that deal out equal rows, which may be a third of all.
    rows = materialize(leaves.select(
        F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("v"), text)).alias("grp"), order.alias("at"), leaf.alias("node"),
        (leaf if claimed is None else claimed).alias("claim"), F.monotonically_increasing_id().alias("tie"), F.to_json(shown, {"timestampFormat": EXACT}).alias("kept"),
    ), "digests")
    dealt = _ranges(rows, "grp", F.asc_nulls_first("at"), "node", "tie")
    placed = number(dealt, ["grp"], "_range", [F.asc_nulls_first("at"), "node", "tie"], "place", first=0).drop("_range", "at", "tie")
    tables = _climb(placed, "leaves", levels)
    discard(rows, dealt)
    tops = _ranges(tables[-1].select("grp", "node"), "grp").withColumn("all", F.lit("all"))
    heads = number(tops, ["all"], "_range", ["grp"], "place", first=0)
    above = _climb(heads.select(F.col("all").alias("grp"), "place", "node"), "groups", levels)
    root = materialize(above[-1].select(
        "grp", "place", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"),
    ), "root")
    lowest = _descend(above, root, levels)
    to_root = materialize(_exchange(above[0], lowest, _paths, PATHS, levels), "groups-outer")
    outer = heads.select(F.col("grp").alias("named"), "place", "node").join(to_root.select("place", "path", "root"), "place").select(
        F.col("named").alias("grp"), F.lit(0).cast("long").alias("place"), "path", F.col("node").alias("subroot"), "root",
    )
    outer = _descend(tables, materialize(outer, "groups-named"), levels)

    def finish(rows: pd.DataFrame, paths: list[list[str]], outside: pd.Series) -> pd.DataFrame:
        ends = [folded(c, p) for c, p in zip(rows["claim"], paths, strict=True)]
        out = rows[["place", "kept"]].assign(leaf=rows["node"], subroot=outside["subroot"], root=outside["root"], proof=paths, folded_root=ends)
        return out.assign(verified=[e == outside["root"] for e in ends])

    schema = "place long, kept string, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean"
    found = _exchange(tables[0], outer, finish, schema, levels).withColumn("kept", F.from_json("kept", kind, {"timestampFormat": EXACT}))
    named = [F.col(f"kept.k{i}").alias(n) for i, n in enumerate(names)]
    return found.select(*named, F.col("place").alias("position"), "leaf", "subroot", "root", "proof", "folded_root", "verified")


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, from below."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)
