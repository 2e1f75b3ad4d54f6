"""K-d tree sharding by weighted medians.

Rows are points in a unit cube of metadata dimensions and weigh their bytes. Level by level, every node that stands
for more than one leaf is cut along its widest dimension, at the place next to the weighted quantile that gives each side its share of
leaves (the median for an even number). A level is three small aggregates over a narrow table (no text): extents,
a histogram of each node's widest dimension, and one finer histogram of the cell that holds the quantile; histograms
have at most ``CELLS`` cells a node, so no task gathers a node's rows. Cuts are a table of fewer rows than leaves, which
is joined to the points; nothing of it passes through the driver. DataFrame operations only.

Edge cases: a null text weighs what an empty one does; null metadata is the coordinate 0; rows that are equal in all
columns, share an id or have none are told apart by a number of their own, so any of them may part; a very long text is one
row, and its leaf may hold that much more; an empty table gives no rows; columns of the input that are not named as id,
text or dimension are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, materialize, with_rank

CELLS = 4096
ROW_BYTES = 16


def _unit(*columns: Column) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 32)) / F.lit(float(1 << 32))


def coordinates(docs: DataFrame, id_column: str, text_column: str, labels: list[str]) -> DataFrame:
    """id, size, text_crc32, row (a number of the row's own) and the coordinates c0.. in [0, 1): log of the size, then each label's hash.

    A coordinate is spread by a hash of the row's number inside steps of 1/1024 (labels) or 1/65536 (size), so that a value
    that many rows share can still be cut in two.
    """
    docs = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), *(F.col(c).alias(f"label{k}") for k, c in enumerate(labels, 1)),
        F.monotonically_increasing_id().alias("row"),
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    stepped = lambda value, steps, k: (F.floor(F.least(value, F.lit(1 - 1e-9)) * steps) + _unit(F.col("row"), F.lit(k))) / steps
    dims = [stepped(F.log2(size.cast("double")) / 40.0, 65536, 0)]
    dims += [stepped(
        F.when(F.col(f"label{k}").isNull(), F.lit(0.0)).otherwise(_unit(F.col(f"label{k}"))), 1024, k,
    ) for k in range(1, len(labels) + 1)]
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select("id", size.alias("size"), crc.cast("long").alias("text_crc32"), "row", *(d.alias(f"c{k}") for k, d in enumerate(dims)))


def kd_partition(points: DataFrame, dims: list[str], weight: str, leaves: int) -> DataFrame:
    """points with a leaf number ``node`` from 0, for the given number of leaves.

    A node's number is its first leaf and its span how many it stands for, so leaves end up numbered from 0 without gaps.
    """
    tree = points.withColumn("node", F.lit(0)).withColumn("span", F.lit(leaves))
    for level in range(math.ceil(math.log2(leaves)) if leaves > 1 else 0):
        widths = [F.struct((F.max(d) - F.min(d)).alias("width"), F.lit(-k).alias("dim"), F.min(d).alias("lo")) for k, d in enumerate(dims)]
        widest = F.greatest(*widths) if len(widths) > 1 else widths[0]
        goal = (F.sum(weight) * F.floor(F.col("span") / 2) / F.col("span")).cast("double")
        cuts = tree.where("span > 1").groupBy("node", "span").agg(goal.alias("goal"), widest.alias("w"))
        cuts = materialize(
            cuts.select(
                "node", "goal", (-F.col("w.dim")).alias("dim"), F.col("w.lo").alias("lo"), (F.col("w.width") / CELLS).alias("step"),
                F.lit(0.0).alias("below"),
            ),
            "cuts",
        )
        for finer in (False, True):
            found = _cells(tree, cuts, dims, weight, leaves, finer)
            at = F.col("lo") + F.coalesce("cell", F.lit(0)) * F.col("step")
            # The second histogram's cell ends at the cut, or begins there if that is nearer to the goal and leaves something on the left.
            before = F.col("below") + F.coalesce("prior", F.lit(0.0))
            short = (before > 0) & (F.col("goal") - before < before + F.coalesce("w", F.lit(0)) - F.col("goal"))
            lo, step = (F.when(short, at).otherwise(at + F.col("step")), F.col("step")) if finer else (at, F.col("step") / CELLS)
            after = materialize(
                cuts.join(found, "node", "left").select(
                    "node", "goal", "dim", lo.alias("lo"), step.alias("step"), (F.col("below") + F.coalesce("prior", F.lit(0.0))).alias("below"),
                ),
                "cuts",
            )
            discard(cuts)
            cuts = after
        right = F.coalesce(_along(dims) > F.col("lo"), F.lit(False))
        half = F.floor(F.col("span") / 2).cast("int")
        # Nodes without a cut are single leaves.
        node, span = F.when(right, F.col("node") + half).otherwise(F.col("node")), F.when(F.col("lo").isNull(), F.col("span")).when(right, F.col("span") - half).otherwise(half)
        after = materialize(tree.join(_held(cuts, leaves), "node", "left").select(*points.columns, node.alias("node"), span.alias("span")), "kd")
        discard(cuts, *([tree] if level else []))
        tree = after
    return tree.drop("span")


def _held(cuts: DataFrame, leaves: int) -> DataFrame:
    """cuts, broadcast where their number, less than leaves, is small."""
    return F.broadcast(cuts) if leaves <= BROADCAST_ROWS else cuts


def _along(dims: list[str]) -> Column:
    """The coordinate along which the row's node is cut."""
    return F.element_at(F.array(*dims), F.col("dim") + 1)


def _cells(tree: DataFrame, cuts: DataFrame, dims: list[str], weight: str, leaves: int, finer: bool) -> DataFrame:
    """For each node the cell of its histogram in which the weight from the left reaches the goal, and the weight before that cell.

    The first histogram holds all rows of the node; the finer one those inside one cell of the first.
    """
    rows = tree.select("node", weight, *dims).join(_held(cuts, leaves), "node").withColumn("x", _along(dims))
    cell = F.when(F.col("step") > 0, F.ceil((F.col("x") - F.col("lo")) / F.col("step")) - 1).otherwise(F.lit(0)).cast("int")
    rows = rows.select("node", weight, "goal", "below", "x", "lo", cell.alias("cell"))
    if finer:
        rows = rows.where((F.col("cell") >= 0) & (F.col("cell") < CELLS) | (F.col("x") == F.col("lo")) & (F.col("below") == 0))
    histogram = rows.groupBy(
        "node", "goal", "below", F.greatest(F.least("cell", F.lit(CELLS - 1)), F.lit(0)).alias("cell"),
    ).agg(F.sum(weight).alias("w"))
    upto = Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    running = histogram.withColumn("upto", F.sum("w").over(upto))
    parts = F.struct("cell", (F.col("upto") - F.col("w")).cast("double").alias("prior"), "w")
    reached = F.col("below") + F.col("upto") >= F.col("goal")
    return running.groupBy("node").agg(F.coalesce(F.min(F.when(reached, parts)), F.max(parts)).alias("r")).select("node", "r.cell", "r.prior", "r.w")


def shard(
    docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, id_column: str = "doc_id", text_column: str = "text",
    labels: list[str] = ("source", "lang"),
) -> DataFrame:
    """id_column, size, text_crc32, shard, slot for each row of docs: by number of leaves, or by the bytes that a leaf may hold."""
    points = materialize(coordinates(docs, id_column, text_column, list(labels)), "points")
    rows, total = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = leaves or max(1, -(-total // target_bytes))
    dims = [c for c in points.columns if c[0] == "c" and c[1:].isdigit()]
    placed = kd_partition(points, dims, "size", leaves)
    out = with_rank(placed.select("id", "size", "text_crc32", "row", F.col("node").alias("shard")), ["shard"], ["row"], "slot", rows)
    return out.drop("row").withColumnRenamed("id", id_column)
