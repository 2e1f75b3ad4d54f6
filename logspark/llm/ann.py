"""Nearest neighbours by inner product through a hash-prefix forest.

Vectors become points of a sphere (a coordinate is added so that the largest inner product is the smallest angle) and,
for each tree, a string of hyperplane bits. A tree is the sorted array of its strings: the rows that share a prefix
with a query are a slice of it. A query descends all trees to the longest prefixes whose slices hold enough candidates
together, and ascends tree by tree for the last of them; candidates are scored on the original vectors.

The index is cut into blocks of rows whose sorted arrays are built once and written; blocks of queries search them, and the
best of all blocks are kept. In a block of n rows the ascent ends when the slices are expected to hold
k + ``CANDIDATES`` n ** ``GROWTH`` rows, at every size.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of other
lengths are not candidates of each other; equal vectors are one point of the index with its smallest ids, which is
exact as ties go to the smaller id; repeated rows of an id are one candidate, rows without an id are neither queries nor
candidates; fewer candidates than asked for give fewer rows; an empty table gives no rows; of the input only id and vector
are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, BITS = 96, 32
#: How many of a block's n rows are candidates: k + CANDIDATES * n ** GROWTH. Recall against brute force rests on it.
CANDIDATES, GROWTH = 1.6, 0.86
#: Bytes of vectors in a block of the index, and queries of a block.
BLOCK_BYTES, QUERIES = 8 << 20, 8_192


def takes_part(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def strings(lifted: np.ndarray, trees: int) -> np.ndarray:
    """For each tree and point its string of bits: on which side of the tree's hyperplanes it lies."""
    planes = np.random.default_rng(20).standard_normal((trees, lifted.shape[1], BITS))
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    return np.array([((lifted @ p > 0) * weights).sum(axis=1, dtype=np.uint64) for p in planes], np.uint64).reshape(trees, len(lifted))


class Forest:
    """The sorted string arrays of one block of rows: rows, and for each tree its strings in order and whose they are."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, order: np.ndarray):
        self.rows, self.keys, self.order = rows, keys, order

    @classmethod
    def build(cls, rows: np.ndarray, longest: float, trees: int = TREES) -> Forest:
        unit = rows / longest
        lifted = np.column_stack([unit, np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))])
        keys = strings(lifted, trees).astype(np.uint32)
        order = np.argsort(keys, axis=1, kind="stable")
        return cls(rows, np.take_along_axis(keys, order, axis=1), order.astype(np.uint32))

    def _slices(self, asked: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the slice [from, to) of the strings that share the first level bits; empty above all bits."""
        shift = np.maximum(BITS - level, 0).astype(np.uint64)
        first = asked >> shift << shift
        last = first | ((np.uint64(1) << shift) - np.uint64(1))
        lo = np.array([np.searchsorted(k, x, "left") for k, x in zip(self.keys, first.astype(np.uint32), strict=True)])
        hi = np.array([np.searchsorted(k, x, "right") for k, x in zip(self.keys, last.astype(np.uint32), strict=True)])
        return lo, np.where(level > BITS, lo, hi)

    def ascend(self, queries: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the slice at which the synchronous ascent stops.

        Slices only grow on the way up, so the level is found by bisection: the longest prefix at which all trees together
        hold wanted rows. Above it trees ascend one after the other until they do.
        """
        n, m = len(self.rows), len(queries)
        asked = strings(np.column_stack([queries, np.zeros(m)]), len(self.keys))
        outside = lambda lo, hi: 1 - (hi - lo) / n
        low, high = np.zeros(m, np.int64), np.full(m, BITS + 1)
        while (high - low > 1).any():
            level = (low + high) // 2
            enough = n * (1 - outside(*self._slices(asked, level)).prod(axis=0)) >= wanted
            low, high = np.where(enough, level, low), np.where(enough, high, level)
        lo, hi = self._slices(asked, low)
        lo_before, hi_before = self._slices(asked, low + 1)
        up, down = np.cumprod(outside(lo, hi), axis=0), np.cumprod(outside(lo_before, hi_before)[::-1], axis=0)[::-1]
        missed = up * np.concatenate([down[1:], np.ones((1, m))])
        ascended = np.argmax(n * (1 - missed) >= wanted - 1e-9, axis=0)
        stays = np.arange(len(self.keys))[:, None] > ascended[None, :]
        return np.where(stays, lo_before, lo), np.where(stays, hi_before, hi)

    def search(self, queries: np.ndarray, k: int, candidates: float = CANDIDATES, growth: float = GROWTH) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k best rows found (ties to the first rows) and their inner products."""
        n = len(self.rows)
        lo, hi = self.ascend(queries, min(n, k + candidates * n**growth))
        out = []
        for q in range(len(queries)):
            mark = np.zeros(n, bool)
            for order, a, b in zip(self.order, lo[:, q].tolist(), hi[:, q].tolist(), strict=True):
                mark[order[a:b]] = True
            found = np.flatnonzero(mark)
            scores = self.rows[found] @ queries[q]
            if len(found) > k:
                edge = np.partition(scores, len(found) - k)[len(found) - k]
                keep = scores >= edge
                found, scores = found[keep], scores[keep]
            best = np.lexsort((found, -scores))[:k]
            out.append((found[best], scores[best]))
        return out


FOREST = "dim int, block int, reps binary, vectors binary, keys binary, ranks binary"


def nearest(
    rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", trees: int = TREES,
    candidates: float = CANDIDATES, growth: float = GROWTH, block_bytes: int = BLOCK_BYTES, query_block: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that is_query picks (an expression on id_column)."""
    table = rows.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    ).where(takes_part("v") & F.col("vec_id").isNotNull())
    table = materialize(table, "vectors")
    # The k + 1 smallest ids of a vector are all that can be among any query's k nearest; ranks are cut before the shuffle.
    first = table.select("v", "vec_id").distinct().withColumn(
        "r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")),
    ).where(F.col("r") <= k + 1)
    index = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]).withColumn("dim", F.size("v"))
    index = materialize(index, "index")
    queries = table.where("q").select(F.col("vec_id").alias("query_id"), "v").distinct().join(index.select("v", "rep", "dim"), "v").select("query_id", "rep", "dim")
    queries = materialize(queries, "queries")
    counts = {r["dim"]: (r["n"], r["longest"]) for r in index.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"),
    ).collect()}
    if not counts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = {r["dim"]: r["n"] for r in queries.groupBy("dim").agg(F.countDistinct("rep").alias("n")).collect()}
    number = lambda values, size: F.create_map(*(F.lit(x) for d in counts for x in (
        d, max(1, -(-values.get(d, 0) // size(d))),
    )))[F.col("dim")]
    blocks, parts = number({d: n for d, (n, _) in counts.items()}, lambda d: max(1, block_bytes // (8 * d))), number(asked, lambda d: query_block)

    def build(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("rep")
        forest = Forest.build(np.vstack(held["v"].to_list()), counts[int(key[0])][1], trees)
        return pd.DataFrame({
            "dim": [key[0]], "block": [key[1]], "reps": [held["rep"].to_numpy(np.int64).tobytes()], "vectors": [forest.rows.tobytes()],
            "keys": [forest.keys.tobytes()], "ranks": [forest.order.tobytes()],
        })

    dealt = index.select("rep", "v", "dim", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    built = materialize(dealt.groupBy("dim", "block").applyInPandas(build, FOREST), "forest")
    right = built.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    left = queries.select("rep", "dim").distinct().join(index.select("rep", F.col("v").alias("asked")), "rep").select(
        "rep", "asked", "dim", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
    )

    def search(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "near": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        block = held.iloc[0]
        near = np.frombuffer(block["reps"], np.int64)
        of = lambda name, kind, n: np.frombuffer(block[name], kind).reshape(n, -1)
        forest = Forest(of("vectors", np.float64, len(near)), of("keys", np.uint32, trees), of("ranks", np.uint32, trees))
        found = forest.search(np.vstack(asked["asked"].to_list()), k + 1, candidates, growth)
        return pd.DataFrame({
            "rep": np.repeat(asked["rep"].to_numpy(), [len(i) for i, _ in found]), "near": np.concatenate([near[i] for i, _ in found]),
            "score": np.concatenate([s for _, s in found]),
        })

    key = ["dim", "block", "part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "rep long, near long, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "near"))).where(F.col("r") <= k + 1)
    ids = best.join(index.select(F.col("rep").alias("near"), "ids"), "near").select(
        "rep", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("vec_id")))).alias("c"),
    )
    lists = ids.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k + 1).alias("near"))
    own = queries.join(lists, "rep").select("query_id", F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "c")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.s")).alias("score"),
    )
