"""N-gram Jaccard join by MinHash banding.

Texts with the same set of word 5-grams are one copy class, a node. Each node gets a MinHash signature; its bands, whose
number and rows are chosen for a target recall at the threshold, are shuffled by band hash. A node's home is the least
of the nodes it shares a bucket with; the nodes of a home are dealt to blocks of bounded size. Two blocks that share a bucket
are verified on the full n-gram sets, every node of the one against every node of the other, so a pair is never a row and
nodes that no bucket connects directly are not compared. Block pairs give each node's number of links and a star of
links for each of their components; the stars' components are the result's classes.

Keys that many rows have (a text of many copies, a band hash or a class of many nodes) are joined between tables that are
written first, which adaptive execution can split.

Edge cases: a text of fewer than five words is one n-gram of all its words; a null text and one without words has no
n-gram, no link and a class of its own (its id); repeated rows are copies of each other; rows are told apart by their texts, so
texts that share an id, or have none, are linked each by itself; a class is named by its smallest id, by null if it has none;
an empty table gives no rows; of the input only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, map_batches, materialize, mixed, ngram_set, small

THRESHOLD, NGRAM = 0.8, 5
#: Chance that a pair exactly at the threshold shares a band, and most hashes of a signature.
RECALL, MAX_HASHES = 0.9999, 200
#: Most classes in a block, and n-grams of all its classes, on average.
BLOCK, BLOCK_GRAMS = 256, 400_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, for the fewest false candidates, that reach the recall with max_hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (h[n:] >> np.uint64(32)).astype(np.uint32)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash a x + b over the set."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096, None] * a[None, :] + b[None, :]
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def _profiles(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (of the n-gram set; null: no n-gram), grams (their number) and bands (a hash of each band's rows)."""
    a, b = _permutations(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for ids, texts in chunks(batches):
            keys, grams, hashes = [], [], []
            for t in texts:
                s = ngram_set(t, n)
                grams.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                h = number
                for row in signature(s, a, b).reshape(bands, rows).T if len(s) else ():
                    h = mixed(h * np.uint64(0x100000001B3) + row)
                hashes.append(h.view(np.int64) if len(s) else None)
            yield pa.record_batch(
                [ids, pa.array(keys, pa.binary()), pa.array(grams, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "key", "grams", "bands"],
            )

    return map_batches(docs, run, "doc_id long, key binary, grams int, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, for edges (a, b); nodes without an edge are left out.

    Large-star and small-star steps: each links nodes to smaller ones only, so a hub is a join key of many rows, never a
    gathered list. Both sides of a step's join are written, so adaptive execution splits a hub's rows; that cuts lineage too.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "low")
        # Large star: larger neighbours go to the least of the neighbourhood.
        large = materialize(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: smaller neighbours, and the node itself, go to the least of them.
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        after = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
        )).alias("e"))
        after = materialize(after.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        discard(edges, low, large, least)
        edges = after
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # Every edge now goes from a node to its component's least.
    return edges.select(
        F.col("a").alias("node"), F.col("b").alias("component"),
    ).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _shared(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    """Sizes of the intersections of x's and y's sets, by products of incidence matrices over a few thousand n-grams at a time."""
    sets = [np.frombuffer(s, np.uint64) for s in [*x["set"], *y["set"]]]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = seen > 1
    column = np.cumsum(often) - 1
    keep = often[gram]
    owner, gram = owner[keep], column[gram[keep]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((len(x), len(y)), np.float32)
    width = 2048
    for at in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
        i, j = np.searchsorted(gram, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], gram[i:j] - at] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def _stars(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """For the components that links make of a block pair: each node with its component's least, but for the least itself."""
    none = np.iinfo(np.int64).max
    x, y = left, right
    while True:
        x2 = np.minimum(x, np.where(links, y[None, :], none).min(axis=1))
        y2 = np.minimum(y, np.where(links, x2[:, None], none).min(axis=0))
        if (x2 == x).all() and (y2 == y).all():
            break
        x, y = x2, y2
    return [(a, b) for a, b in {*zip(left.tolist(), x.tolist(), strict=True), *zip(right.tolist(), y.tolist(), strict=True)} if a != b]


def verify(key: tuple, rows: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """One pair of blocks: for each node its links, and the stars of links (node, other)."""
    i, j = key
    x = rows[rows["block"] == i].reset_index(drop=True)
    y = x if i == j else rows[rows["block"] == j].reset_index(drop=True)
    out = []
    if len(x) and len(y):
        nx, ny = x["grams"].to_numpy(), y["grams"].to_numpy()
        shared = _shared(x, y).astype(float)
        links = shared / (nx[:, None] + ny[None, :] - shared) >= threshold - 1e-12
        if i == j:
            np.fill_diagonal(links, False)
        rx, ry, cx, cy = x["node"].to_numpy(), y["node"].to_numpy(), x["copies"].to_numpy(), y["copies"].to_numpy()
        out += [(r, None, int(k), int(w)) for r, k, w in zip(rx.tolist(), links.sum(axis=1), links @ cy, strict=True) if k]
        if i != j:
            out += [(r, None, int(k), int(w)) for r, k, w in zip(ry.tolist(), links.sum(axis=0), links.T @ cx, strict=True) if k]
        out += [(a, b, 0, 0) for a, b in _stars(links, rx, ry)]
    return pd.DataFrame(
        out, columns=["node", "other", "texts", "docs"],
    ).astype({"node": "Int64", "other": "Int64", "texts": "int64", "docs": "int64"})


def _blocks(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that share a bucket with another (node, key, rep, grams, copies, block), and the pairs (i, j) of blocks to verify."""
    band = classes.select("node", F.explode("bands").alias("hash"))
    hubs = materialize(band.groupBy("hash").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hubs")
    touch = materialize(band.join(hubs, "hash"), "buckets")
    homes = touch.groupBy("node").agg(F.min("hub").alias("home"))
    member = materialize(homes.join(classes.select("node", "key", "rep", "grams", "copies"), "node"), "homes")
    sizes = materialize(
        member.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS)).alias("blocks")), "sizes",
    )
    # Should two blocks have one hash, they are one larger block.
    dealt = materialize(
        member.join(sizes, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("blocks")))).drop("home", "blocks"),
        "members",
    )
    at = materialize(touch.select("node", "hash").join(dealt.select("node", "block"), "node").select("hash", "block").distinct(), "touched")
    across = at.withColumnRenamed("block", "i").join(at.withColumnRenamed("block", "j"), "hash").where("i < j").select("i", "j").distinct()
    inside = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("block").alias("i"), F.col("block").alias("j"))
    pairs = materialize(across.unionByName(inside), "pairs")
    discard(hubs, touch, member, sizes, at)
    return dealt, pairs


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """For each row of docs (doc_id, text): class_id (smallest doc_id of all rows linked with it, also through others),
    links (other rows whose n-gram set is at least threshold similar), text_links (other different sets among them)
    and copies (rows with the same set, itself counted)."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = materialize(_profiles(docs, n, bands, rows), "profile")
    classes = profile.where("grams > 0").groupBy("key", "grams").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"),
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    member, pairs = _blocks(classes)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            made = [ngram_set(t, n).tobytes() for t in texts]
            yield pa.record_batch(
                [pa.array([xxhash.xxh3_128_digest(s) for s in made], pa.binary()), pa.array(made, pa.binary())], names=["key", "set"],
            )

    # Only the members' texts are read for their sets: by id, or all texts without one if a member has none. The key then tells them apart.
    reps = materialize(member.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct(), "reps")
    source = docs.join(small(reps), "doc_id", "left_semi")
    if not member.where("rep is null").isEmpty():
        source = source.unionByName(docs.where("doc_id is null"))
    full = map_batches(source, sets, "key binary, set binary").groupBy("key").agg(F.first("set").alias("set"))
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    found = member.join(sides, "block").join(full, "key").groupBy("i", "j").applyInPandas(
        lambda key, pdf: verify(key, pdf, threshold), "node long, other long, texts long, docs long",
    )
    found = materialize(found, "links")
    linked = found.where("other is null").groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    joined = materialize(
        components(found.where("other is not null").select(
            F.col("node").alias("a"), F.col("other").alias("b"),
        )).join(classes.select("node", "rep"), "node"),
        "joined",
    )
    names = materialize(joined.groupBy("component").agg(F.min("rep").alias("class_id")), "names")
    named = joined.join(names, "component").select("node", "class_id", F.lit(True).alias("named"))
    labels = classes.select("node", "key", "rep", "copies").join(named, "node", "left").join(linked, "node", "left").select(
        "key", "copies", F.when(F.col("named"), F.col("class_id")).otherwise(F.col("rep")).alias("class_id"), F.coalesce("texts", F.lit(0)).alias("text_links"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("links"))
    labels = materialize(labels, "labels")
    return profile.join(labels, "key", "left").select(
        "doc_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"), F.coalesce("copies", F.lit(1)).alias("copies"))
