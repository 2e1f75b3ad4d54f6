"""Vector code compression: product codes whose nearest entries are found by slices and intersected bitmasks.

Vectors of integers are cut into parts of equal length; each part position has a codebook of some entries, and a vector's code is
the number of the nearest entry of each part. A codebook's entries are sorted along each dimension; beside each sorted
coordinate stands the mask of the entries up to there. The entries within a radius along one dimension are then the
difference of two masks, and the AND over dimensions leaves the candidates. Every entry whose distance is at most the radius is
one, so if the nearest candidate is within the radius, it is the nearest of all, ties included; else the radius grows to the
distance of the nearest candidate, or doubles where there is none.

Rows whose vector is null, or holds a null or non-finite component, are left out; so are empty vectors. Rows with a null id or the
same id are rows like others; entries start from the smallest ids (null last), among equal ids from the smaller vectors. Vectors of each
length have codebooks of their own, and a length that is no multiple of the parts is an error, as are components too large
for exact sums of squares in 64 bits. Fewer vectors than entries make fewer entries. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that meet a codebook at once.
ROWS = 8192


class SliceIndex:
    """The entries of one codebook (rows of integers), by sorted coordinates with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, dims = entries.shape
        words = -(-n // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.zeros((n, words), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        # upto[d, k]: the k entries that are smallest along d.
        self.upto = np.zeros((dims, n + 1, words), np.uint64)
        for d in range(dims):
            self.upto[d, 1:] = np.bitwise_or.accumulate(bits[order[:, d]], axis=0)
        # Where entries are denser a smaller radius does: half of the usual distance between neighbours.
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        nearest = apart.min(axis=1) if n > 1 else np.zeros(1, np.int64)
        self.radius = max(1, int(np.sqrt(float(np.median(nearest)))) // 2)

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row of x, the mask of the entries that are within its radius along every dimension."""
        found = None
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            some = self.upto[d, high] ^ self.upto[d, low]
            found = some if found is None else found & some
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry of each row, the lower of equally near ones, and its squared distance."""
        best, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        left, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(left):
            masks = np.ascontiguousarray(self.within(x[left], radius))
            row, entry = np.nonzero(np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little"))
            apart = ((x[left[row]] - self.entries[entry]) ** 2).sum(axis=1)
            # Candidates stand by row, then by number.
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
            least = np.minimum.reduceat(apart, starts) if len(row) else np.empty(0, np.int64)
            rows = row[starts]
            first = np.flatnonzero(apart == np.repeat(least, np.diff(np.r_[starts, len(row)])))
            first = first[np.unique(row[first], return_index=True)[1]]
            best[left[rows]], error[left[rows]] = entry[first], least
            settled = np.zeros(len(left), bool)
            settled[rows] = least <= radius[rows] ** 2
            radius = radius * 2
            radius[rows] = np.sqrt(least.astype(np.float64)).astype(np.int64) + 2
            left, radius = left[~settled], radius[~settled]
        return best, error


def floored(batch: pa.RecordBatch, column: int, parts: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as integers, cut into parts) for each length of vectors in a batch."""
    lists = batch.column(column)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    length = np.nan_to_num(np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    ends = np.cumsum(length)
    for n in np.unique(length[length > 0]):
        if n % parts:
            raise ValueError(f"vectors of {n} components can't be cut into {parts} equal parts")
        rows = np.flatnonzero(length == n)
        found = values[(ends[rows] - n)[:, None] + np.arange(n)]
        fine = np.isfinite(found).all(axis=1)
        rows, found = rows[fine], np.floor(found[fine] * scale)
        if len(found) and np.abs(found).max() >= 2.0 ** 30 / np.sqrt(n):
            raise ValueError("components are too large for sums of squares in 64 bits")
        if len(found):
            yield rows, found.astype(np.int64).reshape(len(rows), parts, n // parts)


def _first(vectors: DataFrame, parts: int, entries: int, scale: int) -> dict[int, np.ndarray]:
    """The codebooks to start from, by length: [part, entry, component], of the smallest ids; a task keeps no more rows than entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, list] = {}
        for batch in batches:
            last = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            for rows, found in floored(batch, 1, parts, scale):
                order = np.lexsort((ids[rows], last[rows]))
                bound = rows[order[min(entries, len(rows)) - 1]]
                # Rows that tie with the last that may count are compared by their vectors.
                some = np.flatnonzero((last[rows] < last[bound]) | (last[rows] == last[bound]) & (ids[rows] <= ids[bound]))
                held = least.setdefault(found.shape[1] * found.shape[2], [])
                held += [(bool(last[rows[k]]), int(ids[rows[k]]), found[k].ravel().tolist()) for k in some]
                held.sort()
                del held[entries:]
        out = [(n, *x) for n, held in least.items() for x in held]
        yield pa.record_batch([
            pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.int64()),
            pa.array([x[3] for x in out], pa.list_(pa.int64())),
        ], names=["length", "last", "id", "v"])

    found = map_batches(vectors, run, "length int, last boolean, id long, v array<long>")
    best = F.slice(F.array_sort(F.collect_list(F.struct("last", "id", "v"))), 1, entries)
    # Rows for each length: so many as a task keeps, from each task.
    ranked = found.groupBy("length", F.spark_partition_id() % 64).agg(best.alias("b")).groupBy("length").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("b"))), 1, entries).alias("b"),
    )
    return {
        r["length"]: np.array([x["v"] for x in r["b"]], np.int64).reshape(len(r["b"]), parts, -1).transpose(1, 0, 2).copy() for r in ranked.collect()
    }


def assigned(found: np.ndarray, index: list[SliceIndex]) -> tuple[np.ndarray, np.ndarray]:
    """[row, part] of the nearest entries' numbers and squared distances."""
    codes, errors = np.zeros(found.shape[:2], np.int64), np.zeros(found.shape[:2], np.int64)
    for p, one in enumerate(index):
        for at in range(0, len(found), ROWS):
            codes[at : at + ROWS, p], errors[at : at + ROWS, p] = one.nearest(found[at : at + ROWS, p])
    return codes, errors


def _indexes(books: dict[int, np.ndarray]) -> dict[int, list[SliceIndex]]:
    return {n: [SliceIndex(part) for part in book] for n, book in books.items()}


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> dict[int, np.ndarray]:
    """Codebooks of vectors (id, vector), by length of the vectors. In each round every task assigns its rows and sends one sum for each
    entry; the driver gets the sums of all, as many numbers as the codebooks have."""
    books = _first(vectors, parts, entries, scale)
    for _ in range(rounds if books else 0):
        shared = vectors.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _indexes(shared.value)
            sums = {n: np.zeros(book.shape, np.int64) for n, book in shared.value.items()}
            counts = {n: np.zeros(book.shape[:2], np.int64) for n, book in shared.value.items()}
            for batch in batches:
                for _, found in floored(batch, 1, parts, scale):
                    n = found.shape[1] * found.shape[2]
                    codes, _ = assigned(found, index[n])
                    for p in range(parts):
                        np.add.at(sums[n][p], codes[:, p], found[:, p])
                        counts[n][p] += np.bincount(codes[:, p], minlength=counts[n].shape[1])
            out = [(n, p, e, int(c), sums[n][p, e].tolist()) for n, count in counts.items() for (p, e), c in np.ndenumerate(count) if c]
            yield pa.record_batch([
                *(pa.array([x[i] for x in out], pa.int32()) for i in range(3)), pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.list_(pa.int64())),
            ], names=["length", "part", "entry", "n", "total"])

        found = map_batches(vectors, run, "length int, part int, entry int, n long, total array<long>")
        each = found.select("length", "part", "entry", "n", F.posexplode("total").alias("at", "total"))
        for r in each.groupBy("length", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["length"]][r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        shared.unpersist()
    return books


def book_digest(book: np.ndarray) -> str:
    """The digest of a codebook's components, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: dict[int, np.ndarray], parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vectors (id, vector, label) as id, label, code (two hex digits a part), error (squared distances, summed) and codebooks_sha256."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _indexes(shared.value)
        digests = {n: book_digest(book) for n, book in shared.value.items()}
        for batch in batches:
            for rows, found in floored(batch, 1, parts, scale):
                n = found.shape[1] * found.shape[2]
                codes, errors = assigned(found, index[n])
                at = pa.array(rows)
                yield pa.record_batch([
                    batch.column(0).take(at), batch.column(2).take(at), pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]),
                    pa.array(errors.sum(axis=1)), pa.array([digests[n]] * len(rows)),
                ], names=["id", "label", "code", "error", "codebooks_sha256"])

    kind = vectors.schema
    return map_batches(
        vectors, run, f"id {kind[0].dataType.simpleString()}, label {kind[2].dataType.simpleString()}, code string, error long, codebooks_sha256 string",
    )


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Codes of all vectors: id, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"), F.col(label_column).alias("label"))
    coded = materialize(encode(rows, fit(rows.select("id", "v"))), "codes")
    # One row for each label; a label's rows are counted down in their own tasks first.
    labels = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "named")
    return coded.join(small(labels), F.col("label").eqNullSafe(F.col("named"))).select(
        F.col("id").alias(id_column), "code", "error", "label_error", "codebooks_sha256",
    )
