"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.sources.scratch import new_folder

#: Words of all word-based operators: runs of letters, digits and underscores, lower-cased.
WORD = re.compile(r"\w+")
#: Distinct words whose hashes a Python worker keeps.
WORD_CACHE = 120_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what materialize wrote, once all that was made of it is written too."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def crc32_text(column: Column) -> Column:
    """crc32 of the value written as text, as contracts use it to split rows."""
    return F.crc32(column.cast("string").cast("binary"))


def with_rank(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int, per_bucket: int = 1_000_000, least: int = 16) -> DataFrame:
    """Adds a gapless rank from 0 within keys, without ever sorting a whole key in one task.

    A key's rows are dealt to hash buckets of order; a bucket's rows are numbered by order,
    after all rows of the buckets before it. order must tell rows apart, or rows that are equal in it are one bucket.
    """
    n = max(least, -(-rows // per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0)),
    ).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(offsets, [*keys, "_bucket"]).withColumn(
        out, (F.col("_within") + F.col("_before")).cast("long"),
    ).drop("_bucket", "_within", "_before")


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class _WordHashes(dict):
    """Hashes as eight bytes, which join to an array faster than numbers do."""

    def __missing__(self, word: str) -> bytes:
        value = word_hash(word).to_bytes(8, "little")
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value
        return value


_hashes = _WordHashes()


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(tokens: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_hashes.__getitem__, tokens)), "<u8")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values; none if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return mixed(out)


def ngram_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of a shorter text, of all its words; empty without words."""
    h = word_hashes(words(text))
    return np.unique(window_hashes(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def chunks(batches: Iterator[pa.RecordBatch], chars: int = 500_000) -> Iterator[tuple[pa.Array, list]]:
    """(first column, second column as texts) of Arrow batches, in pieces of about so many characters."""
    for batch in batches:
        first, texts, held, at = batch.column(0), [], 0, 0
        for k, t in enumerate(batch.column(1)):
            texts.append(t.as_py())
            held += len(texts[-1] or "")
            if held >= chars:
                yield first.slice(at, len(texts)), texts
                texts, held, at = [], 0, k + 1
        if texts:
            yield first.slice(at, len(texts)), texts


def hash_share(column: str, share: float) -> Column:
    """True for about this share of the column's values, the same ones each time."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


#: What each operator's module keeps in a worker, and how to let go of it.
releases: dict[str, Callable[[], None]] = {}
#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_owner = ""


def claim(owner: str) -> None:
    """Lets go of what other operators keep in this worker, which Spark uses again for stage after stage."""
    global _owner
    if owner != _owner:
        for name, release in releases.items():
            if name != owner:
                release()
        _hashes.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _owner = owner


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's limits of an Arrow batch, which are read when a job runs, so they stay as they are here."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), in batches small enough for long texts (see bound_batches)."""
    bound_batches(df.sparkSession)
    owner = run.__module__

    def claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        yield from run(batches)

    return df.mapInArrow(claimed, schema)


def keep_rows(docs: DataFrame, keep: Callable[[list], list[bool]], owner: str, text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose texts keep lets through; no shuffle."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [x for _, texts in chunks([pa.record_batch([batch.column(at), batch.column(at)], names=["a", "b"])]) for x in keep(texts)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    run.__module__ = owner
    return map_batches(docs, run, docs.schema)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a key that no two rows share, and the key's column."""
    key = "row_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


#: Most rows of one number each that are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def small(ids: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """ids (written, one number a row), to be broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= broadcast_rows else ids


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs without the rows whose column is among ids."""
    ids = materialize(ids.select(column).distinct(), "dropped")
    return docs.join(small(ids), column, "left_anti").select(docs.columns)
