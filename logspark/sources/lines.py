"""Physical lines: from files, or from a table that holds text.

A lines table has source_idx, source_name, block (a split of the source, rising), line_no (from 1) and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.functions.ansi import strip_control
from logspark.operators.ordered import number

from .scratch import new_folder

#: Bytes of a file that its encoding is guessed from, and lines that its format is.
HEAD_BYTES, HEAD_LINES = 4096, 200
#: Files of more bytes are looked at by a range of so many bytes.
RANGED, RANGE = 4 << 20, 256 << 10
#: Legacy encodings in the order in which they are tried.
LEGACY = ["GB18030", "Big5", "Shift_JIS", "windows-1252"]
#: Encodings whose line ends are two bytes, so that files are cut at other bytes.
WIDE = ["UTF-16LE", "UTF-16BE"]
#: Most files whose names and encodings are broadcast to the lines; with more they are joined by a shuffle.
BROADCAST_FILES = 100_000
#: Most segments of a table whose numbers are broadcast to its lines.
BROADCAST_SEGMENTS = 500_000
#: Bytes that a task reads at least; opening a file counts as so many.
TASK_BYTES, OPEN_BYTES = 32 << 20, 4 << 20
#: With splits of this many bytes and as many for opening a file, every file is one partition.
_WHOLE = str(1 << 46)


def source_map(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_idx, source_name, file, uri (file as rows of it name it), bytes and modified of each file that paths name, in the order of
    paths, then by name."""
    every = spark.read.format("binaryFile").load(paths).select(
        "path", F.col("_metadata.file_path").alias("uri"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )
    if len(paths) == 1:
        files = every.distinct().withColumn("given", F.lit(0))
    else:
        # A path names a file, or a folder above files; what a pattern names is asked for pattern by pattern.
        plain = [(k, _qualified(spark, p)) for k, p in enumerate(paths) if not _GLOB.search(p)]
        steps = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
        named = every.select("path", F.explode(above).alias("named")).join(spark.createDataFrame(plain, "given int, named string"), "named").select("path", "given")
        for k, p in enumerate(paths):
            if _GLOB.search(p):
                named = named.unionByName(spark.read.format("binaryFile").load(p).select("path", F.lit(k).alias("given")))
        files = every.distinct().join(named.groupBy("path").agg(F.min("given").alias("given")), "path")
    # One row for each file.
    place = (F.row_number().over(Window.orderBy("given", "path")) - 1).cast("int")
    return files.select(
        place.alias("source_idx"), F.element_at(F.split("path", "/"), -1).alias("source_name"), F.col("path").alias("file"), "uri", "bytes", "modified",
    )


def _as_it_is(path: str) -> str:
    """A file's path so that signs of patterns in its name are no pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


_GLOB = re.compile(r"[*?{\[]")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as the file system names it."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return found.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def head_of(data: bytes, whole: bool) -> tuple[str, list[str]]:
    """The encoding of a file that begins with data, and its first lines; whole: data is all of the file. A line that is cut off
    counts only if there is no other."""
    encoding = encoding_of(data[:HEAD_BYTES])
    if encoding in WIDE:
        texts = data[: len(data) // 2 * 2].decode(encoding, "replace").replace("\r\n", "\n").split("\n")
    else:
        texts = [decode_line(x, encoding) for x in re.split(rb"\r\n|\r|\n", data)]
    if len(texts) > 1 and (not whole or not texts[-1]):
        texts.pop()
    return encoding, [x.removeprefix("\ufeff") for x in texts[:HEAD_LINES]]


HEADS = "uri string, encoding string, sample array<string>"


def _head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first lines of a partition that is one file, and its encoding; the rest of the file is not read."""
    file, raw, size = None, [], 0
    for batch in batches:
        for name, value in zip(batch.column(0), batch.column(1), strict=True):
            if len(raw) < HEAD_LINES or size < HEAD_BYTES:
                file, data = name.as_py(), value.as_py()
                raw.append(data)
                size += len(data) + 1
        if len(raw) >= HEAD_LINES and size >= HEAD_BYTES:
            break
    if raw:
        encoding = encoding_of(b"\n".join(raw)[:HEAD_BYTES])
        texts = [decode_line(x, encoding) for x in raw] if encoding not in WIDE else b"\n".join(raw).decode(encoding, "replace").replace("\n\n", "\n").split("\n")
        sample = [x.removeprefix("\ufeff") for x in texts[:HEAD_LINES]]
        yield pa.record_batch(
            [pa.array([file]), pa.array([encoding]), pa.array([sample], pa.list_(pa.string()))], names=["uri", "encoding", "sample"],
        )


def _read_first_lines(spark: SparkSession, paths: list[str], folder: str, most: int | None = None) -> None:
    """Heads of files by their first lines, one partition a file; files of more than most bytes are left out before they are opened."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.set(k, _WHOLE)
        raw = spark.read.text(paths)
        raw = raw.where(F.col("_metadata.file_size") <= most) if most else raw
        raw = raw.select(F.col("_metadata.file_path").alias("uri"), F.col("value").cast("binary").alias("raw"))
        raw.mapInArrow(_head, HEADS).write.mode("append").parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def first_bytes(uri: str, most: int) -> bytes | None:
    """The first bytes of a file in a file system that Arrow opens; None of another."""
    scheme, _, rest = uri.partition(":")
    authority, _, path = rest.removeprefix("//").partition("/") if rest.startswith("//") else ("", "", rest.removeprefix("/"))
    try:
        if scheme == "file":
            system, base = fs.LocalFileSystem(), ""
        else:
            system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
        with system.open_input_file(f"{base.rstrip('/')}/{path}") as f:
            return f.read(most)
    except (OSError, ValueError, ImportError, NotImplementedError):
        return None


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads of files by a range of bytes."""
    for batch in batches:
        for file, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if data := first_bytes(file, RANGE):
                encoding, sample = head_of(data, len(data) < RANGE)
                yield pa.record_batch([pa.array([uri]), pa.array([encoding]), pa.array([sample], pa.list_(pa.string()))], names=["uri", "encoding", "sample"])


def read_heads(spark: SparkSession, paths: list[str], encoding: str | None = None) -> DataFrame:
    """The files of paths: source_idx, source_name, file, uri, bytes, modified, encoding (the given one, or that of the first bytes)
    and sample (the first lines; empty for an empty file). Reads the beginning of each file now, and writes what it found.

    Of a file of more than RANGED bytes a range of 256 kB is read in file systems that Arrow opens, so one line of gigabytes does no harm;
    smaller files, and those in other file systems, are read up to the end of their first lines."""
    folder = new_folder(spark, "heads")
    source_map(spark, paths).write.parquet(f"{folder}-files")
    files = spark.read.parquet(f"{folder}-files")
    large = files.where(F.col("bytes") > RANGED).select("file", "uri")
    _read_first_lines(spark, paths, folder, RANGED)
    if not large.isEmpty():
        large.repartition(F.col("uri")).mapInArrow(_ranged, HEADS).write.mode("append").parquet(folder)
        if missed := [_as_it_is(r["file"]) for r in large.join(spark.read.schema(HEADS).parquet(folder), "uri", "left_anti").collect()]:
            _read_first_lines(spark, missed, folder)
    found = spark.read.schema(HEADS).parquet(folder)
    # A file that several paths name was looked at more than once.
    known = files.join(found.dropDuplicates(["uri"]), "uri", "left")
    own = F.lit(encoding) if encoding else F.coalesce("encoding", F.lit("UTF-8"))
    sample = F.transform(F.coalesce("sample", F.array().cast("array<string>")), strip_control)
    known.select(
        "source_idx", "source_name", "file", "uri", "bytes", "modified", own.alias("encoding"), sample.alias("sample"),
    ).write.parquet(f"{folder}-named")
    return spark.read.parquet(f"{folder}-named")


def placed_lines(spark: SparkSession, heads: DataFrame, separator: str | None = None, about: list[str] = (), raw: bool = False) -> tuple[DataFrame, bool]:
    """The lines of files (read_heads): source_idx, block, place (rising in a block), text and the columns of heads that about names; with
    raw, also the text with its escapes, where it has any. And whether a task's rows stand by file and block, in order: with
    very many files they are shuffled instead. Small splits share tasks, each split staying a block of its own: a session's small
    maxPartitionBytes makes many blocks, but tasks and written files only as the bytes are many.

    LF, CRLF and CR all end a line, LF and CRLF in UTF-16; a last line without an end counts. separator: records that end with it, not lines.
    """
    files = heads.select("source_idx", "file", "uri", "encoding", *about)
    least = 2 * spark.sparkContext.defaultParallelism
    of = {r["wide"]: r for r in heads.groupBy(F.when(F.col("encoding").isin(WIDE), F.col("encoding")).alias("wide")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_list("file").alias("files"), F.sum("bytes").alias("bytes"),
    ).collect()}
    out, few = None, sum(r["n"] for r in of.values()) <= BROADCAST_FILES
    for wide, r in of.items():
        reader = spark.read.option("encoding", wide) if wide else spark.read
        end = separator or ("\n" if wide else None)
        reader = reader.option("lineSep", end) if end else reader
        read = reader.text([_as_it_is(f) for f in r["files"]]).select(
            F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"),
        ).coalesce(max(least, (r["bytes"] + r["n"] * OPEN_BYTES) // TASK_BYTES))
        named = read.join(F.broadcast(files.drop("file")) if few else files.drop("file"), "uri")
        text = F.decode(F.col("raw").cast("binary"), wide) if wide else decoded(F.col("raw"), F.col("encoding"))
        text = F.regexp_replace(text, "\r$", "") if wide and not separator else text
        # A mark of the byte order may begin a file.
        text = F.when((F.col("block") == 0) & text.startswith("\ufeff"), F.substring(text, 2, 2_147_483_646)).otherwise(text)
        escaped = [F.when(text.contains("\x1b"), text).alias("raw")] if raw else []
        some = named.select("source_idx", "block", "place", strip_control(text).alias("text"), *escaped, *about)
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = heads.limit(0).select("source_idx", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("place"), F.lit("").alias("text"), *([F.lit("").alias("raw")] if raw else []), *about)
    return out, few


def _first_of_blocks(most: int):
    """The first lines of each block, for lines that stand by file and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, 0
        for batch in batches:
            source, block = (batch.column(k).to_numpy() for k in (0, 1))
            begins = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (block[1:] != block[:-1])]) if len(source) else []
            for at, end in zip(begins, [*begins[1:], len(source)], strict=True):
                seen = seen if key == (source[at], block[at]) else 0
                key = (source[at], block[at])
                take = min(end - at, max(0, most - seen))
                seen += end - at
                if take:
                    yield batch.slice(at, take)

    return run


def scan_lines(spark: SparkSession, paths: list[str] | DataFrame, max_lines: int = 0, encoding: str | None = None) -> DataFrame:
    """Lines of files (paths, or what read_heads found), numbered within each.

    Files are read once, now, and their lines written; numbers rest on what was written, however Spark splits files later. max_lines: the most lines of each
    file, 0: all; of each block so many are kept at most. encoding: decodes what is not valid UTF-8; None finds it for each file from its
    first bytes. Columns besides those of a lines table: truncated (the file has max_lines or more), modified (of the file).
    """
    heads = paths if isinstance(paths, DataFrame) else read_heads(spark, [paths] if isinstance(paths, str) else paths, encoding)
    placed, by_block = placed_lines(spark, heads)
    if max_lines and by_block:
        bound_batches(spark)
        placed = placed.mapInArrow(_first_of_blocks(max_lines), placed.schema)
    folder = new_folder(spark, "lines")
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    numbered = number(placed, ["source_idx"], "block", ["place"], "line_no")
    about = heads.select("source_idx", "source_name", "modified", "encoding")
    if max_lines:
        about = about.join(placed.groupBy("source_idx").agg(F.count(F.lit(1)).alias("lines")), "source_idx", "left")
        numbered = numbered.where(F.col("line_no") <= max_lines)
    truncated = F.col("lines") >= max_lines if max_lines else F.lit(False)
    return numbered.join(about, "source_idx").select(
        "source_idx", "source_name", "block", "line_no", "text", truncated.alias("truncated"), "modified", "encoding",
    )


def document_sizes(heads: DataFrame, max_lines: int = 0, lines: DataFrame | None = None) -> DataFrame:
    """What table.document_info shows of files (read_heads): source_idx, bytes, encoding, truncated (by max_lines, of scanned lines)."""
    cut = lines.groupBy("source_idx").agg(F.max("truncated").alias("truncated")) if max_lines and lines is not None else None
    out = heads.select("source_idx", "bytes", "encoding")
    return out.join(cut, "source_idx", "left").withColumn(
        "truncated", F.coalesce("truncated", F.lit(False)),
    ) if cut is not None else out.withColumn("truncated", F.lit(False))


def decode_line(raw: bytes, encoding: str) -> str:
    """As decoded does, for lines of a head."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode(encoding if encoding in LEGACY else "utf-8", "replace")


def encoding_of(data: bytes) -> str:
    """The encoding of a file that begins with data."""
    if data.startswith(b"\xef\xbb\xbf"):
        return "UTF-8"
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16LE" if data[0] == 0xFF else "UTF-16BE"
    if data.count(0) * 5 > len(data):
        # In text the zeros are the high bytes.
        return "UTF-16LE" if data[1::2].count(0) >= data[::2].count(0) else "UTF-16BE"
    for name in ["UTF-8", *LEGACY]:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError as e:
            # The head may end inside a character.
            if e.start >= len(data) - 4 and len(data) == HEAD_BYTES:
                return name
    return LEGACY[-1]


def decoded(raw: Column, encoding: Column) -> Column:
    """The line as text: as UTF-8 if it is that, else by the legacy encoding. Spark decodes charsets of Java's list, and gives
    U+FFFD for what can't be decoded, under the settings that ``legacy_charsets`` makes."""
    binary, out = raw.cast("binary"), None
    for name in LEGACY:
        out = F.when(encoding == name, F.decode(binary, name)) if out is None else out.when(encoding == name, F.decode(binary, name))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(out.otherwise(F.make_valid_utf8(raw)))


def legacy_charsets(spark: SparkSession) -> None:
    """Session settings that decoding, and logfmt's duplicate keys, need."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


def bound_batches(spark: SparkSession) -> None:
    """Session settings that bound an Arrow batch of lines, which may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: Bytes of text and rows that a task puts in order at most, on average: tasks grow in number with a table, not in size.
SORT_BYTES, SORT_ROWS = 32 << 20, 200_000


def sort_tasks(size: int | None, rows: int) -> int:
    """Tasks for so many bytes of text in so many rows."""
    return max(1, -(-(size or 0) // SORT_BYTES), -(-rows // SORT_ROWS))


def lines_from_df(
    df: DataFrame, order: Column, text: Column, source_idx: Column | None = None, source_name: Column | None = None, segment: Column | None = None,
) -> DataFrame:
    """Lines of a table's texts, each cut at its line ends, in the order of a number that no two rows of a source share.

    segment rises with order; by default a segment is 10,000 consecutive numbers. The lines are written once, now, and their numbers rest on what
    is written: texts are dealt by segment and put in order before they are cut.
    """
    spark, block = df.sparkSession, F.floor(order.cast("long") / 10_000) if segment is None else segment
    own = df.select(
        (F.lit(0) if source_idx is None else source_idx).cast("int").alias("source_idx"),
        (F.lit("table.log") if source_name is None else source_name).alias("source_name"), order.cast("long").alias("_order"), block.cast("long").alias("block"),
        text.alias("text"),
    )
    total = own.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    inside = Window.partitionBy("source_idx", "block").orderBy("_order")
    parts = F.split("text", r"\r\n|\r|\n")
    placed = own.repartition(sort_tasks(*total), "source_idx", "block").withColumn(
        "_before", F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.size(parts))).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("source_idx", "source_name", "block", "_before", F.posexplode(parts).alias("_part", "text"))
    folder, schema = new_folder(spark, "lines"), "source_idx int, source_name string, block long, place long, text string"
    placed.select(
        "source_idx", "source_name", "block", (F.col("_before") + F.col("_part") + 1).alias("place"), strip_control(F.col("text")).alias("text"),
    ).write.parquet(folder)
    written = spark.read.schema(schema).parquet(folder)
    # One row for each segment, of how many lines are before it.
    before = written.groupBy("source_idx", "block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(
        F.sum("_n").over(Window.partitionBy("source_idx").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0),
    ))
    before.drop("_n").write.parquet(f"{folder}-before")
    before = spark.read.schema("source_idx int, block long, _before long").parquet(f"{folder}-before")
    before = F.broadcast(before) if before.count() <= BROADCAST_SEGMENTS else before
    return written.join(before, ["source_idx", "block"]).select(
        "source_idx", "source_name", "block", (F.col("place") + F.col("_before")).alias("line_no"), "text",
    )
