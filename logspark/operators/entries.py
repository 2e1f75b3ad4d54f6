"""Entries: lines folded and parsed into one schema.

entries: source_idx, source_name, format_id, entry_no (from 0 within the source), first_line, physical_lines, time, level,
level_idx, raw_level, thread, target, host, pid, extra, message. A missing time is NULL, other missing values are ''.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.sources import lines as L
from logspark.sources.scratch import new_folder

from . import formats as X
from .detect import detect_format, learn, require_same_format, sample_head
from .ordered import carry, number

COLUMNS = [
    "source_idx", "source_name", "format_id", "entry_no", "first_line", "physical_lines", "time", "level", "level_idx", "raw_level", "thread",
    "target", "host", "pid", "extra", "message",
]


def reference_date(lines: DataFrame, given: date | None) -> Column:
    """The date for times that have none: the file name's, else the file's modification date, else the given one."""
    modified = F.to_date("modified") if "modified" in lines.columns else F.lit(None).cast("date")
    return F.coalesce(N.date_of_name(F.col("source_name")), F.lit(given).cast("date") if given else modified, modified)


def mark_starts(lines: DataFrame, spec: X.FormatSpec) -> DataFrame:
    """Adds start: whether the line starts an entry."""
    return lines.withColumn("start", spec.starts())


def assign_entries(lines: DataFrame, merge_continuations: bool = True) -> DataFrame:
    """Adds entry_start, the line that starts the line's entry; lines before the first start are left out."""
    filled = carry(
        lines, ["source_idx"], "block", ["line_no"], F.when(F.col("start"), F.col("line_no")), "entry_start",
    ).where("entry_start is not null")
    return filled if merge_continuations else filled.withColumn("entry_start", F.col("line_no"))


def fold_entries(lines: DataFrame) -> DataFrame:
    """One row for each entry: its first line's text, all lines in order, and the first line's number and block."""
    keep = [c for c in lines.columns if c not in (
        "source_idx", "source_name", "block", "line_no", "text", "start", "entry_start", "modified", "encoding",
    )]
    folded = lines.groupBy("source_idx", "source_name", "entry_start").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("_l"), F.min("block").alias("block"), *(F.first(c).alias(c) for c in keep),
    )
    return folded.withColumn("lines", F.transform("_l", lambda x: x["text"])).withColumn("text", F.col("lines")[0]).drop("_l")


def parse_entries(folded: DataFrame, spec: X.FormatSpec, merge_continuations: bool = True) -> DataFrame:
    """Folded lines as entries, without their numbers. What can't be parsed keeps its whole text as message, at level OTHER."""
    # As the only element of an array that is exploded, the match is computed once: neither the fields nor filters on them repeat it.
    folded = folded.select("*", F.explode(F.array(spec.match())).alias("m")) if spec.match else folded
    fields = spec.fields()
    parsed = F.coalesce(fields.pop("parsed", F.lit(True)), F.lit(False))
    raw = F.when(parsed, N.or_empty(fields.get("raw_level", F.lit("")))).otherwise("")
    text = lambda name: F.when(parsed, N.or_empty(fields.get(name, F.lit("")))).otherwise("")
    level = F.when(parsed, fields["level"] if "level" in fields else N.normalize_level(raw)).otherwise("OTHER")
    message = text("message") if not spec.block else F.when(parsed, fields["message"])
    more = F.array_join(F.slice(F.col("lines"), 2, 2_147_483_646), "\n")
    whole = F.array_join(F.col("lines"), "\n")
    joined = message if spec.block else F.when(F.size("lines") > 1, F.concat(message, F.lit("\n"), more)).otherwise(message)
    return folded.select(
        "source_idx", "source_name", F.lit(spec.id).alias("format_id"), "block", "entry_start", *(c for c in folded.columns if c == "entry_no"), F.size("lines").alias("physical_lines"),
        F.when(parsed, fields.get("time", F.lit(None))).cast("timestamp").alias("time"), level.alias("level"), raw.alias("raw_level"),
        *(text(c).alias(c) for c in ("thread", "target", "host", "pid")), F.when(
            parsed, fields.get("extra", X.no_extra()),
        ).otherwise(X.no_extra()).alias("extra"),
        F.when(parsed, joined).otherwise(whole).alias("message"), *(c for c in folded.columns if c in ("truncated", "raw")),
    ).withColumn("level_idx", N.level_index(F.col("level")))


def _finished(parsed: DataFrame, spec: X.FormatSpec) -> DataFrame:
    """Parsed entries with their numbers as the schema has them."""
    first = F.col("entry_no") + 1 if spec.sequential else F.col("entry_start")
    return parsed.withColumn("first_line", first.cast("long")).withColumn(
        "entry_no", F.col("entry_no").cast("long"),
    ).select(COLUMNS + [c for c in parsed.columns if c in ("truncated", "raw")])


def entries_of_lines(lines: DataFrame, format: str = "auto", merge_continuations: bool = True, reference: date | None = None) -> DataFrame:
    """The entries of a lines table whose sources all have one format, with truncated where the lines have it. Detection reads the first 200 lines of each source."""
    return open_lines(lines, format, merge_continuations, reference).entries


# Folded where they are read: files, and tables by block --------------------------------------------------------------------------------


def _folder(lists: int):
    """Folds marked lines that stand by file and block into pieces: an entry's lines in a block; piece 0 are the lines before the first
    start. Columns: source_idx, block, start, then so many texts that become lists."""
    names = ["source_idx", "block", "piece", "k", "n", *["lines", "raws"][:lists]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece, k, held = None, 0, 0, None

        def finished() -> pa.RecordBatch:
            texts = [pa.concat_arrays(x) for x in held[4]]
            n = len(texts[0])
            return pa.record_batch([
                pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int64()), pa.array([held[3]], pa.int64()),
                pa.array([n], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in texts),
            ], names=names)

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            source, block = (batch.column(c).to_numpy() for c in (0, 1))
            start = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            texts = [batch.column(3 + c) for c in range(lists)]
            other = np.r_[(source[0], block[0]) != key, (source[1:] != source[:-1]) | (block[1:] != block[:-1])]
            # Pieces and lines are counted from the block's beginning, which may be in an earlier batch.
            segment, starts, row = np.cumsum(other), np.cumsum(start), np.arange(size)
            firsts = np.flatnonzero(other)
            pieces = starts - np.r_[-piece, starts[firsts] - start[firsts]][segment]
            places = row - np.r_[-k, firsts][segment] + 1
            at = np.flatnonzero(other | start)
            upto = at[0] if len(at) else size
            if upto:
                for slices, text in zip(held[4], texts, strict=True):
                    slices.append(text.slice(0, upto))
            if len(at):
                if held:
                    yield finished()
                if len(at) > 1:
                    offsets, own = pa.array(at, pa.int32()), at[:-1]
                    yield pa.record_batch([
                        pa.array(source[own], pa.int32()), pa.array(block[own], pa.int64()), pa.array(pieces[own], pa.int64()), pa.array(places[own], pa.int64()),
                        pa.array(np.diff(at), pa.int32()), *(pa.ListArray.from_arrays(offsets, text) for text in texts),
                    ], names=names)
                last = at[-1]
                held = [int(source[last]), int(block[last]), int(pieces[last]), int(places[last]), [[text.slice(last)] for text in texts]]
            key, piece, k = (source[-1], block[-1]), int(pieces[-1]), int(places[-1])
        if held:
            yield finished()

    return run


def _folded_edges(folded: DataFrame) -> DataFrame:
    """For each block of folded pieces: its entries (starts), the lines and entries before it in its source, the last entry before it (owner:
    its block and number there, from 1) and whether the block begins with lines of that one."""
    per = folded.groupBy("source_idx", "block").agg(
        F.sum(F.col("n").cast("long")).alias("n"), F.count_if(F.col("piece") > 0).alias("starts"), F.max(F.col("piece") == 0).alias("late"),
    )
    before = Window.partitionBy("source_idx").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("starts") > 0, F.struct(F.col("block").alias("block"), F.col("starts").alias("piece"))), ignorenulls=True).over(before)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{name}_before") for c, name in (("n", "lines"), ("starts", "entries"))]
    return per.select("source_idx", "block", "starts", *sums, owner.alias("owner"), "late").withColumn("spills", F.col("owner").isNotNull() & F.col("late")).drop("late")


#: Most blocks whose edges are broadcast; more are shuffled.
BROADCAST_BLOCKS = 500_000


@dataclass(frozen=True)
class OpenLogs:
    """Opened files of one format. entries is lazy; what it rests on is written: the files' heads, their lines folded block by block
    (folded), and where each block's entries begin in its file (edges)."""

    entries: DataFrame
    heads: DataFrame
    spec: X.FormatSpec
    folded: DataFrame | None = None
    edges: DataFrame | None = None
    finish: Callable[[DataFrame], DataFrame] | None = None

    def first(self, n: int) -> DataFrame:
        """The first n entries of each source: only the blocks that hold them, and there the pages with the first n pieces, are read."""
        if self.folded is None:
            return self.entries.where(F.col("entry_no") < n)
        needed = self.edges.where(F.col("entries_before") < n)
        upto = needed.agg(F.max("block")).first()[0] or 0
        # What spills into later blocks belongs to entries that are asked for, so one more block with a start is looked at.
        after = self.edges.where(F.col("block") > upto).groupBy("source_idx").agg(F.min(F.when(F.col("starts") > 0, F.col("block"))).alias("b")).agg(F.max("b")).first()[0]
        some = self.folded.where((F.col("block") <= max(upto, after or upto)) & (F.col("piece") <= n))
        return self.finish(some).where(F.col("entry_no") < n)


def _joined(folded: DataFrame, edges: DataFrame, lists: list[str]) -> DataFrame:
    """Folded pieces as entries: with the lines that begin later blocks, entry_start and entry_no."""
    few = edges.count() <= BROADCAST_BLOCKS
    near = F.broadcast if few else (lambda x: x)
    placed = folded.join(near(edges.select("source_idx", "block", "starts", "lines_before", "entries_before")), ["source_idx", "block"])
    own = placed.where("piece > 0")
    if not edges.where("spills").isEmpty():
        # Only a block's last entry can go on in the next one, so no other rows are shuffled.
        owners = near(edges.where("spills").select("source_idx", "block", F.col("owner.block").alias("own_block"), F.col("owner.piece").alias("own_piece")))
        late = folded.where("piece = 0").join(owners, ["source_idx", "block"]).groupBy("source_idx", F.col("own_block").alias("block"), F.col("own_piece").alias("piece")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), *lists))).alias("late"),
        )
        last = own.where("piece = starts").join(late, ["source_idx", "block", "piece"], "left")
        # Text goes to where its entry is: folded.block is one name on both sides.
        more = {x: F.when(F.col("late").isNull(), F.col(x)).otherwise(F.concat(F.col(x), F.flatten(F.transform("late", lambda e: e[x])))) for x in lists}
        own = own.where("piece < starts").unionByName(last.withColumns(more).select(own.columns))
    return own.select(
        "source_idx", "block", (F.col("k") + F.col("lines_before")).alias("entry_start"), (F.col("entries_before") + F.col("piece") - 1).cast("long").alias("entry_no"),
        *lists, F.col("lines")[0].alias("text"),
    )


def _fold(spark: SparkSession, marked: DataFrame, lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """Marked lines (source_idx, block, start, then lists), which stand by block and in order, folded into pieces, and the edges of blocks; both are written."""
    L.bound_batches(spark)
    folder = new_folder(spark, "folded")
    schema = "source_idx int, block long, piece long, k long, n int, " + ", ".join(f"{x} array<string>" for x in lists)
    marked.mapInArrow(_folder(len(lists)), schema).write.parquet(folder)
    folded = spark.read.schema(schema).parquet(folder)
    _folded_edges(folded).write.parquet(f"{folder}-edges")
    return folded, spark.read.parquet(f"{folder}-edges")


def open_lines(lines: DataFrame, format: str = "auto", merge_continuations: bool = True, reference: date | None = None) -> OpenLogs:
    """A lines table whose sources all have one format, opened: its lines are dealt once, now, by block, folded there into pieces and written;
    fields are parsed when entries are asked for. Sources, with what their heads tell, are one row each."""
    spark = lines.sparkSession
    heads = sample_head(lines).groupBy("source_idx", "source_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]).alias("sample"),
    )
    folder = new_folder(spark, "heads")
    heads.write.parquet(folder)
    heads = spark.read.schema("source_idx int, source_name string, sample array<string>").parquet(folder)
    spec = X.find_format(format if format not in ("", "auto") else require_same_format(detect_format(heads)))
    if spec.id == "wevt_xml":
        raise ValueError("event XML is read by records: use sources.event_xml")
    learned = learn(heads, spec.id)
    if not merge_continuations:
        known = lines.join(learned, "source_idx", "left") if learned is not None else lines
        known = mark_starts(known.withColumn("reference", reference_date(lines, reference)), spec)
        parsed = parse_entries(fold_entries(assign_entries(known, False)), spec, False)
        return OpenLogs(_finished(number(parsed, ["source_idx"], "block", ["entry_start"], "entry_no", first=0), spec), heads, spec)
    about = [F.first(c).alias(c) for c in ("truncated", "modified") if c in lines.columns]
    sources = lines.groupBy("source_idx").agg(
        F.first("source_name").alias("source_name"), *about, F.count(F.lit(1)).alias("_rows"), F.sum(F.octet_length("text")).alias("_bytes"),
    )
    sources.withColumn("reference", reference_date(sources, reference)).drop("modified").write.parquet(f"{folder}-sources")
    sources = spark.read.parquet(f"{folder}-sources")
    total = sources.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.coalesce(F.sum("_rows"), F.lit(0)), F.count(F.lit(1))).first()
    near = F.broadcast if total[2] <= L.BROADCAST_FILES else (lambda x: x)
    known = lines.join(near(learned), "source_idx", "left") if learned is not None else lines
    marked = known.select("source_idx", F.col("block").cast("long").alias("block"), spec.starts().alias("start"), "text", "line_no")
    marked = marked.repartition(L.sort_tasks(total[0], total[1]), "source_idx", "block").sortWithinPartitions("source_idx", "block", "line_no")
    folded, edges = _fold(spark, marked.drop("line_no"), ["lines"])
    sources = sources.drop("_rows", "_bytes")
    sources = sources.join(learned, "source_idx", "left") if learned is not None else sources

    def finish(some: DataFrame) -> DataFrame:
        return _finished(parse_entries(_joined(some, edges, ["lines"]).join(near(sources), "source_idx"), spec), spec)

    return OpenLogs(finish(folded), heads, spec, folded, edges, finish)


def open_logs(
    spark: SparkSession, paths: list[str] | str, format: str = "auto", max_lines: int = 0, merge_continuations: bool = True,
    reference: date | None = None, encoding: str | None = None, styles: bool = False,
) -> OpenLogs:
    """Log files of one format, opened: see read_logs. The files' text is read once, now: each task folds its lines where it reads them and
    writes the pieces, and all numbers rest on what is written, however Spark splits files later and whatever is appended to them."""
    L.legacy_charsets(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    heads = L.read_heads(spark, paths, encoding)
    if format in ("", "auto"):
        format = require_same_format(detect_format(heads))
    spec = X.find_format(format)
    if spec.id == "wevt_xml":
        from logspark.sources.event_xml import read_event_xml

        return OpenLogs(read_event_xml(spark, heads, max_lines=max_lines), heads, spec)
    if max_lines or not merge_continuations:
        if styles:
            raise ValueError("styles are kept where all lines are read and continuations merged")
        lines = L.scan_lines(spark, heads, max_lines)
        return OpenLogs(entries_of_lines(lines if max_lines else lines.drop("truncated"), format, merge_continuations, reference), heads, spec)
    learned = {name: c.alias(name) for name, c in (spec.learn() if spec.learn else {}).items()}
    lists = ["lines", "raws"] if styles else ["lines"]
    known = heads.select("source_idx", "source_name", "file", "uri", "bytes", "encoding", reference_date(heads, reference).alias("reference"), *learned.values())
    lines, by_block = L.placed_lines(spark, known, about=list(learned), raw=styles)
    marked = lines.select("source_idx", "block", spec.starts().alias("start"), "text", *(["raw"] if styles else []), "place")
    if not by_block:
        marked = marked.repartition("source_idx", "block").sortWithinPartitions("source_idx", "block", "place")
    folded, edges = _fold(spark, marked.drop("place"), lists)
    sources = known.drop("file", "uri", "bytes", "encoding")

    def finish(some: DataFrame) -> DataFrame:
        named = F.broadcast(sources) if by_block else sources
        joined = _joined(some, edges, lists).join(named, "source_idx")
        if styles:
            whole = F.array_join(F.transform(F.arrays_zip("lines", "raws"), lambda x: F.coalesce(x["raws"], x["lines"])), "\n")
            joined = joined.withColumn("raw", F.when(F.exists("raws", lambda x: x.isNotNull()), whole)).drop("raws")
        return _finished(parse_entries(joined, spec), spec)

    return OpenLogs(finish(folded), heads, spec, folded, edges, finish)


def read_logs(
    spark: SparkSession, paths: list[str] | str, format: str = "auto", max_lines: int = 0, merge_continuations: bool = True,
    reference: date | None = None, encoding: str | None = None, styles: bool = False,
) -> DataFrame:
    """Entries of log files of one format: lines scanned, decoded, stripped of escapes, folded and parsed.

    The files are read now (open_logs); fields are parsed when entries are asked for. A file that grows meanwhile has the lines that it had.
    max_lines: the most lines read of each file, 0: all; if given, entries also have truncated (their file has max_lines or more).
    styles: entries also have raw, all their lines with their escapes where there are any, for fragments.entry_spans.
    """
    return open_logs(spark, paths, format, max_lines, merge_continuations, reference, encoding, styles).entries
