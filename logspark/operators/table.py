"""The table of entries: columns, filters, finding, counts, merging and export."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.functions.match import Pattern, finds, match_ranges, matches
from logspark.sources.scratch import new_folder

from .entries import OpenLogs
from .ordered import number

#: Share of entries in which a field must be filled to be a column, and the entries that are looked at.
FILLED, SAMPLE = 0.5, 200
FIXED = ["thread", "pid", "host", "target"]
#: Ids in one segment of prefix computations over entries.
SEGMENT = 100_000
#: Most segments whose runs are broadcast; more are joined by a shuffle.
BROADCAST_SEGMENTS = 500_000


# Columns -------------------------------------------------------------------------------------------------------------


def _fill_counts(rows: DataFrame) -> DataFrame:
    """column and filled, and the row of all entries, whose column is ''; low and high: the first and last source."""
    standard = {
        "time": F.col("time").isNotNull(), "level": (F.col("level") != "OTHER") | (F.col("raw_level") != ""), **{c: F.col(c) != "" for c in FIXED},
    }
    marks = F.concat(
        F.filter(F.array(*(F.when(test, F.lit(c)) for c, test in standard.items())), lambda x: x.isNotNull()),
        F.transform(F.map_keys(F.map_filter("extra", lambda _, v: v != "")), lambda k: F.concat(F.lit("extra:"), k)),
    )
    return rows.select("source_idx", F.explode(F.concat(F.array(F.lit("")), marks)).alias("column")).groupBy("column").agg(
        F.count(F.lit(1)).alias("filled"), F.min("source_idx").alias("low"), F.max("source_idx").alias("high"),
    )


def column_fill(entries: DataFrame, sample: int | None = None) -> DataFrame:
    """column, filled, total: in how many entries each standard column and extra key is not empty; of the first entries only, with a sample."""
    counted = _fill_counts(entries.where(F.col("entry_no") < sample) if sample else entries).select("column", "filled")
    total = F.max(F.when(F.col("column") == "", F.col("filled"))).over(Window.partitionBy())
    return counted.withColumn("total", total).where(F.col("column") != "")


def infer_columns(entries: DataFrame | OpenLogs, sample: int | None = SAMPLE) -> list[str]:
    """The columns worth showing, in order: line, file (if several sources), time, level, thread, pid, host, target, extras by key, message.
    Of opened files (entries.open_logs) only what holds the first entries is read."""
    first = entries.first(sample) if sample and not isinstance(entries, DataFrame) else entries if isinstance(entries, DataFrame) else entries.entries
    found = {r["column"]: r for r in _fill_counts(first.where(F.col("entry_no") < sample) if sample else first).collect()}
    if "" not in found:
        return ["line", "time", "level", "message"]
    every = found.pop("")
    share = {c: r["filled"] / every["filled"] for c, r in found.items()}
    extras = sorted(c for c, x in share.items() if c.startswith("extra:") and x >= FILLED)
    return [
        "line", *["file"] * (every["low"] != every["high"]), *(c for c in ("time", "level") if c in share), *(c for c in FIXED if share.get(c, 0) >= FILLED),
        *extras, "message",
    ]


def hide_columns(columns: list[str], hidden: set[str] | list[str]) -> list[str]:
    """columns without the hidden ones; the line number can't be hidden."""
    return [c for c in columns if c == "line" or c not in hidden]


def wide_table(entries: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of columns, and source_idx and entry_no to find the entries by."""
    return entries.select("source_idx", "entry_no", *(N.cell_text(c).alias(c) for c in columns))


# Filters -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FilterSpec:
    """What to keep: levels (none: all), a closed time range, entries without a time (only asked while a range is set) and a
    pattern that some searched column must match, or none, inverted. A blank pattern filters nothing. columns: those that are searched; None:
    all that the table shows (infer_columns); on a stream, all but extras."""

    levels: frozenset[str] = frozenset()
    start: datetime | None = None
    end: datetime | None = None
    include_untimed: bool = False
    pattern: Pattern | None = None
    invert: bool = False
    columns: tuple[str, ...] | None = None


def searched(entries: DataFrame, columns: list[str] | tuple[str, ...] | None) -> list[str]:
    """The columns that a pattern is sought in."""
    if columns is not None:
        return list(columns)
    return ["time", "level", *FIXED, "message"] if entries.isStreaming else infer_columns(entries)


def time_preset(name: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """all, today or ``<n>m``: a range that ends now."""
    if name == "all":
        return None, None
    if name == "today":
        return datetime.combine(date(now.year, now.month, now.day), datetime.min.time()), now
    return now - timedelta(minutes=int(name.rstrip("m"))), now


def compile_filter(spec: FilterSpec, spark=None) -> Column:
    """One predicate, cheapest tests first. With a session, a bad pattern fails here and not in the job. Here the columns must be named if
    there is a pattern."""
    tests = []
    if spec.levels and set(spec.levels) < set(N.LEVELS):
        tests.append(F.col("level_idx").isin([N.LEVELS.index(x) for x in sorted(spec.levels)]))
    if spec.start or spec.end:
        inside = F.lit(True)
        if spec.start:
            inside = inside & (F.col("time") >= F.lit(spec.start))
        if spec.end:
            inside = inside & (F.col("time") <= F.lit(spec.end))
        tests.append(F.when(F.col("time").isNull(), F.lit(spec.include_untimed)).otherwise(inside))
    if spec.pattern and not spec.pattern.blank:
        if spark is not None:
            spec.pattern.check(spark)
        if spec.columns is None:
            raise ValueError("which columns are searched depends on the entries: use apply_filter, or name them")
        hit = N.fold([matches(N.cell_text(c), spec.pattern) for c in spec.columns])
        tests.append(~hit if spec.invert else hit)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _test(entries: DataFrame, spec: FilterSpec) -> Column:
    if spec.pattern and not spec.pattern.blank:
        spec = replace(spec, columns=tuple(searched(entries, spec.columns)))
    return compile_filter(spec, entries.sparkSession)


def apply_filter(entries: DataFrame, spec: FilterSpec) -> DataFrame:
    return entries.where(_test(entries, spec))


def shown_of_total(entries: DataFrame, spec: FilterSpec) -> DataFrame:
    """shown and total, in one pass."""
    return entries.agg(F.count_if(_test(entries, spec)).alias("shown"), F.count(F.lit(1)).alias("total"))


def visible_rows(entries: DataFrame, spec: FilterSpec) -> DataFrame:
    """The filtered entries with visible_no, their place from 0 in source and entry order."""
    return _ordinal(apply_filter(entries, spec), "visible_no", 0)


def _ordinal(rows: DataFrame, out: str, first: int) -> DataFrame:
    dealt = rows.withColumn("_segment", F.struct("source_idx", F.floor(F.col("entry_no") / SEGMENT).alias("at"))).withColumn("_all", F.lit(0))
    return number(dealt, ["_all"], "_segment", ["entry_no"], out, first).drop("_segment", "_all")


# Find ----------------------------------------------------------------------------------------------------------------


def find_rows(entries: DataFrame, pattern: Pattern, columns: list[str] | None = None) -> DataFrame:
    """entries with hit: whether some visible cell has a match that is not empty."""
    pattern.check(entries.sparkSession)
    return entries.withColumn("hit", N.fold([finds(N.cell_text(c), pattern) for c in searched(entries, columns)]))


def find_matches(entries: DataFrame, pattern: Pattern, columns: list[str] | None = None) -> DataFrame:
    """source_idx, entry_no, column, start, length of every match. Places are sought only in entries that a plain test lets through."""
    columns = searched(entries, columns)
    hit = entries.where(N.fold([matches(N.cell_text(c), pattern) for c in columns]))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), match_ranges(N.cell_text(c), pattern).alias("ranges")) for c in columns)))
    return hit.select("source_idx", "entry_no", cells.alias("c")).select(
        "source_idx", "entry_no", F.col("c.column").alias("column"), F.explode("c.ranges").alias("m"),
    ).select("source_idx", "entry_no", "column", "m.start", "m.length")


def match_count(entries: DataFrame, pattern: Pattern, columns: list[str] | None = None) -> DataFrame:
    return find_rows(entries, pattern, columns).agg(F.count_if("hit").alias("match_count"))


def navigate(entries: DataFrame, pattern: Pattern, columns: list[str] | None = None) -> DataFrame:
    """Each hit with ordinal (from 1), and the entries (source_idx, entry_no) that next and previous lead to, around the ends.

    Entries are searched once, now, and the places of hits written. Ranks and neighbours are found inside segments, and over one row for
    each segment: how many hits stand before it, and which are the last before and the first after it.
    """
    place = F.struct("source_idx", "entry_no")
    folder = new_folder(entries.sparkSession, "hits")
    find_rows(entries, pattern, columns).where("hit").select("source_idx", "entry_no").write.parquet(folder)
    hits = entries.sparkSession.read.schema("source_idx int, entry_no long").parquet(folder)
    dealt = hits.withColumn("segment", F.struct("source_idx", F.floor(F.col("entry_no") / SEGMENT).alias("at")))
    # One row for each segment with a hit.
    order = Window.orderBy("segment")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    segments = dealt.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low"), F.max(place).alias("high")).select(
        "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank"), F.coalesce(F.last("high").over(before), F.last("high").over(every)).alias("left"),
        F.coalesce(F.first("low").over(after), F.first("low").over(every)).alias("right"),
    )
    inside = Window.partitionBy("segment").orderBy("entry_no")
    local = dealt.select(
        "source_idx", "entry_no", "segment", F.row_number().over(inside).alias("k"), F.lead(place).over(inside).alias("later"), F.lag(place).over(inside).alias("earlier"),
    )
    return local.join(segments, "segment").select(
        "source_idx", "entry_no", (F.col("k") + F.col("rank")).alias("ordinal"), F.coalesce("later", "right").alias("next"), F.coalesce("earlier", "left").alias("previous"),
    )


def nth_hit(navigated: DataFrame, ordinal: int) -> DataFrame:
    """source_idx and entry_no of one hit by its ordinal."""
    return navigated.where(F.col("ordinal") == ordinal).select("source_idx", "entry_no")


# Counts --------------------------------------------------------------------------------------------------------------


def level_counts(entries: DataFrame) -> DataFrame:
    """level_idx, level, n for all eight levels."""
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("level_idx"), F.lit(x).alias("level")) for i, x in enumerate(N.LEVELS))))
    every = entries.sparkSession.range(1).select(levels.alias("l")).select("l.*")
    counted = entries.groupBy("level_idx").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "level_idx", "left").select("level_idx", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def levels_present(entries: DataFrame) -> DataFrame:
    return level_counts(entries).where("n > 0").orderBy("level_idx").select("level_idx", "level")


def document_info(entries: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """name ("first + k more files" for several), format_id, entries, sources; sizes (sources.lines.document_sizes) adds bytes, truncated and encoding."""
    per = entries.groupBy("source_idx", "source_name").agg(F.first("format_id").alias("format_id"), F.count(F.lit(1)).alias("n"))
    per = per.join(sizes, "source_idx", "left") if sizes is not None else per
    more = [
        F.sum("bytes").alias("bytes"), F.max("truncated").alias("truncated"), F.min_by("encoding", "source_idx").alias("encoding"),
    ] if sizes is not None else []
    first = F.min_by("source_name", "source_idx")
    name = F.when(F.count(F.lit(1)) > 1, F.concat(first, F.lit(" + "), (F.count(F.lit(1)) - 1).cast("string"), F.lit(" more files"))).otherwise(first)
    return per.agg(
        name.alias("name"), F.min_by("format_id", "source_idx").alias("format_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"),
        F.count(F.lit(1)).alias("sources"), *more,
    )


# Merging -------------------------------------------------------------------------------------------------------------


def can_time_merge(entries: DataFrame | OpenLogs) -> bool:
    """Whether the first entry of every source has a time. Of opened files only what holds the first entries is read."""
    rows = entries if isinstance(entries, DataFrame) else entries.first(1)
    first = rows.groupBy("source_idx").agg(F.min_by(F.col("time").isNotNull(), "entry_no").alias("timed"))
    return bool(first.agg(F.coalesce(F.every("timed"), F.lit(True))).first()[0])


def time_merge(entries: DataFrame) -> DataFrame:
    """entries with merge_time, by which and source_idx, entry_no they are to be sorted: the merge of sources on the times of
    their heads, in which each source keeps its order even where its times step back. An entry without a time follows
    the one before it.

    Times alone are looked at first, now: a segment whose entries all have times, in order and from where the segments before it left off, is a
    sorted run, and its entries merge by their own times where they are. Only entries of other segments are shuffled for a running maximum.
    """
    spark, dealt = entries.sparkSession, entries.withColumn("_segment", F.floor(F.col("entry_no") / SEGMENT))
    inside, before = Window.partitionBy("source_idx", "_segment").orderBy("entry_no"), Window.partitionBy("source_idx").orderBy("_segment")
    times = dealt.select("source_idx", "_segment", "entry_no", "time", (F.lag("time").over(inside) > F.col("time")).alias("back"))
    runs = times.groupBy("source_idx", "_segment").agg(
        F.min("time").alias("low"), F.max("time").alias("high"), (F.every(F.col("time").isNotNull()) & ~F.coalesce(F.some("back"), F.lit(False))).alias("run"),
    ).withColumn("_c", F.max("high").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    sorted_ = (F.col("run") & F.coalesce(F.col("low") >= F.col("_c"), F.lit(True))).alias("_sorted")
    folder = new_folder(spark, "runs")
    runs.select("source_idx", "_segment", "_c", sorted_).write.parquet(folder)
    known = spark.read.schema("source_idx int, _segment long, _c timestamp, _sorted boolean").parquet(folder)
    counts = {r["_sorted"]: r["count"] for r in known.groupBy("_sorted").count().collect()}
    placed = dealt.join(F.broadcast(known) if sum(counts.values()) <= BROADCAST_SEGMENTS else known, ["source_idx", "_segment"])
    merged = [placed.where("_sorted").withColumn("merge_time", F.col("time"))] if counts.get(True) or not counts else []
    if counts.get(False):
        own = F.max("time").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        merged.append(placed.where("not _sorted").withColumn("merge_time", F.greatest(own, "_c")))
    return reduce(DataFrame.unionByName, merged).drop("_segment", "_c", "_sorted")


def concat_sources(entries: DataFrame) -> DataFrame:
    return entries.withColumn("merge_time", F.lit(None).cast("timestamp"))


def merge_documents(entries: DataFrame | OpenLogs) -> tuple[DataFrame, bool]:
    """entries in order, and whether they are merged by time (else source by source)."""
    timed = can_time_merge(entries)
    entries = entries if isinstance(entries, DataFrame) else entries.entries
    merged = time_merge(entries) if timed else concat_sources(entries)
    return merged.orderBy(F.asc_nulls_first("merge_time"), "source_idx", "entry_no"), timed


def merge_numbers(merged: DataFrame) -> DataFrame:
    """merge_no, from 0: each row's place. Rows are dealt to ranges of that order of about equal size, and written, so that
    their ranges stay as they are; places are counted by range and then inside it."""
    order = ["merge_time", "source_idx", "entry_no"]
    folder = new_folder(merged.sparkSession, "merged")
    merged.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    dealt = merged.sparkSession.read.parquet(folder).withColumn("_all", F.lit(0))
    return number(dealt, ["_all"], "_range", order, "merge_no", 0).drop("_all", "_range")


# Export --------------------------------------------------------------------------------------------------------------


def write_csv(entries: DataFrame, columns: list[str], path: str) -> None:
    """Every value quoted, quotes doubled, with a header; in source and entry order over the files."""
    rows = entries.orderBy("source_idx", "entry_no").select(*(N.cell_text(c).alias(c) for c in columns))
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def text_rows(entries: DataFrame, columns: list[str], flat: bool = False) -> DataFrame:
    """source_idx, entry_no, value: cells joined by tabs; flat: line ends inside cells become blanks."""
    cell = lambda c: F.translate(N.cell_text(c), "\n", " ") if flat else N.cell_text(c)
    return entries.select("source_idx", "entry_no", F.concat_ws("\t", *(cell(c) for c in columns)).alias("value"))


def write_text(entries: DataFrame, columns: list[str], path: str, flat: bool = False) -> None:
    text_rows(entries, columns, flat).orderBy("source_idx", "entry_no").select("value").write.text(path)
