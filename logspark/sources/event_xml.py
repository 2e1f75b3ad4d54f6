"""Windows event XML exports: one entry for each ``<Event ...>`` element, whatever the line breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.operators.formats import no_extra
from logspark.operators.ordered import number, running_sum

from . import lines as L
from .scratch import new_folder

SCHEMA = (
    "System struct<Provider:struct<_Name:string>,EventID:string,Level:string,TimeCreated:struct<_SystemTime:string>,Computer:string>,"
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>,RenderingInfo struct<Message:string,Level:string>,_corrupt string"
)


def parsed_events(records: DataFrame) -> DataFrame:
    """The events of records (source_idx, source_name, block, position, xml: text that ends where an event's end tag stood), without
    their numbers. What precedes the event in a record is skipped; a record without an event, or with a malformed one, gives no entry."""
    found = records.withColumn("at", F.instr("xml", "<Event ")).where("at > 0")
    event = F.concat(F.expr("substring(xml, at)"), F.lit("</Event>"))
    more = [c for c in records.columns if c == "truncated"]
    read = found.select("source_idx", "source_name", "block", "position", event.alias("xml"), *more)
    # As the only element of an array that is exploded, an event is parsed once: neither the fields nor the filter on them repeat it.
    event = F.from_xml(F.col("xml"), SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    e = read.select("*", F.explode(F.array(event)).alias("e")).where("e is not null and e._corrupt is null")
    shown, numeric = F.trim(N.or_empty(F.col("e.RenderingInfo.Level"))), F.col("e.System.Level").try_cast("int")
    named = N.normalize_level(shown)
    level = F.when((shown != "") & (named != "OTHER"), named).otherwise(N.event_level(numeric))
    raw = F.when((shown != "") & (named != "OTHER"), shown).when(level != "OTHER", level).otherwise("")
    data = F.filter(
        F.coalesce(F.col("e.EventData.Data"), F.array()),
        lambda d: (F.trim(N.or_empty(d["_VALUE"])) != "") & (F.length(F.trim(d["_VALUE"])) <= N.LONGEST_EXTRA),
    )
    joined = F.array_join(
        F.transform(
            data,
            lambda d: F.when(N.or_empty(d["_Name"]) == "", F.trim(d["_VALUE"])).otherwise(F.concat(d["_Name"], F.lit("="), F.trim(d["_VALUE"]))),
        ),
        "; ",
    )
    message = F.trim(N.or_empty(F.col("e.RenderingInfo.Message")))
    extra = F.map_filter(
        F.create_map(F.lit("Event ID"), F.trim(N.or_empty(F.col("e.System.EventID"))), F.lit("Data"), F.substring(joined, 1, N.LONGEST_EXTRA)),
        lambda _, v: v != "",
    )
    return e.select(
        "source_idx", "source_name", "block", "position", F.lit("wevt_xml").alias("format_id"), F.lit(1).alias("physical_lines"),
        N.parse_time(N.or_empty(F.col("e.System.TimeCreated._SystemTime"))).alias("time"), level.alias("level"), N.level_index(level).alias("level_idx"), raw.alias("raw_level"),
        F.lit("").alias("thread"), N.or_empty(F.col("e.System.Provider._Name")).alias("target"), F.trim(N.or_empty(F.col("e.System.Computer"))).alias("host"), F.lit("").alias("pid"), F.coalesce(extra, no_extra()).alias("extra"),
        F.when(message != "", message).when(joined != "", joined).otherwise(F.substring("xml", 1, 500)).alias("message"), *more,
    )


COLUMNS = [
    "source_idx", "source_name", "format_id", "entry_no", "first_line", "physical_lines", "time", "level", "level_idx", "raw_level", "thread",
    "target", "host", "pid", "extra", "message",
]


def numbered_events(parsed: DataFrame) -> DataFrame:
    """Parsed events with their numbers: entry_no from 0, and first_line, which counts events from 1."""
    return number(parsed, ["source_idx"], "block", ["position"], "n").withColumn("entry_no", (F.col("n") - 1).cast("long")).withColumn(
        "first_line", F.col("n").cast("long"),
    ).select(COLUMNS + [c for c in parsed.columns if c == "truncated"])


def entries_of_events(records: DataFrame) -> DataFrame:
    """Entries of records, see parsed_events."""
    return numbered_events(parsed_events(records))


def _upto_line(records: DataFrame, max_lines: int) -> DataFrame:
    """The records that end within the first lines of their source, and truncated: whether it has as many lines or more."""
    breaks = F.regexp_count("xml", F.lit(r"\r\n|\r|\n"))
    counted = running_sum(records, ["source_idx"], "block", ["position"], breaks.cast("long"), "breaks")
    # A last line without an end counts, as long as there is something in it.
    last = F.max(F.struct("block", "position", F.length(F.regexp_extract("xml", r"[^\r\n]*\z", 0)).alias("n")))["n"] > 0
    sizes = counted.groupBy("source_idx").agg((F.max("breaks") + last.cast("int") >= max_lines).alias("truncated"))
    return counted.where(F.col("breaks") < max_lines).drop("breaks").join(sizes, "source_idx")


def read_event_xml(spark: SparkSession, paths: list[str] | DataFrame, encoding: str | None = None, max_lines: int = 0) -> DataFrame:
    """Entries of event XML files (paths, or what read_heads found of them) in any encoding that lines may have; large files are split at end
    tags, also where all is one line. max_lines: only events that end within the first lines of their file; entries then have truncated.

    The files are read once, now, and what was parsed is written, so numbers don't hang on how Spark splits the files later.
    """
    heads = paths if isinstance(paths, DataFrame) else L.read_heads(spark, [paths] if isinstance(paths, str) else list(paths), encoding)
    L.legacy_charsets(spark)
    found, _ = L.placed_lines(spark, heads, separator="</Event>", about=["source_name"])
    records = found.withColumnsRenamed({"place": "position", "text": "xml"})
    if max_lines:
        folder = new_folder(spark, "records")
        records.write.parquet(folder)
        records = _upto_line(spark.read.schema(records.schema).parquet(folder), max_lines)
    parsed = parsed_events(records)
    folder = new_folder(spark, "events")
    parsed.write.parquet(folder)
    return numbered_events(spark.read.schema(parsed.schema).parquet(folder))
