"""Column functions that bring log fields to one form."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ["TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "ERROR", "FATAL", "OTHER"]

# Level tokens, syslog priorities, numeric event levels, month names, candidate keys.
LEVEL_TOKENS = {
    "TRACE": ["TRACE", "TRC", "VERBOSE", "VRB", "详细"],
    "DEBUG": ["DEBUG", "DBG", "D"],
    "INFO": ["INFO", "INF", "I", "INFORMATION", "信息", "成功"],
    "NOTICE": ["NOTICE", "NOT"],
    "WARN": ["WARN", "WARNING", "WRN", "W", "警告"],
    "ERROR": ["ERROR", "ERR", "E", "SEVERE", "错误"],
    "FATAL": ["FATAL", "FTL", "CRITICAL", "CRIT", "ALERT", "EMERG", "EMERGENCY", "PANIC", "严重"],
}
PRIORITIES = {0: "FATAL", 1: "FATAL", 2: "FATAL", 3: "ERROR", 4: "WARN", 5: "NOTICE", 6: "INFO", 7: "DEBUG"}
EVENT_LEVELS = {0: "INFO", 1: "FATAL", 2: "ERROR", 3: "WARN", 4: "INFO", 5: "TRACE"}
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
TIME_KEYS = ["@timestamp", "timestamp", "time", "ts", "datetime", "TimeCreated", "__REALTIME_TIMESTAMP", "_SOURCE_REALTIME_TIMESTAMP"]
LEVEL_KEYS = ["level", "severity", "lvl", "log_level", "levelname", "LevelDisplayName", "PRIORITY"]
MESSAGE_KEYS = ["message", "msg", "MESSAGE", "text", "event", "renderedMessage"]
HOST_KEYS = ["host", "hostname", "_HOSTNAME"]
PID_KEYS = ["pid", "procid", "process", "_PID", "ProcessId"]
TARGET_KEYS = ["logger", "target", "module", "source", "category", "SYSLOG_IDENTIFIER", "ProviderName", "name"]

#: Extras longer than this are not kept.
LONGEST_EXTRA = 200


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where of uses the value more than once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_level(text: Column) -> Column:
    """One of LEVELS: the token without brackets and punctuation, if it is a known one of at most 12 characters."""
    token = F.regexp_replace(F.regexp_replace(F.trim(or_empty(text)), r"^[\[({<\s]+", ""), r"[\])}>:,\-\s]+$", "")
    tokens = {t: level for level, ts in LEVEL_TOKENS.items() for t in ts}
    # Most texts are names of levels as they are.
    return F.when(or_empty(text).isin(LEVELS[:7]), text).when(F.length(token) > 12, "OTHER").otherwise(
        F.coalesce(F.try_element_at(literal_map(tokens), F.upper(token)), F.lit("OTHER")),
    )


def level_from_priority(n: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(PRIORITIES), n.cast("int")), F.lit("OTHER"))


def level_index(level: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map({x: i for i, x in enumerate(LEVELS)}), level), F.lit(7))


def event_level(n: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(EVENT_LEVELS), n.cast("int")), F.lit("OTHER"))


def http_level(status: Column) -> Column:
    code = F.coalesce(status.try_cast("int"), F.lit(0))
    return F.when(code >= 500, "ERROR").when(code >= 400, "WARN").otherwise("INFO")


ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,9})?\s*(?:Z|[+-]\d{2}:?\d{2})?$"
SYSLOG = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})$"
CLOCK = r"^\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?$"


def parse_time(text: Column, reference: Column | None = None) -> Column:
    """TIMESTAMP in milliseconds, NULL if it can't be read. reference: the date that stands in for a missing date or year
    (a syslog date later than the day after it belongs to the year before); times without a zone are in the session's.

    A pattern admits the text, a cast reads it: a nine-digit fraction is cut, an impossible date is NULL.
    """
    dotted = F.translate(text, ",", ".")
    zoned = F.regexp_replace(F.regexp_replace(dotted, r"\s*(?:(Z)|([+-]\d{2}):?(\d{2}))$", "$1$2:$3"), "Z:$", "Z")
    # Only a text that is longer than a date and a clock time can end with a zone.
    iso = F.when(dotted.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & (F.length(dotted) > 16), zoned).otherwise(dotted).try_cast("timestamp")
    if reference is None:
        return F.date_trunc("MILLISECOND", F.when(text.rlike(ISO), iso))
    month = F.floor((F.instr(F.lit("".join(MONTHS)), F.regexp_extract(text, SYSLOG, 1)) + 2) / 3)
    day = F.concat(F.lit("-"), month.cast("string"), F.lit("-"), F.regexp_extract(text, SYSLOG, 2), F.lit(" "), F.regexp_extract(text, SYSLOG, 3))
    in_year = lambda year: F.concat(year.cast("string"), day).try_cast("timestamp")
    this, last = in_year(F.year(reference)), in_year(F.year(reference) - 1)
    syslog = F.when(this.isNull() | (this >= F.date_add(reference, 2).cast("timestamp")), last).otherwise(this)
    clock = F.concat(reference.cast("string"), F.lit(" "), dotted).try_cast("timestamp")
    return F.date_trunc("MILLISECOND", F.when(text.rlike(ISO), iso).when(text.rlike(SYSLOG), syslog).when(text.rlike(CLOCK), clock))


def time_of_value(text: Column, reference: Column | None = None) -> Column:
    """parse_time, or for a number the seconds, milliseconds (over 1e12) or microseconds (over 1e15) since 1970."""

    def read(trimmed: Column) -> Column:
        n = F.when(trimmed.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
        ms = F.when(n > 1e15, n / 1000).when(n > 1e12, n).otherwise(n * 1000)
        return F.when(n.isNotNull(), F.timestamp_millis(ms.cast("long"))).otherwise(parse_time(trimmed, reference))

    return let(F.trim(or_empty(text)), read)


def date_of_name(name: Column) -> Column:
    """The first date in a file name, NULL without a valid one."""
    return F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def _same_name(values: Column, low: str) -> Column:
    return F.map_filter(values, lambda name, _: F.lower(name) == low)


def first_key(values: Column, keys: list[str], any_case: bool = True) -> Column:
    """The value of the first key that the map has, '' without one; each key exactly, then in any case."""
    found = []
    for k in keys:
        found.append(F.try_element_at(values, F.lit(k)))
        if any_case:
            found.append(F.try_element_at(F.map_values(_same_name(values, k.lower())), F.lit(1)))
    return F.coalesce(*found, F.lit(""))


def split_cells(line: Column, delimiter: str) -> Column:
    """Cells of a delimited line; quotes may open inside a cell, and a doubled quote inside quotes is one."""
    d = {"|": r"\|", "\t": r"\t"}.get(delimiter, delimiter)
    cells = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'(?s){d}((?:"(?:[^"]|"")*(?:"|\z)|[^"{d}])*)'), 1)

    def unquote(segment: Column) -> Column:
        return F.when(
            segment.startswith('"'), F.replace(F.regexp_replace(segment, r'(?s)\A"((?:[^"]|"")*)(?:"|\z)\z', "$1"), F.lit('""'), F.lit('"')),
        ).otherwise(segment)

    return F.transform(
        cells, lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r'(?s)("(?:[^"]|"")*(?:"|\z)|[^"]+)'), 1), unquote), ""),
    )


def cell_text(column: str) -> Column:
    """What a column of an entry shows, and searches see: extra keys as ``extra:<key>``."""
    if column == "time":
        return or_empty(F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSS"))
    if column == "level":
        return F.when(F.col("raw_level") == "", F.col("level")).otherwise(F.col("raw_level"))
    if column == "line":
        return F.col("first_line").cast("string")
    if column == "file":
        return F.col("source_name")
    if column.startswith("extra:"):
        return or_empty(F.try_element_at("extra", F.lit(column[6:])))
    return or_empty(F.col(column))


def fold(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
