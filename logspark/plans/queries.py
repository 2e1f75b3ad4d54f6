"""The registered log queries and their SQL.

The given tables hold no logs, so queries first render rows as log text and then read that text with the library; the
SQL computes the same answer from the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.functions.ansi import strip_control
from logspark.functions.match import Pattern, match_ranges
from logspark.operators import detect, fragments
from logspark.operators import formats as X
from logspark.operators import table as T
from logspark.operators.entries import OpenLogs, entries_of_lines, open_lines, read_logs
from logspark.sources.event_xml import entries_of_events, read_event_xml
from logspark.sources.lines import document_sizes, legacy_charsets, lines_from_df, read_heads, scan_lines
from logspark.sources.scratch import new_folder
from logspark.streaming import follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rendering -----------------------------------------------------------------------------------------------------------

LEVEL = {"view": "DEBUG", "click": "INFO", "signup": "NOTICE", "purchase": "WARN", "error": "ERROR"}
PRIORITY = {"view": 7, "click": 6, "signup": 5, "purchase": 4, "error": 3}
SHORT = {"view": "DBG", "click": "INF", "signup": "INF", "purchase": "WRN", "error": "ERR"}
EVENT = {"view": "Verbose", "click": "Information", "signup": "Information", "purchase": "Warning", "error": "Error"}
EVENT_NUMBER = {"view": "5", "click": "4", "signup": "0", "purchase": "3", "error": "2"}
STATUS = {"view": "200", "click": "200", "signup": "302", "purchase": "404", "error": "500"}


def by_type(values: dict) -> Column:
    return F.try_element_at(N.literal_map(values), F.col("event_type"))


def sql_case(values: dict) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with clock (to the millisecond), iso, level and message."""
    clock = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    return load(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "props", clock.alias("clock"),
        F.concat(F.replace(clock, F.lit(" "), F.lit("T")), F.lit("Z")).alias("iso"), by_type(LEVEL).alias("lv"),
        F.concat(F.lit("user "), "user_id", F.lit(" did "), "event_type").alias("msg"),
    )


def text(*parts) -> Column:
    return F.concat(*(F.col(p[1:]) if isinstance(p, str) and p.startswith("$") else p if isinstance(p, Column) else F.lit(p) for p in parts))


def as_lines(rows: DataFrame, line: Column, head: str | None = None) -> DataFrame:
    """Rendered rows as the lines of one source, in the order of event_id, below a head line."""
    shown = rows.select("event_id", line.alias("t"))
    if head is not None:
        shown = shown.unionByName(rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(head).alias("t")))
    return lines_from_df(shown, F.col("event_id"), F.col("t"))


def shown(entries: DataFrame) -> DataFrame:
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return entries.select("entry_no", N.cell_text("time").alias("time"), "level", "thread", "target", "host", "pid", extra.alias("extra"), "message")


def sql_shown(
    level: dict, thread="''", target="''", host="''", pid="''", extra="''", message="'user ' || user_id || ' did ' || event_type",
    fmt="%Y-%m-%d %H:%M:%S.%g", tail="",
) -> str:
    levels = sql_case(level)
    return f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS entry_no, strftime(ts, '{fmt}'){tail} AS time, {levels} AS level, {thread} AS thread, {target} AS target, {host} AS host, {pid} AS pid, {extra} AS extra, {message} AS message FROM events"


# Formats -------------------------------------------------------------------------------------------------------------

def user(n: int) -> Column:
    return F.col("user_id") % n


def generic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lines(events(spark, sf_dir), text("$clock", " ", "$lv", " ", "$msg"))


def generic_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries_of_lines(generic_lines(spark, sf_dir), "generic")


LEVEL_ROWS = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(N.LEVELS)) + ") AS l(level_idx, level)"


@query(f"SELECT l.level_idx, l.level, count(e.event_id) AS n FROM {LEVEL_ROWS} LEFT JOIN (SELECT event_id, {sql_case(LEVEL)} AS level FROM events) e ON e.level = l.level GROUP BY l.level_idx, l.level")
def level_counts_generic(spark, sf_dir):
    return T.level_counts(generic_entries(spark, sf_dir))


@query(f"SELECT DISTINCT l.level_idx, l.level FROM {LEVEL_ROWS} JOIN (SELECT {sql_case(LEVEL)} AS level FROM events) e ON e.level = l.level")
def levels_present(spark, sf_dir):
    return T.levels_present(generic_entries(spark, sf_dir))


@query(sql_shown(LEVEL))
def ingest_generic(spark, sf_dir):
    return shown(generic_entries(spark, sf_dir))


@query(sql_shown(LEVEL | {"signup": "INFO"}, thread="'worker-' || (user_id % 4)", target="'shop::events'", extra="'ThreadId=' || (user_id % 16)"))
def ingest_tracing(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(
        e, text("$iso", "  ", by_type(LEVEL | {"signup": "INFO"}), " worker-", user(4), " ThreadId(", user(16), ") shop::events: ", "$msg"),
    )))


@query(sql_shown(LEVEL, target="'shop'", host="'host' || (user_id % 4)", pid="user_id::VARCHAR", extra="'MsgId=' || event_type"))
def ingest_syslog5424(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(
        e, text("<", by_type(PRIORITY) + 8, ">1 ", "$iso", " host", user(4), " shop ", "$user_id", " ", "$event_type", " ", "$msg"),
    )))


def _syslog3164(spark, sf_dir, format):
    e = load(spark, sf_dir, "events").withColumn("lv", by_type(LEVEL))
    line = text(F.date_format("ts", "MMM dd HH:mm:ss"), " host", user(4), " shop[", "$user_id", "]: ", F.initcap("lv"), ": user did ", "$event_type")
    lines = lines_from_df(
        e, F.col("event_id"), line, F.datediff(F.to_date("ts"), F.lit(date(2000, 1, 1))),
        F.concat(F.lit("app."), F.date_format("ts", "yyyy-MM-dd"), F.lit(".log")),
    )
    return shown(entries_of_lines(lines, format)).drop("entry_no")


SYSLOG3164_SQL = sql_shown(
    LEVEL, target="'shop'", host="'host' || (user_id % 4)", pid="user_id::VARCHAR", message="'user did ' || event_type", fmt="%Y-%m-%d %H:%M:%S",
    tail=" || '.000'",
).replace("row_number() OVER (ORDER BY event_id) - 1 AS entry_no, ", "")


@query(SYSLOG3164_SQL)
def ingest_syslog3164(spark, sf_dir):
    return _syslog3164(spark, sf_dir, "auto")


@query(SYSLOG3164_SQL)
def ingest_journalctl_short(spark, sf_dir):
    return _syslog3164(spark, sf_dir, "journalctl_short")


@query(sql_shown(LEVEL, target="'shop'", host="'host' || (user_id % 4)", pid="user_id::VARCHAR"))
def ingest_journal_json(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("micros", (F.unix_millis(F.to_timestamp("clock")) * 1000).cast("string"))
    line = F.to_json(F.struct(
        F.col("micros").alias("__REALTIME_TIMESTAMP"), by_type(PRIORITY).cast("string").alias("PRIORITY"), F.col("msg").alias("MESSAGE"),
        text("host", user(4)).alias("_HOSTNAME"), F.lit("shop").alias("SYSLOG_IDENTIFIER"), F.col("user_id").cast("string").alias("_PID"),
    ))
    return shown(entries_of_lines(as_lines(e, line)))


@query(sql_shown(LEVEL, host="'host' || (user_id % 4)", extra="'user=' || user_id"))
def ingest_json_lines(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(
        e,
        F.to_json(F.struct(
            F.col("iso").alias("time"), F.lower("lv").alias("level"), F.col("msg").alias("message"), text("host", user(4)).alias("host"),
            F.col("user_id").alias("user"),
        )),
    )))


@query(sql_shown(LEVEL, host="'host' || (user_id % 4)", extra="'user=' || user_id"))
def ingest_logfmt(spark, sf_dir):
    legacy_charsets(spark)
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(
        e, text("time=", "$iso", " level=", F.lower("lv"), ' msg="', "$msg", '" host=host', user(4), " user=", "$user_id"),
    )))


@query(sql_shown(LEVEL, target="'shop'", extra="'User=' || user_id", message="'user, \"' || user_id || '\" did ' || event_type"))
def ingest_csv(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(
        e, text("$iso", ",", "$lv", ',shop,"user, ""', "$user_id", '"" did ', "$event_type", '",', "$user_id"), "Time,Level,Logger,Message,User",
    )))


@query(sql_shown(LEVEL, target="'shop.events'"))
def ingest_python(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(e, text(F.replace("clock", F.lit("."), F.lit(",")), " - ", "$lv", " - shop.events - ", "$msg"))))


@query(sql_shown(LEVEL | {"signup": "INFO"}))
def ingest_serilog(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(e, text("$clock", " +00:00 [", by_type(SHORT), "] ", "$msg"))))


@query(sql_shown(LEVEL | {"signup": "INFO"}, fmt="2024-05-06 %H:%M:%S.%g"))
def ingest_serilog_clock(spark, sf_dir):
    # The short form has only a clock time; the date is given.
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(e, text("[", F.substring("clock", 12, 12), " ", by_type(SHORT), "] ", "$msg")), reference=date(2024, 5, 6)))


@query(sql_shown(LEVEL, thread="'main-' || (user_id % 4)", target="'com.shop.Events'"))
def ingest_log4j(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(
        e, text(F.replace("clock", F.lit("."), F.lit(",")), " [main-", user(4), "] ", "$lv", "  com.shop.Events - ", "$msg"),
    )))


@query(sql_shown(
    {"view": "TRACE", "click": "INFO", "signup": "INFO", "purchase": "WARN", "error": "ERROR"}, target="'shop'", extra="'EventId=' || user_id",
    message="'user ' || user_id || ' did ' || event_type || ' again'",
))
def ingest_wevt_text(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(
        e,
        text(
            "TimeCreated      : ", "$clock", "\nProviderName     : shop\nEventId          : ", "$user_id", "\nLevelDisplayName : ", by_type(EVENT),
            "\nMessage          : ", "$msg", "\n  again",
        ),
    )))


@query(sql_shown(
    {"view": "TRACE", "click": "INFO", "signup": "INFO", "purchase": "WARN", "error": "ERROR"}, target="'shop'", extra="'Event ID=' || user_id",
    message="'user ' || user_id || chr(10) || 'did ' || event_type",
))
def ingest_wevt_tsv(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(
        e, text(by_type(EVENT), "\t", "$clock", "\tshop\t", "$user_id", '\tNone\t"user ', "$user_id", "\ndid ", "$event_type", '"'),
        "Level\tDate and Time\tSource\tEvent ID\tTask Category",
    )))


@query(sql_shown(
    {"view": "TRACE", "click": "INFO", "signup": "INFO", "purchase": "WARN", "error": "ERROR"}, target="'shop'", host="'host' || (user_id % 4)",
    extra="'Data=user=' || user_id || '; did=' || event_type || ';Event ID=7'", message="'user=' || user_id || '; did=' || event_type",
))
def ingest_wevt_xml(spark, sf_dir):
    e = _event_xml(spark, sf_dir)
    return shown(entries_of_events(e.select(
        F.lit(0).alias("source_idx"), F.lit("events.xml").alias("source_name"), F.floor(F.col("event_id") / 10_000).alias("block"),
        F.col("event_id").alias("position"), "xml",
    )))


@query(SQL["ingest_wevt_xml"].replace("row_number() OVER (ORDER BY event_id) - 1 AS entry_no, ", ""))
def read_event_xml_files(spark, sf_dir):
    folder = new_folder(spark, "event-xml")
    _event_xml(spark, sf_dir).select(F.concat("xml", F.lit("</Event>")).alias("value")).write.text(folder)
    return shown(read_event_xml(spark, [folder])).drop("entry_no")


@query(SQL["ingest_wevt_xml"])
def read_event_xml_utf16(spark, sf_dir):
    # Three events on each physical line, in two bytes a character, over several splits.
    folder, key = new_folder(spark, "event-xml-wide"), "spark.sql.files.maxPartitionBytes"
    e = _event_xml(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 3).alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", "xml"))).alias("x"))
    line = F.array_join(F.transform("x", lambda x: F.concat(x["xml"], F.lit("</Event>"))), "")
    e.repartitionByRange(4, "k").sortWithinPartitions("k").select(line.alias("value")).write.option("encoding", "UTF-16LE").option("quote", "").csv(folder)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "100001")
        entries = read_logs(spark, [folder])
    finally:
        spark.conf.set(key, before)
    # Numbers are by file here, so they are carried on over the files.
    return shown(T.visible_rows(entries, T.FilterSpec()).drop("entry_no").withColumnRenamed("visible_no", "entry_no"))


def _event_xml(spark, sf_dir) -> DataFrame:
    """events with xml: each as an Event element without its end tag."""
    e = events(spark, sf_dir)
    return e.withColumn(
        "xml",
        text(
            '<Event xmlns="urn:x"><System><Provider Name="shop"/><EventID>7</EventID><Level>', by_type(EVENT_NUMBER),
            '</Level><TimeCreated SystemTime="', "$iso", '"/><Computer>host', user(4), '</Computer></System><EventData><Data Name="user">',
            "$user_id", '</Data><Data Name="did">', "$event_type", "</Data></EventData>",
        ),
    )


@query(sql_shown(
    {"view": "INFO", "click": "INFO", "signup": "INFO", "purchase": "WARN", "error": "ERROR"}, host="'10.0.0.' || (user_id % 4)",
    extra="'UserAgent=agent' || (user_id % 16)", message="'GET /' || event_type || ' ' || " + sql_case(STATUS), fmt="%Y-%m-%d %H:%M:%S",
    tail=" || '.000'",
))
def ingest_iis(spark, sf_dir):
    e = events(spark, sf_dir)
    return shown(entries_of_lines(as_lines(
        e, text(F.substring("clock", 1, 19), " 10.0.0.", user(4), " GET /", "$event_type", " ", by_type(STATUS), " agent", user(16)),
        "#Fields: date time s-ip cs-method cs-uri-stem sc-status cs(User-Agent)",
    )))


DETECTED = ["tracing", "syslog5424", "json_lines", "logfmt", "python_logging", "serilog", "log4j_logback", "generic"]


def _mixed_lines(spark, sf_dir) -> DataFrame:
    """Events in a source for each of DETECTED."""
    e = events(spark, sf_dir)
    lv = by_type(LEVEL | {"signup": "INFO"})
    rendered = [
        text("$iso", "  ", lv, " w ThreadId(1) shop: ", "$msg"), text("<11>1 ", "$iso", " h shop 1 m ", "$msg"),
        F.to_json(F.struct(F.col("iso").alias("time"), F.col("msg").alias("message"))), text("time=", "$iso", ' msg="', "$msg", '"'),
        text("$clock", " - ", "$lv", " - shop - ", "$msg"), text("$clock", " [", by_type(SHORT), "] ", "$msg"),
        text("$clock", " [main] ", "$lv", " shop.A - ", "$msg"), text("$msg"),
    ]
    every = e.select("event_id", F.posexplode(F.array(*rendered)).alias("i", "t"))
    return lines_from_df(every, F.col("event_id"), F.col("t"), F.col("i"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}', {0 if x == 'generic' else 100})" for i, x in enumerate(DETECTED)) + ") AS t(source_idx, format_id, score)")
def detect_format_mixed(spark, sf_dir):
    return detect.detect_format(_mixed_lines(spark, sf_dir)).select("source_idx", "format_id", F.col("score").cast("int").alias("score"))


@query("SELECT t.*, (SELECT count(*) FROM events) AS lines FROM (VALUES (0, 'tracing', 0), (1, 'Syslog (RFC 5424)', 1), (2, 'JSON lines', 5), (3, 'logfmt (key=value)', 6), (4, 'Python logging', 8), "
       "(5, 'Serilog', 9), (6, 'Log4j / Logback', 10), (7, 'Generic text', 15)) AS t(source_idx, name, rank)")
def list_formats_of_sources(spark, sf_dir):
    lines = _mixed_lines(spark, sf_dir)
    named = detect.detect_format(lines).join(X.list_formats(spark).withColumnRenamed("id", "format_id"), "format_id")
    return named.join(lines.groupBy("source_idx").agg(F.count(F.lit(1)).alias("lines")), "source_idx").select("source_idx", "name", "rank", "lines")


@query(sql_shown(LEVEL, pid="user_id::VARCHAR", extra="'kind=' || event_type"))
def ingest_registered_format(spark, sf_dir):
    # A format of the user's own, found by its score among the others.
    def fields():
        return {"time": N.parse_time(X.g(1)), "raw_level": X.g(2), "pid": X.g(3), "extra": X.extra({"kind": X.g(4)}), "message": X.g(5)}

    spec = X.by_pattern("bars", "Bars", r"^EV\|([^|]*)\|([A-Z]+)\|(\d+)\|(\w+)\|(.*)$", fields)
    with X.registered(spec):
        return shown(entries_of_lines(as_lines(events(spark, sf_dir), text("EV|", "$clock", "|", "$lv", "|", "$user_id", "|", "$event_type", "|", "$msg"))))


# Entries -------------------------------------------------------------------------------------------------------------


def document_lines(spark, sf_dir) -> DataFrame:
    """Each document below a title line that starts an entry; a null text is an empty line."""
    d = load(spark, sf_dir, "documents")
    return lines_from_df(d, F.col("doc_id"), text("2024-01-01 00:00:00 INFO doc ", "$doc_id", "\n", strip_control(F.coalesce("text", F.lit("")))))


DOCUMENTS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@query(f"SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 2 AS physical_lines, 'doc ' || doc_id || chr(10) || text AS message FROM {DOCUMENTS}")
def fold_continuations(spark, sf_dir):
    e = entries_of_lines(document_lines(spark, sf_dir), "generic")
    return e.select(
        F.regexp_extract("message", r"^doc (\d+)", 1).cast("long").alias("doc_id"), F.col("physical_lines").cast("long").alias("physical_lines"),
        "message",
    )


@query(
    f"SELECT source, count(*) AS entries, sum(length(line)) AS chars FROM (SELECT 'first' AS source, 'doc ' || doc_id AS line FROM {DOCUMENTS} "
    f"UNION ALL SELECT 'rest', unnest(string_split(text, chr(10))) FROM {DOCUMENTS}) GROUP BY source"
)
def no_merge_continuations(spark, sf_dir):
    e = entries_of_lines(document_lines(spark, sf_dir), "generic", merge_continuations=False)
    return e.groupBy(F.when(F.col("raw_level") == "INFO", "first").otherwise("rest").alias("source")).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.length("message")).alias("chars"),
    )


# Filters, find, columns ----------------------------------------------------------------------------------------------

FROM, TO = datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 12)
ENTRY_SQL = f"(SELECT row_number() OVER (ORDER BY event_id) - 1 AS entry_no, date_trunc('millisecond', ts) AS time, {sql_case(LEVEL)} AS level, 'user ' || user_id || ' did ' || event_type AS message, * EXCLUDE (event_id) FROM events) e"


@query(f"SELECT entry_no, level, message FROM {ENTRY_SQL} WHERE level IN ('ERROR', 'WARN') AND time BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'")
def filter_level_time(spark, sf_dir):
    return T.apply_filter(generic_entries(spark, sf_dir), T.FilterSpec(frozenset(["ERROR", "WARN"]), FROM, TO)).select("entry_no", "level", "message")


def _by_pattern(spark, sf_dir, pattern, invert=False, columns=("message",)):
    return T.apply_filter(generic_entries(spark, sf_dir), T.FilterSpec(pattern=pattern, invert=invert, columns=columns)).select("entry_no", "message")


@query(f"SELECT entry_no, message FROM {ENTRY_SQL} WHERE regexp_matches(message, '(^|[^A-Za-z0-9_])[uU][sS][eE][rR] 1($|[^A-Za-z0-9_])')")
def filter_keyword_word(spark, sf_dir):
    return _by_pattern(spark, sf_dir, Pattern("USER 1"))


@query(f"SELECT entry_no, message FROM {ENTRY_SQL} WHERE regexp_matches(message, 'user .7 did [^/]*up')")
def filter_wildcard(spark, sf_dir):
    return _by_pattern(spark, sf_dir, Pattern("user ?7 did *up", "wildcard"))


@query(f"SELECT entry_no, message FROM {ENTRY_SQL} WHERE regexp_matches(message, '^user [0-9]{{1,2}} did (view|error)$')")
def filter_regex(spark, sf_dir):
    return _by_pattern(spark, sf_dir, Pattern(r"^user \d{1,2} did (view|error)$", "regex", True))


@query(f"SELECT entry_no, message FROM {ENTRY_SQL} WHERE NOT regexp_matches(message, 'view') AND level <> 'ERROR'")
def filter_inverted(spark, sf_dir):
    return _by_pattern(spark, sf_dir, Pattern("view|ERROR", "regex", True), True, ("level", "message"))


@query(f"SELECT count(*) FILTER (level IN ('ERROR')) AS shown, count(*) AS total FROM {ENTRY_SQL}")
def shown_of_total(spark, sf_dir):
    return T.shown_of_total(generic_entries(spark, sf_dir), T.FilterSpec(frozenset(["ERROR"])))


@query(f"SELECT entry_no, row_number() OVER (ORDER BY entry_no) - 1 AS visible_no FROM {ENTRY_SQL} WHERE level = 'WARN'")
def visible_rows(spark, sf_dir):
    return T.visible_rows(generic_entries(spark, sf_dir), T.FilterSpec(frozenset(["WARN"]))).select("entry_no", "visible_no")


def talk_entries(spark, sf_dir) -> DataFrame:
    """Conversation turns as entries, a turn's line ends made blank."""
    c = load(spark, sf_dir, "conversations")
    line = F.concat(F.lit("2024-01-01 00:00:00 INFO "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "))
    return entries_of_lines(lines_from_df(c, F.col("conv_id") * 1000 + F.col("turn"), line, segment=F.floor(F.col("conv_id") / 1000)), "generic")


TALK_SQL = "(SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS entry_no, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') AS message FROM conversations)"
HITS_SQL = f"(SELECT entry_no, row_number() OVER (ORDER BY entry_no) AS ordinal FROM {TALK_SQL} WHERE regexp_matches(message, '(^|[^A-Za-z0-9_])[tT][hH][aA][tT]($|[^A-Za-z0-9_])'))"


@query(f"SELECT entry_no, ordinal, coalesce(lead(entry_no) OVER (ORDER BY ordinal), min(entry_no) OVER ()) AS next_entry, coalesce(lag(entry_no) OVER (ORDER BY ordinal), max(entry_no) OVER ()) AS previous_entry FROM {HITS_SQL}")
def find_next_prev(spark, sf_dir):
    return T.navigate(talk_entries(spark, sf_dir), Pattern("that")).select(
        "entry_no", "ordinal", F.col("next.entry_no").alias("next_entry"), F.col("previous.entry_no").alias("previous_entry"),
    )


@query(f"SELECT count(*) AS match_count FROM {HITS_SQL}")
def match_count(spark, sf_dir):
    return T.match_count(talk_entries(spark, sf_dir), Pattern("that"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'tion', ''))) // 4 AS found, instr(text, 'tion') - 1 AS first_start FROM documents WHERE contains(text, 'tion')")
def match_ranges_regex(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", match_ranges(F.col("text"), Pattern("tion", "regex", True), 1_000_000).alias("r"))
    return d.where(F.size("r") > 0).select(
        "doc_id", F.size("r").cast("long").alias("found"), F.col("r")[0]["start"].cast("long").alias("first_start"),
    )


@query("SELECT doc_id, coalesce(regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])'), false) AS hit FROM documents")
def match_ranges_word(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", (F.size(match_ranges(F.col("text"), Pattern("the", case_sensitive=True))) > 0).alias("hit"))


@query(f"SELECT entry_no, message FROM {ENTRY_SQL} WHERE contains(message, 'user 7') OR level = 'ERROR' OR contains((entry_no + 1)::VARCHAR, '77')")
def filter_all_columns(spark, sf_dir):
    # In every column that the table shows: here line, time, level and message.
    spec = T.FilterSpec(pattern=Pattern("user 7|ERROR|^\\d*77\\d*$", "regex", True))
    return T.apply_filter(generic_entries(spark, sf_dir), spec).select("entry_no", "message")


def sparse_entries(spark, sf_dir) -> DataFrame:
    """JSON entries with an extra key in every second, in every third and in every entry."""
    e = events(spark, sf_dir)
    line = F.to_json(F.struct(
        F.col("iso").alias("time"), F.lower("lv").alias("level"), F.col("msg").alias("message"),
        F.when(F.col("event_id") % 2 == 0, "x").alias("half"), F.when(F.col("event_id") % 3 == 0, "x").alias("third"), F.col("user_id").alias("user"),
    ))
    return entries_of_lines(as_lines(e, line), "json_lines")


FILL_SQL = """SELECT 'time' AS "column", count(ts) AS filled, count(*) AS total FROM {t} UNION ALL SELECT 'level', count(event_type), count(*) FROM {t}
UNION ALL SELECT 'extra:user', count(user_id), count(*) FROM {t} UNION ALL SELECT 'extra:half', count(*) FILTER (event_id % 2 = 0), count(*) FROM {t}
UNION ALL SELECT 'extra:third', count(*) FILTER (event_id % 3 = 0), count(*) FROM {t}"""


@query(FILL_SQL.format(t="events"))
def column_fill(spark, sf_dir):
    return T.column_fill(sparse_entries(spark, sf_dir))


@query(f"WITH f AS ({FILL_SQL.format(t='(SELECT * FROM events ORDER BY event_id LIMIT 200)')}) SELECT string_agg(c, ',' ORDER BY k) AS columns FROM (SELECT 0 AS k, 'line' AS c UNION ALL SELECT CASE \"column\" WHEN 'time' THEN 1 WHEN 'level' THEN 2 ELSE 3 + row_number() OVER (ORDER BY \"column\") END, \"column\" FROM f WHERE filled * 2 >= total UNION ALL SELECT 99, 'message')")
def infer_columns(spark, sf_dir):
    # The columns of the table that they make, as its rows would name them.
    entries = sparse_entries(spark, sf_dir)
    table = T.wide_table(entries, T.infer_columns(entries))
    named = [F.max(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c))) for c in table.columns if c not in ("source_idx", "entry_no")]
    return table.agg(F.concat_ws(",", *named).alias("columns"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS entry_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS time, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS half, user_id::VARCHAR AS \"user\" FROM events")
def wide_table(spark, sf_dir):
    columns = T.hide_columns(["line", "time", "message", "extra:half", "extra:user"], {"message"})
    return T.wide_table(sparse_entries(spark, sf_dir), columns).select(
        "entry_no", "time", F.col("`extra:half`").alias("half"), F.col("`extra:user`").alias("user"),
    )


@query("SELECT 'a.log + 3 more files' AS name, 'generic' AS format_id, count(*) AS entries, count(DISTINCT user_id % 4) AS sources FROM events")
def document_info(spark, sf_dir):
    return T.document_info(_four_sources(spark, sf_dir).entries)


# Merging -------------------------------------------------------------------------------------------------------------


def _four_sources(spark, sf_dir) -> OpenLogs:
    """Events in four sources by user; every seventh steps back by an hour."""
    e = load(spark, sf_dir, "events").withColumn(
        "t", F.col("ts") - F.when(F.col("event_id") % 7 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval 0 hour")),
    )
    line = text(F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSS"), " INFO ", "$event_id")
    name = F.concat(F.element_at(F.array(*(F.lit(x) for x in "abcd")), (user(4) + 1).cast("int")), F.lit(".log"))
    return open_lines(lines_from_df(e, F.col("event_id"), line, user(4), name), "generic")


@query("""WITH e AS (SELECT event_id, user_id % 4 AS source_idx, date_trunc('millisecond', ts) - CASE WHEN event_id % 7 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS t FROM events),
m AS (SELECT *, max(t) OVER (PARTITION BY source_idx ORDER BY event_id) AS running FROM e)
SELECT row_number() OVER (ORDER BY running, source_idx, event_id) - 1 AS merge_no, event_id::VARCHAR AS message FROM m""")
def time_merge(spark, sf_dir):
    return T.merge_numbers(T.time_merge(_four_sources(spark, sf_dir).entries)).select("merge_no", "message")


@query(SQL["time_merge"])
def merge_documents_by_time(spark, sf_dir):
    merged, timed = T.merge_documents(_four_sources(spark, sf_dir))
    assert timed
    return T.merge_numbers(merged).select("merge_no", "message")


# Sources are numbered by name; a missing name is the last.
SOURCE_SQL = "(SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS LAST) - 1 AS source_idx FROM documents)"


@query(f"SELECT source_idx::INT AS source_idx, row_number() OVER (PARTITION BY source_idx ORDER BY doc_id) - 1 AS entry_no, doc_id::VARCHAR AS message FROM {SOURCE_SQL}")
def concat_no_time(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    names = d.select("source").distinct()
    # One row for each source.
    numbered = names.withColumn("i", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("int"))
    d = d.join(numbered.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    e = entries_of_lines(lines_from_df(d, F.col("doc_id"), F.col("doc_id").cast("string"), F.col("i"), F.coalesce("source", F.lit(""))), "generic")
    merged, timed = T.merge_documents(e)
    assert not timed
    return merged.select("source_idx", "entry_no", "message")


# Values --------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS of_seconds, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS of_millis, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS of_micros FROM events")
def epoch_units(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    show = lambda c, f: F.date_format(N.time_of_value(c.cast("string")), f)
    return e.select(
        "event_id", show(F.floor(F.col("ms") / 1000), "yyyy-MM-dd HH:mm:ss").alias("of_seconds"),
        show(F.col("ms"), "yyyy-MM-dd HH:mm:ss.SSS").alias("of_millis"), show(F.col("ms") * 1000, "yyyy-MM-dd HH:mm:ss.SSS").alias("of_micros"),
    )


@query(f"SELECT event_id, {sql_case(LEVEL)} AS bracketed, {sql_case(LEVEL | {'signup': 'INFO'})} AS short, 'OTHER' AS rejected, {sql_case(LEVEL)} AS by_priority FROM events")
def normalize_levels(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id", N.normalize_level(text("[", F.lower(by_type(LEVEL)), "]: ")).alias("bracketed"), N.normalize_level(by_type(SHORT)).alias("short"),
        N.normalize_level(text(by_type(LEVEL), "/", "$user_id")).alias("rejected"), N.level_from_priority(by_type(PRIORITY)).alias("by_priority"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 12 >= 500 THEN 'ERROR' WHEN l_quantity * 12 >= 400 THEN 'WARN' ELSE 'INFO' END AS level FROM lineitem")
def http_levels(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", N.http_level((F.col("l_quantity") * 12).cast("int").cast("string")).alias("level"),
    )


# Escapes and fragments -----------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, text FROM conversations")
def strip_control_codes(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", strip_control(text("\x1b[31m", "$text", "\x1b[0m\x1b]0;title\x07\x1b(B")).alias("text"))


@query("SELECT conv_id, turn, length(role) + 1 AS start, length(text) AS length, 1 AS fg, true AS bold FROM conversations WHERE length(text) > 0")
def styled_spans(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where(F.length("text") > 0)
    raw = c.select("conv_id", "turn", text("$role", " ", "\x1b[1;31m", "$text", "\x1b[0m").alias("raw"))
    return fragments.styled_spans(raw, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "fg", "bold",
    )


@query("SELECT event_id, 'json' AS kind, 6 AS start, length(props) AS length, props AS text FROM events WHERE length(props) >= 8")
def json_snippets(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("props "), "props", F.lit(" end")).alias("message"))
    return fragments.extract_snippets(e, ["event_id"])


@query()
def xml_snippets(spark, sf_dir):
    return fragments.extract_snippets(load(spark, sf_dir, "pages"), ["page_id"], "html")


@query("SELECT token, (count(*) * CASE token WHEN 'Punctuation' THEN 3 ELSE 1 END)::BIGINT AS n FROM events, (VALUES ('Key'), ('Number'), ('Punctuation')) AS t(token) WHERE length(props) >= 8 GROUP BY token")
def snippet_token_counts(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.col("props").alias("message"))
    return fragments.snippet_tokens(fragments.extract_snippets(e, ["event_id"]), ["event_id"]).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# Files and streams ---------------------------------------------------------------------------------------------------


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS entry_no, 'doc ' || doc_id || chr(9) || 'INFO' AS head, 'doc ' || doc_id || ' ' || replace(text, chr(10), ' ') AS value FROM {DOCUMENTS}")
def export_flat_tsv(spark, sf_dir):
    e = entries_of_lines(document_lines(spark, sf_dir), "generic")
    flat = T.text_rows(e, ["message"], flat=True)
    head = T.text_rows(
        e.withColumn("message", F.regexp_extract("message", r"^doc \d+", 0)), ["message", "level"], flat=True,
    ).select("entry_no", F.col("value").alias("head"))
    return flat.join(head, "entry_no").select("entry_no", "head", "value")


def event_files(spark, sf_dir) -> str:
    """Events as generic log text in files, in the order of event_id inside each."""
    folder = new_folder(spark, "logs")
    e = events(spark, sf_dir)
    e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(text("$clock", " ", "$lv", " ", "$msg").alias("value")).write.text(folder)
    return folder


@query(SQL["level_counts_generic"])
def read_log_files(spark, sf_dir):
    return T.level_counts(read_logs(spark, [event_files(spark, sf_dir)]))


@query(f"SELECT entry_no, level, message || chr(10) || '  at ' || user_id AS message FROM {ENTRY_SQL}")
def read_logs_split_otherwise(spark, sf_dir):
    # One file, opened with some splits and asked for entries with others.
    folder, key = new_folder(spark, "one-log"), "spark.sql.files.maxPartitionBytes"
    e = events(spark, sf_dir).select(F.lit("all.log").alias("name"), F.col("event_id").alias("at"), text("$clock", " ", "$lv", " ", "$msg", "\n  at ", "$user_id").alias("value"))
    named_files(spark, e, folder)
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        entries = read_logs(spark, [folder])
    finally:
        spark.conf.set(key, before)
    return entries.select("entry_no", "level", "message")


@query("SELECT entry_no, first_start, length(message) AS chars, spans FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS entry_no, 5 AS first_start, 'user ' || user_id || chr(10) || 'did ' || event_type AS message, 2::BIGINT AS spans FROM events)")
def styled_spans_of_files(spark, sf_dir):
    # A style begins in an entry's first line and holds over the line's end; another begins in the second.
    folder = new_folder(spark, "styled")
    e = events(spark, sf_dir).select(
        F.lit("all.log").alias("name"), F.col("event_id").alias("at"), text("$clock", " \x1b[2m", "$lv", "\x1b[0m user \x1b[1;31m", "$user_id", "\ndid\x1b[32m ", "$event_type", "\x1b[0m").alias("value"),
    )
    named_files(spark, e, folder)
    entries = read_logs(spark, [folder], styles=True)
    spans = fragments.entry_spans(entries).groupBy("entry_no").agg(F.min("start").alias("first_start"), F.max(F.col("start") + F.col("length")).alias("chars"), F.count(F.lit(1)).alias("spans"))
    return spans.select("entry_no", F.col("first_start").cast("int").alias("first_start"), F.col("chars").cast("long").alias("chars"), "spans")


@query("SELECT count(*) AS lines, count(*) AS distinct_places, 'UTF-8' AS encoding FROM events")
def scan_numbered_lines(spark, sf_dir):
    lines = scan_lines(spark, [event_files(spark, sf_dir)], max_lines=0)
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("source_idx", "line_no").alias("distinct_places"), F.max("encoding").alias("encoding"),
    )


def stream_rows(spark, stream: DataFrame, mode: str, ends: bool = True, state: str | None = None, bounded: bool = False) -> DataFrame:
    """What a stream has put out, as Parquet, when all that is there is read. state: a folder in which the stream goes on later. bounded: the
    stream is of follow.tail with its progress noted, so what is there comes in many batches, where the trigger availableNow has one."""
    state = state or new_folder(spark, "stream")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", follow.STORE)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{state}/checkpoint")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{state}/rows")
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{state}/rows"))
    ends, key = ends and not bounded, "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        # State is by file, so tasks beyond the cores would only start and end in every batch.
        spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
        q = (writer.trigger(availableNow=True) if ends else writer.trigger(processingTime=follow.POLL)).start()
    finally:
        spark.conf.set(key, before)
    try:
        # A batch that begins where it ends found nothing new; a query's first one may repeat what was begun before it was last ended.
        while bounded and not (len(done := q.recentProgress) > 1 and all(x["startOffset"] == x["endOffset"] for x in done[-1]["sources"])):
            # An error ends the waiting.
            if q.awaitTermination(0.2):
                raise RuntimeError("the stream ended before all was read")
        if not bounded:
            q.awaitTermination() if ends else q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{state}/rows")


@query(SQL["level_counts_generic"].replace("LEFT JOIN", "JOIN"))
def stream_level_counts(spark, sf_dir):
    entries = follow.line_entries(follow.landed_lines(spark, event_files(spark, sf_dir)), "generic")
    found = stream_rows(spark, follow.running_level_counts(entries), "complete")
    return found.select(F.col("level_idx").cast("int").alias("level_idx"), "level", F.col("n").cast("long").alias("n"))


@query(f"SELECT level, message FROM {ENTRY_SQL} WHERE level = 'ERROR' AND contains(message, '7')")
def tail_filtered(spark, sf_dir):
    folder = event_files(spark, sf_dir)
    entries = follow.line_entries(follow.tail(spark, f"{folder}/part-*.txt"), "generic")
    spec = T.FilterSpec(frozenset(["ERROR"]), pattern=Pattern("7", "regex"), columns=("message",))
    return stream_rows(spark, T.apply_filter(entries, spec).select("level", "message"), "append", ends=False)


def named_files(spark, rows: DataFrame, folder: str) -> None:
    """Rows (name, at, value) as one file for each name, in the order of at, put in the place of what has the name. Rows are sorted in ranges
    by all tasks; the task of a name only appends the bytes of its ranges."""
    made = new_folder(spark, "made")
    rows.repartitionByRange("name", "at").sortWithinPartitions("name", "at").select("name", "value").write.partitionBy("name").text(made)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda *x: jvm.org.apache.hadoop.fs.Path("/".join(x))
    system = path(made).getFileSystem(conf)
    system.mkdirs(path(folder))
    parts: dict[str, list[str]] = {}
    for found in system.globStatus(path(made, "name=*", "part-*")):
        part = found.getPath().getName()
        parts.setdefault(found.getPath().getParent().getName(), []).append(part)
    in_order = [(name, sorted(own, key=lambda x: (int(x.split("-")[1]), x))) for name, own in sorted(parts.items())]
    joined = spark.createDataFrame(in_order, "name string, parts array<string>").repartition(len(in_order), "name").mapInArrow(_appended(made), "name string, path string")
    for name, whole in joined.collect():
        to = path(folder, name.removeprefix("name="))
        system.delete(to, False)
        system.rename(path(whole), to)


def _appended(made: str):
    """Files of names (name, parts: names of files in its folder) from the bytes of their parts, in blocks; each by a name of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = f"{made}/whole-{uuid.uuid4().hex}"
                system, at = follow.file_system(whole)
                with system.open_output_stream(at) as out:
                    for part in parts:
                        with system.open_input_stream(follow.file_system(f"{made}/{name}/{part}")[1]) as f:
                            while block := f.read(4 << 20):
                                out.write(block)
                yield pa.record_batch([pa.array([name]), pa.array([whole])], names=["name", "path"])

    return run


@query("SELECT l.level_idx, l.level, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'FATAL' ELSE 'INFO' END AS level FROM events WHERE user_id % 4 < 2 AND event_id % 2 = 0 "
       f"UNION ALL SELECT {sql_case(LEVEL)} FROM events WHERE user_id % 4 >= 2) e JOIN {LEVEL_ROWS} ON l.level = e.level GROUP BY l.level_idx, l.level")
def stream_counts_after_rotation(spark, sf_dir):
    # Four files are followed; then two of them are replaced by others, and the stream goes on where it stood.
    folder, state = new_folder(spark, "rotated"), new_folder(spark, "stream")
    e = events(spark, sf_dir).select("event_id", F.concat(F.lit("app"), user(4).cast("string"), F.lit(".log")).alias("name"), F.col("event_id").alias("at"), "clock", "lv", "msg", user(4).alias("u"))
    # The last entry of a file stays open, so each file ends with one that does not count.
    last = e.groupBy("name").agg(F.max("at").alias("at")).select("name", F.col("at") + 1, F.lit("2024-01-01 00:00:00.000 INFO open").alias("value"))
    named_files(spark, e.select("name", "at", text("$clock", " ", "$lv", " ", "$msg", "\n  more of it").alias("value")).union(last), folder)
    changes = lambda: follow.level_changes(follow.follow_entries(follow.tail(spark, folder + "/app*.log", progress=state + "-progress"), "generic", 3_600_000))
    stream_rows(spark, changes(), "append", state=state, bounded=True)
    new = e.where("u < 2 AND event_id % 2 = 0").select("name", "at", text("$clock", F.when(F.col("event_id") % 3 == 0, " FATAL").otherwise(" INFO"), " replaced").alias("value"))
    named_files(spark, new.union(last.where("name in ('app0.log', 'app1.log')")), folder)
    return follow.counts_of_changes(stream_rows(spark, changes(), "append", state=state, bounded=True)).select(
        F.col("level_idx").cast("int").alias("level_idx"), "level", "n",
    )


@query(f"SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 2 AS physical_lines, length('doc ' || doc_id || chr(10) || text) AS chars FROM {DOCUMENTS}")
def stream_folded_documents(spark, sf_dir):
    folder = new_folder(spark, "documents")
    shown = F.regexp_replace(strip_control(F.coalesce("text", F.lit(""))), "\r", "")
    d = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.pmod("doc_id", F.lit(8)).cast("string"), F.lit(".log")).alias("name"), F.col("doc_id").alias("at"),
        text("2024-01-01 00:00:00 INFO doc ", "$doc_id", "\n", shown).alias("value"),
    )
    last = d.groupBy("name").agg(F.max("at").alias("at")).select("name", F.col("at") + 1, F.lit("2024-01-01 00:00:00 INFO open").alias("value"))
    named_files(spark, d.union(last), folder)
    lines = follow.tail(spark, folder + "/d*.log", progress=new_folder(spark, "progress"))
    e = stream_rows(spark, follow.follow_entries(lines, "generic", 3_600_000), "append", bounded=True)
    return e.select(
        F.regexp_extract("message", r"^doc (\d+)", 1).cast("long").alias("doc_id"), F.col("physical_lines").cast("long").alias("physical_lines"),
        F.length("message").cast("long").alias("chars"),
    )


@query(SQL["read_event_xml_files"])
def follow_event_xml(spark, sf_dir):
    # Two events on a line, each of which goes on in the next line; a file's last event stays open.
    folder = new_folder(spark, "event-xml-tail")
    e = _event_xml(spark, sf_dir).select(F.concat(F.lit("e"), user(4).cast("string"), F.lit(".xml")).alias("name"), F.col("event_id").alias("at"), F.replace("xml", F.lit("<EventData>"), F.lit("\n<EventData>")).alias("xml"))
    last = e.groupBy("name").agg(F.max("at").alias("at")).select("name", (F.col("at") + 1).alias("at"), F.lit("<Event open").alias("value"))
    pairs = e.groupBy("name", F.floor(F.col("at") / 8).alias("k")).agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "xml"))).alias("x"))
    rows = pairs.select("name", "at", F.array_join(F.transform("x", lambda x: F.concat(x["xml"], F.lit("</Event>"))), "").alias("value"))
    named_files(spark, rows.union(last), folder)
    lines = follow.tail(spark, f"{folder}/e*.xml", progress=new_folder(spark, "progress"))
    return shown(stream_rows(spark, follow.follow_entries(lines, "wevt_xml", 3_600_000), "append", bounded=True)).drop("entry_no")


@query("SELECT 'user ' || user_id || ' did ' || event_type AS line FROM events")
def tail_unfinished_lines(spark, sf_dir):
    # What follows the last line end of a file is no line yet: here a bar, which stands before every line but the first.
    folder = new_folder(spark, "unfinished")
    events(spark, sf_dir).select(F.concat("msg", F.lit("\n")).alias("value")).repartition(4).write.option("lineSep", "|").text(folder)
    return stream_rows(spark, follow.tail(spark, f"{folder}/part-*.txt").select(F.regexp_replace("raw", r"^\|", "").alias("line")), "append")


# Limits, encodings, sinks --------------------------------------------------------------------------------------------


@query("SELECT (user_id % 4)::INT AS source_idx, least(count(*), 50) AS lines, count(*) >= 50 AS truncated FROM events GROUP BY 1")
def limit_lines(spark, sf_dir):
    folder = new_folder(spark, "by-user")
    e = events(spark, sf_dir).select("event_id", user(4).alias("u"), "msg").repartition("u").sortWithinPartitions("event_id")
    e.select("u", F.col("msg").alias("value")).write.partitionBy("u").text(folder)
    lines = scan_lines(spark, [f"{folder}/u={u}" for u in range(4)], max_lines=50)
    return lines.groupBy("source_idx").agg(F.count(F.lit(1)).alias("lines"), F.max("truncated").alias("truncated"))


ENCODINGS = ["UTF-16LE", "UTF-16BE", "GB18030"]


def encoded_files(spark, sf_dir) -> list[str]:
    """Events as text in a folder for each of ENCODINGS."""
    legacy_charsets(spark)
    out = []
    for name in ENCODINGS:
        out.append(new_folder(spark, "encoded"))
        rows = events(spark, sf_dir).select(F.concat(F.lit("用户 "), "msg").alias("value"))
        rows.write.option("encoding", name).option("quote", "").csv(out[-1])
    return out


@query("SELECT encoding, count(*) AS lines, sum(length('用户 user ' || user_id || ' did ' || event_type)) AS chars, count(*) AS marked FROM events, (VALUES " + ", ".join(f"('{x}')" for x in ENCODINGS) + ") AS t(encoding) GROUP BY encoding")
def decode_lines(spark, sf_dir):
    lines = scan_lines(spark, encoded_files(spark, sf_dir))
    return lines.groupBy("encoding").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text").startswith("用户 user ")).alias("marked"),
    )


@query("SELECT 'generic' AS format_id, count(*) AS entries, sum(length(strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ' || " + sql_case(LEVEL) + " || ' user ' || user_id || ' did ' || event_type) + 1)::BIGINT AS bytes, 'UTF-8' AS encoding, false AS truncated FROM events")
def document_facts(spark, sf_dir):
    heads = read_heads(spark, [event_files(spark, sf_dir)])
    entries = entries_of_lines(scan_lines(spark, heads).drop("truncated"), "generic")
    return T.document_info(entries, document_sizes(heads)).select("format_id", "entries", "bytes", "encoding", "truncated")


@query(f"SELECT doc_id, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n + 1 AS first_line FROM (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 2 AS n FROM {DOCUMENTS})")
def first_lines(spark, sf_dir):
    e = entries_of_lines(document_lines(spark, sf_dir), "generic")
    return e.select(F.regexp_extract("message", r"^doc (\d+)", 1).cast("long").alias("doc_id"), "first_line")


@query(
    "SELECT event_id, strftime(CASE WHEN t >= DATE '2024-07-02' THEN t - INTERVAL 1 YEAR ELSE t END, '%Y-%m-%d %H:%M:%S') AS time "
    "FROM (SELECT event_id, date_trunc('second', ts) + to_days((event_id % 300)::INT) AS t FROM events)"
)
def year_rollover(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("t", F.col("ts") + F.make_dt_interval((F.col("event_id") % 300).cast("int")))
    line = text(F.date_format("t", "MMM dd HH:mm:ss"), " host shop[1]: ", "$event_id")
    entries = entries_of_lines(lines_from_df(e, F.col("event_id"), line), "syslog3164", reference=date(2024, 6, 30))
    return entries.select(F.col("message").cast("long").alias("event_id"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"))


def half_timed(spark, sf_dir) -> DataFrame:
    """JSON entries, of which every fifth has no time."""
    e = events(spark, sf_dir)
    line = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.col("iso")).alias("time"), F.col("event_id").cast("string").alias("message")))
    return entries_of_lines(as_lines(e, line), "json_lines")


@query(f"SELECT event_id::VARCHAR AS message FROM events WHERE event_id % 5 = 0 OR date_trunc('millisecond', ts) BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'")
def filter_with_untimed(spark, sf_dir):
    return T.apply_filter(half_timed(spark, sf_dir), T.FilterSpec(start=FROM, end=TO, include_untimed=True)).select("message")


@query("SELECT preset, event_id::VARCHAR AS message FROM events, (VALUES ('today', 720), ('90m', 90)) AS p(preset, minutes) WHERE event_id % 5 <> 0 AND date_trunc('millisecond', ts) " f"BETWEEN TIMESTAMP '{TO}' - to_minutes(minutes) AND TIMESTAMP '{TO}'")
def filter_presets(spark, sf_dir):
    out = None
    for name in ("today", "90m"):
        first, last = T.time_preset(name, TO)
        rows = T.apply_filter(half_timed(spark, sf_dir), T.FilterSpec(start=first, end=last)).select(F.lit(name).alias("preset"), "message")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT event_id, 'xml' AS kind, 5 AS start, length(x) AS length, x AS text FROM (SELECT event_id, '<e id=\"' || event_id || '\"><kind>' || event_type || '</kind><br/></e>' AS x FROM events)")
def xml_snippets_of_events(spark, sf_dir):
    x = text('<e id="', "$event_id", '"><kind>', "$event_type", "</kind><br/></e>")
    return fragments.extract_snippets(
        load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("got: "), x, F.lit(" < 3")).alias("message")), ["event_id"],
    )


@query("SELECT event_id, 'yaml' AS kind, 7 AS start, length(x) AS length, x AS text FROM (SELECT event_id, 'user: ' || user_id || chr(10) || 'kind: ' || event_type || chr(10) || '- item of a list' AS x FROM events)")
def yaml_snippets_of_events(spark, sf_dir):
    x = text("user: ", "$user_id", "\nkind: ", "$event_type", "\n- item of a list")
    return fragments.extract_snippets(
        load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("report\n"), x, F.lit("\nthat is all")).alias("message")), ["event_id"],
    )


@query("SELECT token, (count(*) * n)::BIGINT AS n FROM events, (VALUES ('TagName', 5), ('Key', 1), ('AttributeValue', 1), ('Punctuation', 10)) AS t(token, n) GROUP BY token, n")
def xml_token_counts(spark, sf_dir):
    return fragments.snippet_tokens(xml_snippets_of_events(spark, sf_dir), ["event_id"]).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT token, (count(*) * n)::BIGINT AS n FROM events, (VALUES ('Key', 2), ('Number', 1), ('Punctuation', 3)) AS t(token, n) GROUP BY token, n")
def yaml_token_counts(spark, sf_dir):
    return fragments.snippet_tokens(yaml_snippets_of_events(spark, sf_dir), ["event_id"]).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 4::BIGINT AS fragments, 3 AS first_start FROM events")
def snippet_budget(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("6: "), F.repeat(text('{"user": ', "$user_id", "} "), F.lit(6))).alias("message"),
    )
    return fragments.extract_snippets(e, ["event_id"]).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("fragments"), F.min("start").alias("first_start"),
    )


@query("SELECT (row_number() OVER (ORDER BY event_id))::VARCHAR AS line, " + sql_case(LEVEL) + " AS level, 'user \"' || user_id || '\", did' || chr(10) || event_type AS message FROM events")
def export_csv(spark, sf_dir):
    lines = as_lines(events(spark, sf_dir), text("$clock", " ", "$lv", ' user "', "$user_id", '", did\n', "$event_type"))
    folder = new_folder(spark, "csv")
    entries = entries_of_lines(lines, "generic").withColumn("first_line", F.col("entry_no") + 1)
    T.write_csv(entries, ["line", "level", "message"], folder)
    return spark.read.csv(
        folder, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).select("line", "level", "message")


@query("SELECT " + sql_case(LEVEL) + " || chr(9) || 'user ' || user_id || ' did ' || event_type AS value FROM events")
def export_text(spark, sf_dir):
    folder = new_folder(spark, "text")
    T.write_text(generic_entries(spark, sf_dir), ["level", "message"], folder)
    return spark.read.text(folder)
