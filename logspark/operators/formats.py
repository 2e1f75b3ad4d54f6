"""The sixteen log formats and the registry.

A format says how a line is recognised, whether it starts an entry, and how an entry's first line (or all its lines)
becomes fields. Everything is a Column expression; a format that learns from the head of a file (CSV header, IIS field
list, whether a plain log is anchored at all) finds it in the columns that its learn() adds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions import normalize as N

# The formats' line patterns, groups by number, and what they are made of.
LEVEL = "TRACE|TRC|VERBOSE|VRB|DEBUG|DBG|INFO|INF|NOTICE|WARN|WARNING|WRN|ERROR|ERR|SEVERE|CRITICAL|CRIT|FATAL|FTL"
ZONE = r"(?:Z|[+-]\d{2}:?\d{2})"
STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
TRACING = rf"^(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?{ZONE})\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+(?:(\S+)\s+)?ThreadId\((\d+)\)\s+(.*?):\s(.*)$"
SYSLOG5424 = r"^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(?:\[([^\]]*)\]\s*)?(.*)$"
SYSLOG3164 = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\s:\[\]]+)(?:\[(\d+)\])?:\s?(.*)$"
PYTHON = rf"^({STAMP}(?:[.,]\d{{1,6}})?)\s*[-–]\s*({LEVEL})\s*[-–:]\s*(?:([\w.\-]+)\s*[-–:]\s*)?(.*)$"
SERILOG = rf"^({STAMP}(?:[.,]\d{{1,6}})?(?:\s*{ZONE})?)\s*\[(VRB|DBG|INF|WRN|ERR|FTL)\]\s*(.*)$"
SERILOG_CLOCK = r"^\[(\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?)\s+(VRB|DBG|INF|WRN|ERR|FTL)\]\s*(.*)$"
LOG4J = rf"^({STAMP}(?:[.,]\d{{1,6}})?)\s+\[([^\]]*)\]\s*({LEVEL})\s+([\w.$]+)\s*[-:]\s*(.*)$"
GENERIC_TIME = rf"^\s*({STAMP}(?:[.,]\d{{1,9}})?{ZONE}?)\s+(.*)$"
GENERIC_SYSLOG = r"^\s*([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(.*)$"
ANCHORS = rf"{GENERIC_TIME}|{GENERIC_SYSLOG}"
#: The generic patterns in one: time, then level and message, or a level that begins the message and the rest of it, or only a
#: message; or syslog time and message.
GENERIC = (
    rf"^\s*(?:({STAMP}(?:[.,]\d{{1,9}})?{ZONE}?)\s+(?:\[?\(?({LEVEL}|ALERT|EMERG)\)?\]?\s*[:\-]?\s+(.*)|\[?({LEVEL}|ALERT|EMERG)\]?\s*[:\-]\s*(.*)|(.*))"
    r"|([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(.*))$"
)
PAIR = r'([A-Za-z_][\w.\-]*)=("([^"]*)"|\S*)'
FIELD = r"^\s*([A-Za-z][A-Za-z0-9_]*)\s*:\s?(.*)$"
TIME_CREATED = r"^\s*TimeCreated\s*:"
EVENT_LEVEL = r"(?iu)^\s*(信息|警告|错误|严重|详细|成功|Information|Warning|Error|Critical|Verbose)\s*(\t|$)"
EVENT_HEADER = ["级别", "Level", "日期和时间", "Date and Time", "来源", "Source", "事件 ID", "Event ID"]
NO_TASK = ["", "-", "无", "none"]
CSV_DELIMITERS = [",", ";", "\t", "|"]
CSV_NAME = r"^[A-Za-z_][\w .\-]*$"

Fields = dict[str, Column]


def no_extra() -> Column:
    return F.create_map().cast("map<string,string>")


def extra(pairs: dict[str, Column]) -> Column:
    """A map of the pairs whose values are not empty."""
    return F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), N.or_empty(v)))), lambda _, v: v != "")


#: Stands between groups; lines hold no control characters.
MARK = "\x01"


def groups(text: Column, pattern: str) -> Column:
    """All groups of a pattern that matches the whole text, by one match; the text alone if it does not match."""
    return F.split(F.regexp_replace(text, pattern, MARK.join(f"${k}" for k in range(1, re.compile(pattern).groups + 1))), MARK, -1)


def fits(pattern: str) -> Column:
    """Whether m are the groups of the pattern."""
    return F.size("m") == re.compile(pattern).groups


def g(k: int) -> Column:
    """Group k of m."""
    return F.get("m", F.lit(k - 1))


@dataclass(frozen=True)
class FormatSpec:
    """One format. fields() maps the columns text (an entry's first line), lines (all of them), m (what match() makes of them,
    computed once), reference (a date) and those that learn adds to: time, raw_level, level (default: the raw level normalized), thread, target, host, pid, extra,
    message, all of them optional but message; parsed is false where a line is not of the format."""

    id: str
    name: str
    fields: Callable[[], Fields]
    starts: Callable[[], Column]
    #: Share of sample lines that fit, for formats whose score is that.
    line_probe: Callable[[Column], Column] | None = None
    match: Callable[[], Column] | None = None
    #: The score of a file by sample, the array of its first lines; by default the share of lines that fit line_probe.
    score: Callable[[], Column] | None = None
    #: Columns that the parser needs to know of a file, by sample.
    learn: Callable[[], Fields] | None = None
    sequential: bool = False
    #: The fields use all lines, so continuations are not appended to the message.
    block: bool = False


def by_pattern(id: str, name: str, pattern: str, fields: Callable[[], Fields]) -> FormatSpec:
    return FormatSpec(
        id, name, lambda: fields() | {"parsed": fits(pattern)}, lambda: F.col("text").rlike(pattern), lambda text: text.rlike(pattern),
        lambda: groups(F.col("text"), pattern),
    )


def _tracing() -> Fields:
    thread = F.when(g(3) != "", g(3)).otherwise(F.concat(F.lit("ThreadId("), g(4), F.lit(")")))
    return {"time": N.parse_time(g(1)), "raw_level": g(2), "thread": thread, "target": g(5), "extra": extra({"ThreadId": g(4)}), "message": g(6)}


def _syslog5424() -> Fields:
    dash = lambda c: F.when(c == "-", "").otherwise(c)
    return {
        "time": N.parse_time(g(3), F.col("reference")), "raw_level": g(1), "level": N.level_from_priority(g(1).try_cast("int") % 8),
        "host": dash(g(4)), "target": dash(g(5)), "pid": dash(g(6)), "extra": extra({"MsgId": dash(g(7)), "SD": g(8)}), "message": g(9),
    }


def _syslog3164() -> Fields:
    colon = F.instr(g(5), ":")
    prefix = F.substring(g(5), F.lit(1), colon - 1)
    leveled = g(5).rlike("^[A-Z]") & (colon >= 2) & (colon <= 11) & (N.normalize_level(prefix) != "OTHER")
    message = F.when(leveled, F.trim(F.substring(g(5), colon + 1, F.length(g(5))))).otherwise(g(5))
    return {
        "time": N.parse_time(g(1), F.col("reference")), "raw_level": F.when(leveled, prefix).otherwise(""), "host": g(2), "target": g(3), "pid": g(4),
        "message": message,
    }


def json_map(text: Column) -> Column:
    """A JSON object as a map of texts, nested values as compact JSON; NULL if the line is none."""
    return F.when(F.trim(text).startswith("{"), F.from_json(F.trim(text), "map<string,string>"))


def _json() -> Fields:
    m, raw = F.col("m.all"), F.col("m.level")
    known = [k.lower() for keys in (N.TIME_KEYS, N.LEVEL_KEYS, N.MESSAGE_KEYS, N.HOST_KEYS, N.PID_KEYS, N.TARGET_KEYS) for k in keys]
    rest = F.map_filter(m, lambda k, v: ~F.lower(k).isin(known) & ~k.startswith("_") & (F.length(N.or_empty(v)) <= N.LONGEST_EXTRA))
    level = F.when(raw.rlike(r"^\d+$"), N.level_from_priority(raw.try_cast("int"))).otherwise(N.normalize_level(raw))
    return {
        "parsed": m.isNotNull(), "time": N.time_of_value(F.col("m.stamp"), F.col("reference")), "raw_level": raw, "level": level, "host": F.col("m.host"), "pid": F.col("m.pid"),
        "target": F.col("m.target"), "extra": F.coalesce(
            F.transform_values(rest, lambda _, v: N.or_empty(v)), no_extra(),
        ), "message": F.col("m.message"),
    }


def _json_match() -> Column:
    """The object, and its values that have columns of their own."""
    keys = {"stamp": N.TIME_KEYS, "level": N.LEVEL_KEYS, "host": N.HOST_KEYS, "pid": N.PID_KEYS, "target": N.TARGET_KEYS, "message": N.MESSAGE_KEYS}
    return N.let(json_map(F.col("text")), lambda m: F.struct(m.alias("all"), *(N.first_key(m, k).alias(name) for name, k in keys.items())))


def _json_starts() -> Column:
    return json_map(F.col("text")).isNotNull()


def _json_probe(text: Column) -> Column:
    return F.coalesce(~F.map_contains_key(json_map(text), F.lit("__REALTIME_TIMESTAMP")), F.lit(False))


def _journal_probe(text: Column) -> Column:
    m = json_map(text)
    return F.coalesce(F.map_contains_key(m, F.lit("MESSAGE")) & F.map_contains_key(m, F.lit("PRIORITY")), F.lit(False))


def _logfmt_match() -> Column:
    """The pairs as a map, and how many characters they take."""
    text = F.col("text")
    whole = F.regexp_extract_all(text, F.lit(f"({PAIR})"), 1)
    consumed = F.aggregate(whole, F.lit(0), lambda a, w: a + F.length(w))
    value = lambda w: F.regexp_replace(F.substring(w, F.instr(w, "=") + 1, F.length(w)), '^"([^"]*)"$', "$1")
    pairs = F.map_from_entries(F.transform(whole, lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), value(w).alias("value"))))
    return F.struct(pairs.alias("pairs"), consumed.alias("consumed"))


def _logfmt() -> Fields:
    text, pairs, consumed = F.col("text"), F.col("m.pairs"), F.col("m.consumed")
    # The first key of each list is consumed, so the next list can't see it.
    keys = [N.TIME_KEYS, N.LEVEL_KEYS, N.MESSAGE_KEYS, N.HOST_KEYS, N.PID_KEYS, N.TARGET_KEYS]
    taken = [F.coalesce(*(F.when(F.map_contains_key(pairs, F.lit(k)), F.lit(k)) for k in ks), F.lit("")) for ks in keys]
    at = lambda k: N.or_empty(F.try_element_at(pairs, taken[k]))
    trimmed = F.trim(text)
    rest = F.when(consumed * 100 < F.length(trimmed) * 50, F.trim(F.substring(trimmed, consumed + 1, F.length(trimmed)))).otherwise("")
    message = F.trim(F.concat_ws(" ", F.filter(F.array(at(2), rest), lambda x: x != "")))
    return {
        "parsed": F.size(pairs) > 0, "time": N.time_of_value(at(0), F.col("reference")), "raw_level": at(1), "host": at(3), "pid": at(4),
        "target": at(5), "extra": F.map_filter(pairs, lambda k, _: ~F.array_contains(F.array(*taken), k)),
        "message": F.when(message == "", trimmed).otherwise(message),
    }


def _logfmt_probe(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"(^|\s)[A-Za-z_][\w.\-]*=")) >= 2) & text.rlike("level=|msg=|time=|ts=")


def csv_cells(text: Column) -> Column:
    """Cells by the file's delimiter."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for d in CSV_DELIMITERS:
        out = out.when(F.col("csv_delimiter") == d, N.split_cells(text, d))
    return out


def _csv_match() -> Column:
    """The cells with their column's name, also in lower case."""
    header = F.transform("csv_header", lambda h: F.trim(h))
    cells = F.zip_with(
        header, F.transform(csv_cells(F.col("text")), lambda c: F.trim(c)), lambda h, v: F.struct(h.alias("h"), F.lower(h).alias("l"), v.alias("v")),
    )
    return F.filter(cells, lambda c: c["h"].isNotNull() & c["v"].isNotNull())


def _csv() -> Fields:
    cells = F.col("m")
    named = F.filter(cells, lambda c: c["h"] != "")
    pick = lambda test, last=False: N.or_empty(F.try_element_at(
        F.transform(F.filter(named, lambda c: test(c["l"])), lambda c: c["v"]), F.lit(-1 if last else 1),
    ))
    is_time = lambda n: n.contains("time") | (n == "date")
    is_level = lambda n: n.contains("level") | n.contains("severity")
    is_message, is_host = (lambda n: n.isin("message", "msg", "eventdata")), (lambda n: n.isin("host", "hostname"))
    is_pid, is_target = (lambda n: n.isin("pid", "processid")), (lambda n: n.isin("logger", "target", "source", "providername"))
    date_at = F.array_position(F.transform(cells, lambda c: c["l"]), "date")
    joined = F.concat_ws(" ", F.try_element_at(cells, date_at.cast("int"))["v"], F.try_element_at(cells, (date_at + 1).cast("int"))["v"])
    # The first readable time cell; a date cell reads together with the cell after it.
    times = F.transform(F.filter(named, lambda c: c["l"].contains("time")), lambda c: N.time_of_value(c["v"], F.col("reference")))
    time = F.coalesce(
        F.when(date_at > 0, N.time_of_value(joined, F.col("reference"))), F.try_element_at(F.filter(times, lambda t: t.isNotNull()), F.lit(1)),
    )
    other = F.filter(
        named,
        lambda c: ~(is_time(c["l"]) | is_level(c["l"]) | is_message(c["l"]) | is_host(c["l"]) | is_pid(c["l"]) | is_target(c["l"])) & (F.length(c["v"]) <= N.LONGEST_EXTRA),
    )
    message = pick(is_message)
    every = F.concat_ws(" ", F.transform(cells, lambda c: F.concat(c["h"], F.lit("="), c["v"])))
    return {
        "parsed": _csv_starts(), "time": time, "raw_level": pick(is_level, True), "host": pick(is_host, True), "pid": pick(is_pid, True),
        "target": pick(is_target, True),
        "extra": F.map_from_entries(F.transform(other, lambda c: F.struct(c["h"].alias("key"), c["v"].alias("value")))),
        "message": F.when(message == "", every).otherwise(message),
    }


def _csv_starts() -> Column:
    return F.coalesce((F.trim("text") != "") & (F.col("text") != F.col("csv_header_line")), F.lit(False))


def _python() -> Fields:
    return {"time": N.parse_time(g(1)), "raw_level": g(2), "target": g(3), "message": g(4)}


def _serilog_match() -> Column:
    """The groups of either pattern; they have the same three."""
    full = groups(F.col("text"), SERILOG)
    return F.when(F.size(full) > 1, full).otherwise(groups(F.col("text"), SERILOG_CLOCK))


def _serilog() -> Fields:
    return {"parsed": fits(SERILOG), "time": N.parse_time(g(1), F.col("reference")), "raw_level": g(2), "message": g(3)}


def _serilog_line(text: Column) -> Column:
    return text.rlike(SERILOG) | text.rlike(SERILOG_CLOCK)


def _log4j() -> Fields:
    return {"time": N.parse_time(g(1)), "raw_level": g(3), "thread": g(2), "target": g(4), "message": g(5)}


def _event_text_match() -> Column:
    """Of each line the field, its value and the trimmed line."""
    return F.transform(
        "lines", lambda x: F.struct(F.regexp_extract(x, FIELD, 1).alias("f"), F.regexp_extract(x, FIELD, 2).alias("v"), F.trim(x).alias("t")),
    )


def _event_text() -> Fields:
    fields = F.col("m")
    value = lambda *names: N.or_empty(F.try_element_at(
        F.transform(F.filter(fields, lambda c: F.lower(c["f"]).isin([n.lower() for n in names])), lambda c: c["v"]), F.lit(-1),
    ))
    parts = F.aggregate(
        fields, F.array().cast("array<string>"), lambda a,
        c: F.when((F.lower(c["f"]) == "message") & (c["v"] != ""), F.array_append(a, c["v"])).when(
            (c["f"] == "") & (c["t"] != "") & (F.size(a) > 0), F.array_append(a, c["t"]),
        ).otherwise(a),
    )
    known = ["timecreated", "leveldisplayname", "level", "providername", "message", "processid", "machinename", ""]
    rest = F.filter(fields, lambda c: ~F.lower(c["f"]).isin(known) & (c["v"] != "") & (F.length(c["v"]) <= N.LONGEST_EXTRA))
    return {
        "time": N.parse_time(value("TimeCreated")), "raw_level": value("LevelDisplayName", "Level"), "target": value("ProviderName"),
        "pid": value("ProcessId"), "host": value("MachineName"),
        "extra": F.map_from_entries(F.transform(rest, lambda c: F.struct(c["f"].alias("key"), c["v"].alias("value")))),
        "message": F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.array_join("lines", "\n")),
    }


def _event_tsv() -> Fields:
    cells = F.col("m")
    cell = lambda k: F.trim(N.or_empty(F.try_element_at(cells, F.lit(k))))
    first = F.trim(F.array_join(F.slice(cells, 6, 1_000_000), " "))
    more = F.array_join(F.slice(F.col("lines"), 2, 2_147_483_646), "\n")
    whole = F.regexp_replace(F.concat(F.regexp_replace(first, '^"', ""), F.lit("\n"), more), '"$', "")
    task = F.when(F.lower(cell(5)).isin(NO_TASK), "").otherwise(cell(5))
    return {
        "parsed": _event_tsv_starts(), "time": N.parse_time(cell(2)), "raw_level": cell(1), "target": cell(3),
        "extra": extra({"Event ID": cell(4), "Task": task}), "message": F.when(F.size("lines") > 1, whole).otherwise(first),
    }


def _event_tsv_starts() -> Column:
    return (F.regexp_count("text", F.lit("\t")) >= 4) & F.col("text").rlike(EVENT_LEVEL)


def _iis_values() -> Column:
    return F.filter(F.split("text", " "), lambda v: v != "")


def _iis_starts() -> Column:
    ok = ~F.col("text").startswith("#") & (F.trim("text") != "") & (F.size(_iis_values()) == F.size("iis_fields"))
    return F.coalesce(ok, F.lit(False))


def _iis_match() -> Column:
    """The line's values by field; NULL if their numbers differ."""
    return F.when(_iis_starts(), F.map_from_entries(F.zip_with("iis_fields", _iis_values(), lambda f, v: F.struct(f.alias("key"), v.alias("value")))))


def _iis() -> Fields:
    pairs = F.col("m")
    at = lambda k: N.or_empty(F.try_element_at(pairs, F.lit(k)))
    named = F.map_filter(
        pairs, lambda k, v: ~k.isin("date", "time", "cs-method", "cs-uri-stem", "sc-status", "s-ip") & ((v != "-") | (k == "cs(User-Agent)")),
    )
    named = F.transform_keys(named, lambda k, _: F.when(k == "cs(User-Agent)", "UserAgent").otherwise(k))
    return {
        "parsed": pairs.isNotNull(), "time": N.parse_time(F.concat(at("date"), F.lit(" "), at("time"))), "raw_level": at("sc-status"),
        "level": F.when(at("sc-status") == "", "OTHER").otherwise(N.http_level(at("sc-status"))), "host": at("s-ip"),
        "extra": F.coalesce(named, no_extra()), "message": F.trim(F.concat_ws(" ", at("cs-method"), at("cs-uri-stem"), at("sc-status"))),
    }


def _generic() -> Fields:
    matched = fits(GENERIC)
    # Of the groups that may be the level, or the message, at most one is not empty.
    time = F.when(matched & (g(1) != ""), N.parse_time(g(1))).when(matched, N.parse_time(g(7), F.col("reference")))
    return {
        "time": time, "raw_level": F.when(matched, F.concat(g(2), g(4))).otherwise(""),
        "message": F.when(matched, F.concat(g(3), g(5), g(6), g(8))).otherwise(F.col("text")),
    }


def _xml() -> Fields:
    raise ValueError("event XML is read by records, not lines: see sources.event_xml")


# What a file's sample, its first lines, tells ---------------------------------------------------------------------------


def share(hits: Column) -> Column:
    """Hits in hundredths of the sample's lines."""
    return F.floor(hits * 100 / F.greatest(F.size("sample"), F.lit(1))).cast("int")


def count(test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter("sample", test))


def _csv_profile() -> Column:
    """table (whether the sample is one), delimiter and header."""
    head = F.get("sample", F.lit(0))
    counts = [F.struct(
        (F.length(head) - F.length(F.replace(head, F.lit(d)))).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d"),
    ) for k, d in enumerate(CSV_DELIMITERS)]

    def by(delimiter: Column) -> Column:
        def cells(text: Column) -> Column:
            none = F.when(F.lit(False), F.array().cast("array<string>"))
            return reduce(lambda out, d: out.when(delimiter == d, N.split_cells(text, d)), CSV_DELIMITERS, none)

        def of(header: Column) -> Column:
            named = F.size(F.filter(header, lambda c: F.trim(c).rlike(CSV_NAME))) * 100 >= F.size(header) * 70
            rows = F.slice("sample", 2, 19)
            alike = F.size(F.filter(rows, lambda r: F.size(cells(r)) == F.size(header))) * 100 >= F.size(rows) * 60
            table = delimiter.isNotNull() & (F.size("sample") >= 2) & named & alike
            return F.struct(F.coalesce(table, F.lit(False)).alias("table"), delimiter.alias("delimiter"), header.alias("header"))

        return N.let(cells(head), of)

    return N.let(F.greatest(*counts), lambda best: N.let(F.when(best["n"] > 0, best["d"]), by))


def _csv_score() -> Column:
    return F.when(_csv_profile()["table"], 90).otherwise(0)


def _csv_learn() -> Fields:
    found = _csv_profile()
    return {"csv_delimiter": found["delimiter"], "csv_header": found["header"], "csv_header_line": F.get("sample", F.lit(0))}


def _iis_fields() -> tuple[Column, Column]:
    """The lines that name fields, and the fields of the last of them."""
    heads = F.filter("sample", lambda x: F.lower(x).startswith("#fields:"))
    fields = F.filter(F.split(F.trim(F.substring(F.element_at(heads, -1), 9, 1_000_000)), " "), lambda f: f != "")
    return heads, F.when(F.size(heads) > 0, fields)


def _iis_score() -> Column:
    heads, fields = _iis_fields()
    wide = count(lambda x: ~x.startswith("#") & (F.size(F.filter(F.split(x, " "), lambda v: v != "")) == F.size(fields)))
    return F.when(F.coalesce(F.array_contains(fields, "date"), F.lit(False)), F.least(F.lit(100), share(F.size(heads) * 3 + wide))).otherwise(0)


def _iis_learn() -> Fields:
    return {"iis_fields": _iis_fields()[1]}


def _event_text_score() -> Column:
    blocks, fields = count(lambda x: x.rlike(TIME_CREATED)), count(lambda x: x.rlike(FIELD) & ~x.rlike(TIME_CREATED))
    return F.when(blocks > 0, F.least(F.lit(100), F.floor(blocks * 100 / (blocks + fields)) + 40)).otherwise(0)


def _event_tsv_score() -> Column:
    first = F.get("sample", F.lit(0))
    markers = reduce(lambda a, b: a + b, [F.contains(F.lower(first), F.lit(m.lower())).cast("int") for m in EVENT_HEADER])
    return F.when(
        (F.regexp_count(first, F.lit("\t")) >= 3) & (markers >= 3), 95,
    ).when(share(count(lambda x: x.rlike(EVENT_LEVEL))) >= 50, 80).otherwise(0)


def _event_xml_score() -> Column:
    events = F.aggregate("sample", F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit("<Event ")))
    return F.when(events > 0, F.least(F.lit(100), 70 + F.floor(events / 10))).otherwise(0)


def _generic_learn() -> Fields:
    return {"anchored": count(lambda x: x.rlike(ANCHORS)) > 0}


REGISTRY: list[FormatSpec] = [
    by_pattern("tracing", "tracing", TRACING, _tracing),
    by_pattern("syslog5424", "Syslog (RFC 5424)", SYSLOG5424, _syslog5424),
    by_pattern("syslog3164", "Syslog (RFC 3164)", SYSLOG3164, _syslog3164),
    by_pattern("journalctl_short", "journalctl short", SYSLOG3164, _syslog3164),
    FormatSpec("journal_json", "journal JSON", _json, _json_starts, _journal_probe, _json_match),
    FormatSpec("json_lines", "JSON lines", _json, _json_starts, _json_probe, _json_match),
    FormatSpec("logfmt", "logfmt (key=value)", _logfmt, lambda: F.col("text").rlike(PAIR), _logfmt_probe, _logfmt_match),
    FormatSpec("csv_tsv", "CSV / TSV table", _csv, _csv_starts, match=_csv_match, score=_csv_score, learn=_csv_learn),
    by_pattern("python_logging", "Python logging", PYTHON, _python),
    FormatSpec("serilog", "Serilog", _serilog, lambda: _serilog_line(F.col("text")), _serilog_line, _serilog_match),
    by_pattern("log4j_logback", "Log4j / Logback", LOG4J, _log4j),
    FormatSpec(
        "wevt_text", "Windows event text export", _event_text, lambda: F.col("text").rlike(TIME_CREATED), match=_event_text_match,
        score=_event_text_score, block=True,
    ),
    FormatSpec(
        "wevt_tsv", "Windows event text export (tab separated)", _event_tsv, _event_tsv_starts, match=lambda: F.split("text", "\t"),
        score=_event_tsv_score, sequential=True, block=True,
    ),
    FormatSpec("wevt_xml", "Windows event XML export", _xml, lambda: F.lit(False), score=_event_xml_score, sequential=True),
    FormatSpec("iis_w3c", "IIS W3C log", _iis, _iis_starts, match=_iis_match, score=_iis_score, learn=_iis_learn),
    FormatSpec(
        "generic", "Generic text", _generic, lambda: F.col("text").rlike(ANCHORS) | ~F.coalesce(F.col("anchored"), F.lit(False)),
        lambda text: text.rlike(ANCHORS), lambda: groups(F.col("text"), GENERIC), learn=_generic_learn,
    ),
]


def find_format(id: str) -> FormatSpec:
    for f in REGISTRY:
        if f.id == id:
            return f
    raise ValueError(f"no format is named {id!r}; known: {', '.join(f.id for f in REGISTRY)}")


def register_format(spec: FormatSpec) -> None:
    """Adds a format before the generic one, which stays last."""
    if any(f.id == spec.id for f in REGISTRY):
        raise ValueError(f"{spec.id!r} is registered")
    REGISTRY.insert(len(REGISTRY) - 1, spec)


@contextmanager
def registered(spec: FormatSpec) -> Iterator[FormatSpec]:
    """The format is known inside the block; what was opened there stays as it is."""
    register_format(spec)
    try:
        yield spec
    finally:
        REGISTRY.remove(spec)


def list_formats(spark):
    """id, name and rank of every format."""
    return spark.createDataFrame([(f.id, f.name, k) for k, f in enumerate(REGISTRY)], "id string, name string, rank int")
