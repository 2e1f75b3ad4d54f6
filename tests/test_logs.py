"""Lines, formats, entries and the table of entries, on small texts."""

import datetime
import heapq
import random

import pytest
from pyspark.sql import functions as F

from logspark.functions import normalize as N
from logspark.functions.ansi import strip_control
from logspark.functions.match import Pattern, match_ranges, matches
from logspark.operators import detect, fragments
from logspark.operators import formats as X
from logspark.operators import table as T
from logspark.operators.entries import entries_of_lines, read_logs
from logspark.sources.event_xml import read_event_xml
from logspark.sources.lines import encoding_of, legacy_charsets, lines_from_df, scan_lines

REF = datetime.date(2026, 9, 28)


def lines_of(spark, *texts, names=None):
    rows = [(i, names[i] if names else f"{i}.log", t) for i, t in enumerate(texts)]
    return lines_from_df(spark.createDataFrame(rows, "i int, n string, t string"), F.lit(1), F.col("t"), F.col("i"), F.col("n"))


def parsed(spark, text, **more):
    return entries_of_lines(lines_of(spark, text), reference=REF, **more).orderBy("entry_no").collect()


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("data,lengths", [
    (b"abc\nabc\nabcde\n", [3, 3, 5]), (b"abc\r\nabc\r\n", [3, 3]), (b"abc\rabc\rabcde\r", [3, 3, 5]), (b"a\nb\rc\r\nd", [1, 1, 1, 1]),
    (b"\r\r\nx", [0, 0, 1]), (b"", []), (b"\n\n\n", [0, 0, 0]), (b"x" * 65535 + b"\r\nabcd", [65535, 4]),
])
def test_line_ends(spark, tmp_path, data, lengths):
    (tmp_path / "f.log").write_bytes(data)
    found = scan_lines(spark, [str(tmp_path / "f.log")]).orderBy("line_no").collect()
    assert [len(r["text"]) for r in found] == lengths
    assert [r["line_no"] for r in found] == list(range(1, len(lengths) + 1))


def test_line_limit_and_splits(spark, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc é", k=rng.randint(0, 90))) for _ in range(3000)]
    (tmp_path / "f.log").write_text("\n".join(texts) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = scan_lines(spark, [str(tmp_path / "f.log")]).orderBy("line_no").collect()
        assert [r["text"] for r in got] == texts
        few = scan_lines(spark, [str(tmp_path / "f.log")], max_lines=10).collect()
        assert len(few) == 10 and all(r["truncated"] for r in few)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_all_lines_are_read_unless_a_limit_is_given(spark, tmp_path):
    (tmp_path / "long.log").write_text("x\n" * 2_000_003)
    assert scan_lines(spark, [str(tmp_path / "long.log")]).count() == 2_000_003
    (tmp_path / "few.log").write_text("".join(f"2024-01-02 03:04:{i:02d} INFO line {i}\n" for i in range(20)))
    path = str(tmp_path / "few.log")
    assert "truncated" not in read_logs(spark, path).columns and read_logs(spark, path).count() == 20
    assert [r["truncated"] for r in read_logs(spark, path, max_lines=5).collect()] == [True] * 5
    assert [r["truncated"] for r in read_logs(spark, path, max_lines=50).collect()] == [False] * 20


def test_folding_over_splits(spark, tmp_path):
    rng = random.Random(2)
    lines = [f"2026-01-01 00:00:00 INFO m{i}" if rng.random() < 0.05 else f"  at frame {i}" for i in range(4000)]
    (tmp_path / "f.log").write_text("\n".join(lines))
    expect, held = [], None
    for x in lines:
        if x.startswith("2026"):
            held = [x[25:]]
            expect.append(held)
        elif held:
            held.append(x)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_logs(spark, str(tmp_path / "f.log")).orderBy("entry_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["message"] for r in got] == ["\n".join(x) for x in expect]
    assert [r["entry_no"] for r in got] == list(range(len(expect)))


def test_encodings(spark, tmp_path):
    assert encoding_of("中文日志".encode("gb18030")) == "GB18030"
    assert encoding_of("plain ü".encode()) == "UTF-8"
    assert encoding_of(b"\xff\xfea\x00") == "UTF-16LE" and encoding_of(b"\xfe\xff\x00a") == "UTF-16BE" and encoding_of(b"a\x00b\x00c\x00") == "UTF-16LE"
    legacy_charsets(spark)
    (tmp_path / "g.log").write_bytes("错误 一\n信息 二\n".encode("gb18030"))
    assert [r["text"] for r in scan_lines(spark, [str(tmp_path / "g.log")]).orderBy("line_no").collect()] == ["错误 一", "信息 二"]


# Texts and what they give, which pin rules of escapes, levels, times and formats, down to FORMATS.
@pytest.mark.parametrize("text,plain", [
    ("\x1b[31mred\x1b[0m plain", "red plain"), ("A\x1b[6nB\x1b[?7hC\x1b]0;window title\x07D\x1b[18tE\x1b( BF", "ABCDEF"),
    ("a\rb\x07c\x7fd\x85e", "abcde"), ("abc\x1b[", "abc"), ("abc\x1b", "abc"), ("x\x1bdy", "xy"), ("a\tb\nc", "a\tb\nc"),
])
def test_strip(spark, text, plain):
    assert value(spark, strip_control(F.col("t")), t=text) == plain
    assert fragments.spans_of(text)[0] == plain


def test_spans():
    style = lambda s, *keys: [(x["start"], x["length"], *(x[k] for k in keys)) for x in fragments.spans_of(s)[1]]
    assert style("\x1b[31mred\x1b[0mplain\x1b[1mbold", "fg", "bold") == [(0, 3, 1, False), (8, 4, -1, True)]
    assert style("\x1b[1;4;38;5;196mX\x1b[0m", "bold", "underline", "fg_rgb") == [(0, 1, True, True, "255,0,0")]
    assert style("\x1b[38;2;10;20;30mT\x1b[0m", "fg_rgb") == [(0, 1, "10,20,30")]
    assert style("\x1b[48;5;240mG\x1b[0m", "bg_rgb") == [(0, 1, "88,88,88")]
    assert style("pre \x1b[32mgreen\x1b[0m post", "fg") == [(4, 5, 2)]


def test_levels(spark):
    words = {"INFO": "INFO", "info": "INFO", "[WARN]": "WARN", "ERROR:": "ERROR", "ERR": "ERROR", "FTL": "FATAL", "TRC": "TRACE", "DBG": "DEBUG", "NOTICE": "NOTICE", "CRITICAL": "FATAL", "": "OTHER", "shadowsocks": "OTHER", "I/O": "OTHER", "E-Mail": "OTHER", "traceback": "OTHER", "information": "INFO", "警告": "WARN"}
    got = spark.createDataFrame([(w,) for w in words], ["w"]).select("w", N.normalize_level(F.col("w")).alias("x")).collect()
    assert {r["w"]: r["x"] for r in got} == words


@pytest.mark.parametrize("text,expect", [
    ("2026-09-28T22:15:44.0881187+08:00", "2026-09-28 14:15:44.088"), ("2026-09-28T22:15:43Z", "2026-09-28 22:15:43.000"), ("2026-09-28 22:15:43,303", "2026-09-28 22:15:43.303"),
    ("2026-09-28 1:26:58", "2026-09-28 01:26:58.000"), ("2026-09-28T10:00:00+0800", "2026-09-28 02:00:00.000"), ("22:15:44", "2026-09-28 22:15:44.000"), ("Sep 28 22:15:43", "2026-09-28 22:15:43.000"),
    ("Dec 31 23:59:59", "2025-12-31 23:59:59.000"), ("", None), ("text", None), ("2026-13-45 99:99:99", None), ("2026-09-28T", None),
])
def test_times(spark, text, expect):
    assert value(spark, F.date_format(N.parse_time(F.col("t"), F.lit(REF)), "yyyy-MM-dd HH:mm:ss.SSS"), t=text) == expect


def test_name_dates_and_cells(spark):
    assert value(spark, N.date_of_name(F.col("t")), t="sslocal.2026-09-28.log") == REF
    assert value(spark, N.date_of_name(F.col("t")), t="sslocal.2026-19-28.log") is None
    assert value(spark, N.split_cells(F.col("t"), ","), t='a,"b, ""c""",,d"e,f"g') == ["a", 'b, "c"', "", "de,fg"]


# A text of each format and its fields.
FORMATS = {
    "tracing": ("2026-09-28T22:15:44.0881187+08:00  INFO tokio-rt-worker ThreadId(27) a::b: listening on 127.0.0.1:1081", {"level": "INFO", "thread": "tokio-rt-worker", "target": "a::b", "extra": {"ThreadId": "27"}, "message": "listening on 127.0.0.1:1081"}),
    "syslog5424": ('<34>1 2026-09-28T22:15:43.303587+08:00 myhost app 1234 ID47 [exampleSDID@32473 iut="3"] application event', {"level": "FATAL", "host": "myhost", "target": "app", "pid": "1234", "message": "application event"}),
    "journal_json": ('{"__REALTIME_TIMESTAMP":"1786504543303587","PRIORITY":"6","MESSAGE":"Started unit","_HOSTNAME":"myhost","SYSLOG_IDENTIFIER":"systemd","_PID":"1234"}', {"level": "INFO", "host": "myhost", "target": "systemd", "pid": "1234", "message": "Started unit"}),
    "json_lines": ('{"time":"2026-09-28T22:15:43.303Z","level":"warn","msg":"disk almost full","service":"api","retries":3}', {"level": "WARN", "extra": {"service": "api", "retries": "3"}, "message": "disk almost full"}),
    "logfmt": ('time=2026-09-28T22:15:43Z level=error msg="connection refused" host=db1 retries=3', {"level": "ERROR", "host": "db1", "extra": {"retries": "3"}, "message": "connection refused"}),
    "csv_tsv": ('Time,Level,Logger,Message,EventId\n2026-09-28T22:15:43Z,Error,svc.auth,"login failed, retry",42', {"level": "ERROR", "target": "svc.auth", "extra": {"EventId": "42"}, "message": "login failed, retry"}),
    "python_logging": ("2026-09-28 22:15:43,303 - ERROR - my.module - something failed", {"level": "ERROR", "target": "my.module", "message": "something failed"}),
    "serilog": ("[22:15:44 INF] worker started", {"level": "INFO", "message": "worker started"}),
    "log4j_logback": ("2026-09-28 22:15:43,303 [main] INFO  com.example.App - started", {"level": "INFO", "thread": "main", "target": "com.example.App", "message": "started"}),
    "wevt_text": ("TimeCreated      : 2026-09-28 22:15:43\nProviderName     : demo\nEventId          : 7\nLevelDisplayName : Error\nMessage          : first\n  second", {"level": "ERROR", "target": "demo", "extra": {"EventId": "7"}, "message": "first second"}),
    "wevt_tsv": ("级别\t日期和时间\t来源\t事件 ID\t任务类别\n错误\t2026-09-29 1:26:59\tsrc\t7\t无\t\"two\nlines\"", {"level": "ERROR", "target": "src", "extra": {"Event ID": "7"}, "message": "two\nlines", "first_line": 1}),
    "iis_w3c": ("#Fields: date time s-ip cs-method cs-uri-stem sc-status\n2026-09-28 22:15:44 10.0.0.1 GET /x 500", {"level": "ERROR", "raw_level": "500", "host": "10.0.0.1", "message": "GET /x 500"}),
}


@pytest.mark.parametrize("id", FORMATS)
def test_formats(spark, id):
    text, expect = FORMATS[id]
    r = parsed(spark, text)[0]
    assert r["format_id"] == id and r["time"] is not None
    assert {k: r[k] for k in expect} == expect


def test_syslog_prefix_and_generic(spark):
    a, b = parsed(spark, "Sep 28 22:15:43 myhost sshd[1234]: Accepted publickey for user\nSep 28 22:15:44 myhost cron[77]: ERROR: job failed")
    assert (a["level"], a["pid"], b["level"], b["message"]) == ("OTHER", "1234", "ERROR", "job failed")
    merged = parsed(spark, "2026-09-28 10:00:00 ERROR failed\n  at a\n  at b\n2026-09-28 10:00:01 INFO recovered")
    assert [(r["physical_lines"], r["first_line"]) for r in merged] == [(3, 1), (1, 4)]
    apart = parsed(spark, "2026-09-28 10:00:00 ERROR failed\n  at a\n2026-09-28 10:00:01 INFO recovered", merge_continuations=False)
    assert len(apart) == 3 and apart[1]["level"] == "OTHER"
    assert [r["message"] for r in parsed(spark, "no anchor\nat all")] == ["no anchor", "at all"]


def test_event_xml(spark, tmp_path):
    event = '<Event xmlns="x"><System><Provider Name="p{0}"/><EventID>{0}</EventID><Level>{1}</Level><TimeCreated SystemTime="2026-09-28T00:00:0{0}.5Z"/><Computer>c</Computer></System><EventData><Data Name="k">demo{0}</Data></EventData></Event>'
    (tmp_path / "e.xml").write_text("<Events>" + event.format(1, 4) + "<Event bad</Event>" + event.format(2, 2) + "</Events>")
    got = read_event_xml(spark, [str(tmp_path / "e.xml")]).orderBy("entry_no").collect()
    assert [(r["first_line"], r["level"], r["message"]) for r in got] == [(1, "INFO", "k=demo1"), (2, "ERROR", "k=demo2")]


def test_detection_rules(spark):
    lines = lines_of(spark, FORMATS["tracing"][0], FORMATS["json_lines"][0])
    with pytest.raises(detect.FormatMismatch):
        entries_of_lines(lines)
    with pytest.raises(ValueError):
        X.find_format("nonsense")
    assert X.list_formats(spark).count() == 16


def five(spark):
    rows = [("DEBUG", "started plugin listener"), ("INFO", "best TCP server chosen"), ("WARN", "slow tunnel detected"), ("ERROR", "connection reset"), ("ERROR", "connection closed")]
    return entries_of_lines(lines_of(spark, "\n".join(f"2026-09-28 10:00:0{i} {level} {m}" for i, (level, m) in enumerate(rows))), "generic")


def test_filters_and_find(spark):
    e = five(spark)
    at = lambda **k: [r["entry_no"] for r in T.apply_filter(e, T.FilterSpec(**k)).orderBy("entry_no").collect()]
    assert at(levels=frozenset(["ERROR"])) == [3, 4]
    assert at(pattern=Pattern("connection")) == [3, 4] and at(pattern=Pattern("connection"), invert=True) == [0, 1, 2]
    assert at(start=datetime.datetime(2026, 9, 28, 10, 0, 2), end=datetime.datetime(2026, 9, 28, 10, 0, 3)) == [2, 3]
    assert at(levels=frozenset(["ERROR", "WARN"]), pattern=Pattern("connection*", "wildcard")) == [3, 4]
    assert at(pattern=Pattern("  ")) == [0, 1, 2, 3, 4]
    assert [(r["entry_no"], r["ordinal"], r["next"]["entry_no"], r["previous"]["entry_no"]) for r in T.navigate(e, Pattern("connection")).orderBy("ordinal").collect()] == [(3, 1, 4, 4), (4, 2, 3, 3)]
    assert {r["level"]: r["n"] for r in T.level_counts(e).collect()} == {"TRACE": 0, "DEBUG": 1, "INFO": 1, "NOTICE": 0, "WARN": 1, "ERROR": 2, "FATAL": 0, "OTHER": 0}
    assert T.infer_columns(e) == ["line", "time", "level", "message"]
    assert T.time_preset("15m", datetime.datetime(2026, 1, 1, 1))[0] == datetime.datetime(2026, 1, 1, 0, 45)


@pytest.mark.parametrize("pattern,text,expect", [
    (Pattern("ERROR"), "ERRORS XERROR", False), (Pattern("ERROR"), "an error.", True), (Pattern("a.b"), "axb", False), (Pattern("连接"), "无法连接服务器", True),
    (Pattern("conn*tion", "wildcard"), "connection", True), (Pattern("por?", "wildcard"), "port", True), (Pattern("a*c", "wildcard"), "a/c", False), (Pattern(r"ThreadId\(\d+\)", "regex"), "ThreadId(27)", True), (Pattern("ä"), "Ä", True),
])
def test_patterns(spark, pattern, text, expect):
    assert value(spark, matches(F.col("t"), pattern), t=text) is expect


def test_pattern_problems_and_ranges(spark):
    assert Pattern("([unclosed", "regex").problem(spark) and Pattern("x" * 513).problem(spark) and not Pattern("").problem(spark)
    assert [tuple(r) for r in value(spark, match_ranges(F.col("t"), Pattern("ab")), t="ab cd ab")] == [(0, 2), (6, 2)]


def test_merge_is_a_merge_of_heads(spark, monkeypatch):
    rng = random.Random(3)
    for segment, stepping in ((100_000, True), (3, True), (3, False)):
        monkeypatch.setattr(T, "SEGMENT", segment)
        sources = [[rng.randint(0, 9) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        # Sorted runs, the last of which steps back as a whole; or none in order.
        sources = sources if stepping else [sorted(s) for s in sources[:2]] + [[5, 6, 7, 1, 2, 3, 8, 9]]
        expect, heads = [], [(s[0], i, 0) for i, s in enumerate(sources)]
        heapq.heapify(heads)
        while heads:
            _, i, k = heapq.heappop(heads)
            expect.append((i, k))
            if k + 1 < len(sources[i]):
                heapq.heappush(heads, (sources[i][k + 1], i, k + 1))
        texts = ["\n".join(f"2026-09-28 10:00:0{t} INFO m" for t in s) for s in sources]
        merged, timed = T.merge_documents(entries_of_lines(lines_of(spark, *texts), "generic"))
        assert timed and [(r["source_idx"], r["entry_no"]) for r in merged.collect()] == expect


def test_snippets_and_export(spark, tmp_path):
    kinds = lambda s: [k for k, _, _ in fragments.snippets_of(s)]
    assert kinds('proxy config = {"server":"23.105.206.76","port":9684,"tls":false}') == ["json"]
    for none in ("value { }", "open { unterminated", "ServerStatData { }", "a < b and c > d", "value: 1", "http://example.com"):
        assert kinds(none) == []
    assert kinds('<request version="5"><command>CONNECT</command></request>') == ["xml"]
    assert kinds("server:\n  host: a\n  port: 1\n") == ["yaml"]
    assert len(kinds('{"a":1,"b":2} ' * 10)) == 4
    assert [k for k, _, _ in fragments.tokens_of("json", '{"port":9684,"tls":false,"s":"x"}') if k != "Punctuation"] == ["Key", "Number", "Key", "Constant", "Key", "String"]
    e = five(spark)
    T.write_csv(e, ["line", "level", "message"], str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert '"1","DEBUG","started plugin listener"\n' in text
    T.write_text(e, ["line", "message"], str(tmp_path / "txt"))
    assert "5\tconnection closed" in "".join(p.read_text() for p in (tmp_path / "txt").glob("part-*"))


@pytest.mark.parametrize("encoding,mark", [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-16-le", b""), ("utf-16-be", b"")])
def test_wide_files(spark, tmp_path, encoding, mark):
    legacy_charsets(spark)
    texts = ["2026-01-01 00:00:00 ERROR größer 错误", "  at x", "", "2026-01-01 00:00:01 INFO ok"]
    (tmp_path / "w.log").write_bytes(mark + "\r\n".join(texts).encode(encoding))
    assert [r["text"] for r in scan_lines(spark, [str(tmp_path)]).orderBy("line_no").collect()] == texts
    got = read_logs(spark, [str(tmp_path)]).orderBy("entry_no").collect()
    assert [(r["level"], r["message"], r["first_line"]) for r in got] == [("ERROR", "größer 错误\n  at x\n", 1), ("INFO", "ok", 4)]


@pytest.mark.parametrize("split", [300, 1000, 1 << 20])
def test_entries_over_splits(spark, tmp_path, split):
    """Entries, some longer than a split of their file, whatever the splits."""
    rng = random.Random(split)
    for name in ("a", "b"):
        lines, expect = ["before the first entry"], []
        for k in range(60):
            more = [f"  more {j} " + "x" * rng.randint(0, 60) for j in range(rng.choice([0, 0, 0, 1, 3, 25]))]
            expect.append((name + ".log", k, len(lines) + 1, len(more) + 1, "\n".join([f"entry {k}", *more])))
            lines += [f"2026-01-01 00:00:{k:02d} INFO entry {k}", *more]
        (tmp_path / f"{name}.log").write_text("\n".join(lines) + "\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            every = read_logs(spark, [str(tmp_path)]).where(F.col("source_name") == name + ".log").orderBy("entry_no").collect()
            cut = read_logs(spark, [str(tmp_path / f"{name}.log")], max_lines=40).orderBy("entry_no").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [(r["source_name"], r["entry_no"], r["first_line"], r["physical_lines"], r["message"]) for r in every] == expect
        assert all(r["truncated"] for r in cut) and sum(r["physical_lines"] for r in cut) == 39


def test_a_registered_format_scores_and_learns(spark):
    """A format of one's own, with a score over the sample and a word that it learns from the head."""
    spec = X.FormatSpec(
        "own", "Own", lambda: {"parsed": F.size("m") == 2, "raw_level": F.get("m", F.lit(0)), "message": F.concat(F.get("m", F.lit(1)), F.lit(" of "), F.col("who"))},
        lambda: F.col("text").startswith("@"), match=lambda: F.split(F.substring("text", 2, 1000), "@"),
        score=lambda: F.when(F.col("sample")[0].startswith("#own "), 99).otherwise(0), learn=lambda: {"who": F.substring(F.col("sample")[0], 6, 100)})
    X.register_format(spec)
    try:
        with pytest.raises(ValueError):
            X.register_format(spec)
        got = parsed(spark, "#own me\n@WARN@one\nmore\n@INFO@two")
        assert [(r["format_id"], r["level"], r["message"]) for r in got] == [("own", "WARN", "one of me\nmore"), ("own", "INFO", "two of me")]
        assert [r["id"] for r in X.list_formats(spark).orderBy("rank").collect()][-2:] == ["own", "generic"]
    finally:
        X.REGISTRY.remove(spec)
    with pytest.raises(detect.FormatMismatch):
        entries_of_lines(lines_of(spark, "2026-01-01T00:00:00Z  INFO w ThreadId(1) a: b", '{"time": 1, "message": "x"}'))


def test_fragments_that_json_and_yaml_take():
    kinds = lambda t: [k for k, _, _ in fragments.snippets_of(t)]
    assert kinds("{ one, two }") == ["json"] and kinds("[alpha, beta, gamma]") == ["json"]
    assert kinds("a: 1\nb: 2") == ["yaml"] and kinds("a:\nb:") == []
    assert len(fragments.snippets_of("<b>" * 20_000 + "{" * 20_000)) == 0
