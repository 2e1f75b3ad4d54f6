"""Opening files: splits that change, files that grow, long lines, wide event XML, styles, and what is read of large files."""

import random

import pytest
from pyspark.sql import functions as F

from logspark.functions.match import Pattern, literal, matches
from logspark.operators import fragments
from logspark.operators import table as T
from logspark.operators.entries import entries_of_lines, open_logs, read_logs
from logspark.plans import queries
from logspark.sources import lines as L
from logspark.sources.event_xml import parsed_events, read_event_xml

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def splits(spark):
    """Sets the bytes of a split."""
    keys = [SPLIT, "spark.sql.files.openCostInBytes"]

    def set_(n):
        spark.conf.set(SPLIT, str(n))
        spark.conf.set(keys[1], "1")

    yield set_
    for k in keys:
        spark.conf.unset(k)


def log(n, first=0):
    return "".join(f"2026-01-01 00:00:00 INFO m{i}\n  at frame {i}\n" for i in range(first, first + n))


def test_entries_dont_hang_on_splits(spark, tmp_path, splits):
    f = tmp_path / "a.log"
    f.write_text(log(4000))
    splits(20_000)
    entries, lines = read_logs(spark, str(f)), L.scan_lines(spark, [str(f)])
    splits(33_000)
    got = entries.orderBy("entry_no").collect()
    assert [(r["entry_no"], r["first_line"], r["message"]) for r in got] == [(i, 2 * i + 1, f"m{i}\n  at frame {i}") for i in range(4000)]
    assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == list(range(1, 8001))
    # What is appended after opening is not seen, in whole or in part.
    with f.open("a") as g:
        g.write(log(2000, 4000))
    assert entries.count() == 4000 and lines.count() == 8000
    assert read_logs(spark, str(f)).count() == 6000


def test_pieces_over_blocks_and_files(spark, tmp_path, splits):
    r = random.Random(4)
    want = {}
    for name in "abc":
        lines, held = [], []
        for i in range(3000):
            start = i == 2 or r.random() < (0.002 if name == "a" else 0.3)
            lines.append(f"2026-01-01 00:00:00 INFO {name}{i}" if start else f"  at {i}" * r.randint(1, 4))
            if start:
                held.append([len(lines), f"{name}{i}"])
            elif held:
                held[-1].append(lines[-1])
        (tmp_path / f"{name}.log").write_text("\n".join(lines))
        want |= {(name, k): (x[0], len(x) - 1, "\n".join(x[1:])) for k, x in enumerate(held)}
    splits(5_000)
    opened = open_logs(spark, [str(tmp_path / "c.log"), str(tmp_path)])
    found = {(r["source_name"][0], r["entry_no"]): (r["first_line"], r["physical_lines"], r["message"]) for r in opened.entries.collect()}
    assert found == want
    assert {r["source_name"]: r["source_idx"] for r in opened.entries.select("source_name", "source_idx").distinct().collect()} == {"c.log": 0, "a.log": 1, "b.log": 2}
    for n in (1, 7):
        some = {(r["source_name"][0], r["entry_no"]): (r["first_line"], r["physical_lines"], r["message"]) for r in opened.first(n).collect()}
        assert some == {k: v for k, v in want.items() if k[1] < n}


def read_bytes(spark):
    every = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(x.getBytesRead() for x in every)


def test_a_line_of_any_length_is_looked_at_by_its_beginning(spark, tmp_path):
    event = '<Event xmlns="u"><System><Provider Name="p"/><EventID>7</EventID><Level>2</Level><TimeCreated SystemTime="2026-01-01T00:00:00Z"/></System></Event>'
    with (tmp_path / "one [line], long.xml").open("w") as f:
        for _ in range(1300):
            f.write(event * 1000)
    (tmp_path / "small.log").write_text(log(5))
    before = read_bytes(spark)
    heads = {r["source_name"]: r for r in L.read_heads(spark, [str(tmp_path)]).collect()}
    # Besides, 256 kB of the large file by Arrow.
    assert read_bytes(spark) - before < 1 << 20
    assert heads["one [line], long.xml"]["sample"][0].startswith(event) and len(heads["one [line], long.xml"]["sample"]) == 1
    assert len(heads["small.log"]["sample"]) == 10


def test_names_that_look_like_patterns(spark, tmp_path):
    (tmp_path / "a [1] {x} é.log").write_text(log(3))
    (tmp_path / "a 1 x é.log").write_text(log(2))
    got = read_logs(spark, str(tmp_path)).groupBy("source_name").count().collect()
    assert {r["source_name"]: r["count"] for r in got} == {"a [1] {x} é.log": 3, "a 1 x é.log": 2}


def test_heads_where_arrow_opens_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text(log(9))
    monkeypatch.setattr(L, "RANGED", 10)
    monkeypatch.setattr(L, "_ranged", lambda batches: iter([]))
    assert len(L.read_heads(spark, [str(tmp_path)]).first()["sample"]) == 18
    assert L.first_bytes("viewfs://store/in/x", 5) is None and L.first_bytes(f"file:{tmp_path}/a.log", 4) == L.first_bytes(f"file://{tmp_path}/a.log", 4) == b"2026"


def test_heads_of_ranges():
    assert L.head_of(b"a\r\nb\rc", False) == ("UTF-8", ["a", "b"]) and L.head_of(b"abc", False) == ("UTF-8", ["abc"])
    assert L.head_of("﻿ä\r\nb\nc".encode("utf-16-le"), False) == ("UTF-16LE", ["ä", "b"])
    assert L.head_of("中文\n日志\n".encode("gb18030"), True) == ("GB18030", ["中文", "日志"])


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le", "utf-16-be", "gb18030"])
def test_event_xml_in_any_encoding(spark, tmp_path, splits, encoding):
    def event(i):
        return f'<Event xmlns="u"><System><Provider Name="p"/><EventID>{i}</EventID><Level>4</Level></System><RenderingInfo><Message>信息 {i}</Message></RenderingInfo></Event>'

    text = "﻿" * encoding.startswith("utf-16") + "<Events>" + "".join(event(i) + ("\r\n" if i % 7 == 6 else "") for i in range(500)) + "<Event broken</Event></Events>"
    (tmp_path / "e.xml").write_bytes(text.encode(encoding))
    splits(7_001)
    entries = read_logs(spark, str(tmp_path / "e.xml"))
    splits(50_000)
    got = entries.orderBy("entry_no").collect()
    assert [(r["entry_no"], r["first_line"], r["message"], r["extra"]["Event ID"], r["format_id"]) for r in got] == [(i, i + 1, f"信息 {i}", str(i), "wevt_xml") for i in range(500)]
    few = read_logs(spark, str(tmp_path / "e.xml"), max_lines=3).collect()
    assert sorted(r["entry_no"] for r in few) == list(range(21)) and all(r["truncated"] for r in few)
    assert not read_event_xml(spark, [str(tmp_path / "e.xml")], max_lines=1000).first()["truncated"]


def test_styles_of_entries(spark, tmp_path):
    (tmp_path / "s.log").write_text("2026-01-01 00:00:00 INFO \x1b[31mred\nstill\x1b[0m not\n2026-01-01 00:00:01 \x1b[1mWARN\x1b[0m plain\n2026-01-01 00:00:02 INFO none\n")
    entries = read_logs(spark, str(tmp_path / "s.log"), styles=True)
    got = [(r["entry_no"], r["start"], r["length"], r["fg"], r["bold"]) for r in fragments.entry_spans(entries).collect()]
    assert got == [(0, 0, 9, 1, False)] and [r["message"] for r in entries.orderBy("entry_no").collect()] == ["red\nstill not", "plain", "none"]


def test_first_entries_read_little(spark, tmp_path, splits):
    r = random.Random(1)
    with (tmp_path / "large.log").open("w") as f:
        for i in range(400_000):
            f.write(f"2026-01-01 00:00:00 INFO {r.getrandbits(400):x} {i}\n")
    splits(4 << 20)
    opened = open_logs(spark, str(tmp_path / "large.log"))
    before = read_bytes(spark)
    assert T.infer_columns(opened) == ["line", "time", "level", "message"] and T.can_time_merge(opened)
    # The folded lines are about 25 MB as they are written.
    assert read_bytes(spark) - before < 6 << 20


def test_navigation_over_segments(spark, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 10)
    r = random.Random(3)
    rows = [(s, i, "hit" if r.random() < 0.1 else "no") for s in range(3) for i in range(200)]
    hits = [(s, i) for s, i, m in rows if m == "hit"]
    got = T.navigate(spark.createDataFrame(rows, "source_idx int, entry_no long, message string"), Pattern("hit"), ["message"])
    found = {r["ordinal"]: ((r["source_idx"], r["entry_no"]), tuple(r["next"]), tuple(r["previous"])) for r in got.collect()}
    assert found == {k + 1: (h, hits[(k + 1) % len(hits)], hits[k - 1]) for k, h in enumerate(hits)}
    assert tuple(T.nth_hit(got, 5).first()) == hits[4]
    one = T.navigate(spark.createDataFrame([(0, 4, "hit")], "source_idx int, entry_no long, message string"), Pattern("hit"), ["message"]).first()
    assert tuple(one["next"]) == tuple(one["previous"]) == (0, 4)


def test_the_cheap_test_lets_every_match_through(spark):
    cells = ["Kit sin", "Kit ſin", "KİT", "kıt", "kit", "KIT.", "skit", "éKIT", "", "ki t", "kıt sın"]
    for text in ("kit", "KIT", "sin", "é", "kit sin"):
        for sensitive in (False, True):
            p = Pattern(text, case_sensitive=sensitive)
            got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", matches(F.col("c"), p).alias("a"), F.col("c").rlike(p.regex).alias("b")).collect()
            assert all(r["a"] == r["b"] for r in got)
    assert literal(F.col("c"), Pattern("a*", "wildcard")) is None


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le"])
def test_small_splits_share_tasks(spark, tmp_path, splits, encoding):
    xml = '<Event xmlns="u"><System><Provider Name="p"/><EventID>{}</EventID><Level>4</Level></System></Event>'
    (tmp_path / "e.xml").write_bytes("".join(xml.format(i) for i in range(1500)).encode(encoding))
    (tmp_path / "a.log").write_bytes(log(1500).encode(encoding))
    splits(2_001)
    for name, want in (("e.xml", [(i, i + 1) for i in range(1500)]), ("a.log", [(i, 2 * i + 1) for i in range(1500)])):
        heads = L.read_heads(spark, [str(tmp_path / name)])
        placed, _ = L.placed_lines(spark, heads, separator="</Event>" if name == "e.xml" else None)
        # Blocks are the splits; tasks, and with them the files that they write, are few.
        assert placed.select("block").distinct().count() > 20 and placed.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        entries = read_logs(spark, str(tmp_path / name))
        assert len(entries.inputFiles()) < 20
        assert [(r["entry_no"], r["first_line"]) for r in entries.orderBy("entry_no").collect()] == want


def test_an_event_is_parsed_once(spark):
    records = spark.createDataFrame([(0, "e.xml", 0, 0, "<Event ")], "source_idx int, source_name string, block long, position long, xml string")
    plan = parsed_events(records)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("from_xml(") + plan.count("xmltostructs(") == 1


def test_files_of_names_are_sorted_by_many_tasks(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("n"), F.col("id") % 2, F.lit(".log")).alias("name"), (5000 - F.col("id")).alias("at"), F.col("id").cast("string").alias("value"))
    before, most = spark.conf.get("spark.sql.adaptive.enabled"), []
    made = queries._appended
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        queries._appended = lambda folder: most.append(len(list((tmp_path.__class__(folder.removeprefix("file://"))).glob("name=*/part-*")))) or made(folder)
        for _ in range(2):
            queries.named_files(spark, rows, f"file://{tmp_path}/logs")
    finally:
        queries._appended = made
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert min(most) >= 4 and sorted(x.name for x in (tmp_path / "logs").iterdir()) == ["n0.log", "n1.log"]
    for k in (0, 1):
        assert (tmp_path / "logs" / f"n{k}.log").read_text() == "".join(f"{i}\n" for i in reversed(range(k, 4000, 2)))


def test_a_table_is_rendered_twice_however_often_it_is_read(spark):
    seen = spark.sparkContext.accumulator(0)

    def render(i):
        seen.add(1)
        return f'time=2026-01-01T00:00:{i % 60:02d}Z level=info msg="m {i}" user="{i}'

    rows = spark.range(300).select("id", F.udf(render, "string")("id").alias("t"))
    entries = entries_of_lines(L.lines_from_df(rows, F.col("id"), F.col("t"), F.col("id") % 3, segment=F.floor(F.col("id") / 50)))
    merged, timed = T.merge_documents(entries)
    assert timed and merged.count() == 300
    # The open quote is no end of a value.
    assert {(r["message"], r["extra"]["user"]) for r in entries.collect()} == {(f"m {i}", f'"{i}') for i in range(300)}
    # Sizes are summed in one reading and lines written in another.
    assert seen.value == 600


def test_tasks_grow_with_a_table():
    assert L.sort_tasks(None, 0) == 1 and L.sort_tasks(0, 10 * L.SORT_ROWS) == 10 and L.sort_tasks(L.SORT_BYTES * 5 + 1, 7) == 6
