"""Following files: appended lines, unfinished lines, truncation, entries that grow."""

import json
import random
import time

import pyarrow as pa
import pytest

from logspark.operators.table import FilterSpec, apply_filter
from logspark.plans import queries
from logspark.sources.lines import read_heads
from logspark.streaming import follow


def wait_for(test, seconds=90):
    until = time.time() + seconds
    while not test():
        assert time.time() < until
        time.sleep(0.5)


def run(spark, folder, name, entries, mode="append"):
    q = entries.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/checkpoint-{name}").start()
    return q


def test_tail_reader(tmp_path):
    f = tmp_path / "a.log"
    f.write_bytes(b"one\ntwo\npar")
    r = follow.TailReader(str(tmp_path / "*.log"))
    read = lambda a, b: [(x[1], x[2], x[3]) for p in r.partitions(a, b) for x in r.read(p)]
    first = r.latestOffset()
    got = read(r.initialOffset(), first)
    assert [x[1:] for x in got] == [(0, "one"), (4, "two")]
    with f.open("ab") as g:
        g.write(b"tial line\r\nx\r")
    # A reader of a query that starts again goes on where the offset says.
    r = follow.TailReader(str(tmp_path / "*.log"))
    second = r.latestOffset()
    assert read(first, second) == [(got[0][0], 8, "partial line")] and read(second, r.latestOffset()) == []
    # A replaced file is read from its beginning, as another generation, also if it is larger.
    f.write_bytes(b"new\n" * 20)
    third = r.latestOffset()
    found = read(second, third)
    assert [x[1:] for x in found] == [(4 * k, "new") for k in range(20)] and found[0][0] != got[0][0]
    f.write_bytes(b"new\n")
    assert [x[2] for x in read(third, r.latestOffset())] == ["new"]
    f.write_bytes(b"unfinished")
    assert json.loads(r.latestOffset()["files"]) == {}


def lines_of(reader, a, b):
    return [(x[2], x[3]) for p in reader.partitions(a, b) for x in reader.read(p)]


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be", "gb18030", "utf-8"])
def test_tail_in_any_encoding(tmp_path, encoding):
    f = tmp_path / "a.log"
    texts = ["错误 一", "Ā\u0a15 ok", "", "信息 三"] * 30
    mark = "\ufeff" if encoding.startswith("utf-16") else ""
    f.write_bytes((mark + "".join(t + "\r\n" for t in texts) + "open").encode(encoding))
    r = follow.TailReader(f.as_uri())
    assert [t for _, t in lines_of(r, r.initialOffset(), r.latestOffset())] == texts


def test_tail_in_bounded_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(follow, "LOOK", 8)
    monkeypatch.setattr(follow, "RANGE", 50)
    (tmp_path / "logs" / "x").mkdir(parents=True)
    lines = {name: [f"{name} {k} " + "y" * (k * 7 % 90) for k in range(60)] for name in ("a.log", "b.log")}
    for name, own in lines.items():
        (tmp_path / "logs" / "x" / name).write_text("\n".join(own) + "\n")
    (tmp_path / "logs" / "other.log").write_text("not asked for\n")
    pattern, progress = (tmp_path / "logs" / "*" / "*.log").as_uri(), (tmp_path / "progress").as_uri()
    r = follow.TailReader(pattern, 100, progress)
    at, got, batches = r.initialOffset(), {}, 0
    while (to := r.latestOffset()) != at:
        batches += 1
        parts = r.partitions(at, to)
        assert all(p.end - p.start <= 150 for p in parts) and sum(p.end - p.start for p in parts) < 600
        for p in parts:
            for name, _, _, text in r.read(p):
                got.setdefault(name, []).append(text)
        at = to
        if batches % 5 == 0:
            # A new reader goes on from what was noted, which may be the batch before.
            r = follow.TailReader(pattern, 100, progress)
        else:
            r.commit(at)
    assert got == lines and batches > 20


def test_an_entry_over_many_batches(spark, tmp_path):
    f = tmp_path / "long.log"
    f.write_text("2026-01-01 00:00:00 ERROR failed\n" + "".join(f"  at {k}\n" for k in range(3000)) + "2026-01-01 00:00:01 INFO open\n")
    entries = follow.follow_entries(follow.tail(spark, f.as_uri(), 1000, (tmp_path / "progress").as_uri()), "generic", 600_000)
    q = run(spark, tmp_path, "long_entry", entries)
    try:
        wait_for(lambda: spark.table("long_entry").count() >= 1)
        batches = q.lastProgress["batchId"]
        r = spark.table("long_entry").first()
    finally:
        q.stop()
    assert r["message"] == "failed\n" + "\n".join(f"  at {k}" for k in range(3000)) and r["physical_lines"] == 3001 and batches > 20


def test_counts_after_truncation(spark, tmp_path):
    f = tmp_path / "a.log"
    (tmp_path / "b.log").write_text("2026-01-01 00:00:00 WARN kept\n2026-01-01 00:00:01 INFO open\n")
    f.write_text("2026-01-01 00:00:00 ERROR one\n  more\n2026-01-01 00:00:01 WARN two\n2026-01-01 00:00:01 INFO open\n")
    entries = follow.follow_entries(follow.tail(spark, (tmp_path / "*.log").as_uri()), "generic", 600_000)
    q = run(spark, tmp_path, "changes", follow.level_changes(entries))
    counts = lambda: {r["level"]: r["n"] for r in follow.counts_of_changes(spark.table("changes")).collect()}
    try:
        wait_for(lambda: counts() == {"ERROR": 1, "WARN": 2})
        f.write_text("2026-01-02 00:00:00 FATAL new\n2026-01-02 00:00:01 INFO open\n")
        wait_for(lambda: counts() == {"FATAL": 1, "WARN": 1})
        f.write_text("2026-01-03 00:00:00 DEBUG newer\n2026-01-03 00:00:00 DEBUG newest\n2026-01-03 00:00:01 INFO open\n")
        wait_for(lambda: counts() == {"DEBUG": 2, "WARN": 1})
    finally:
        q.stop()


def test_follow_folds_across_batches(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    f = logs / "a.log"
    f.write_text("2026-01-01 00:00:00 ERROR failed\n  at a\n")
    q = run(spark, tmp_path, "followed", follow.follow_entries(follow.tail(spark, str(logs / "*.log")), "generic", 600_000))
    try:
        wait_for(lambda: sum(p["numInputRows"] for p in q.recentProgress) >= 2)
        with f.open("a") as g:
            g.write("  at b\n2026-01-01 00:00:01 INFO ok\n2026-01-01 00:00:02 WARN open\n")
        wait_for(lambda: spark.table("followed").count() >= 2)
        got = [(r["entry_no"], r["first_line"], r["level"], r["message"]) for r in spark.table("followed").orderBy("entry_no").collect()]
    finally:
        q.stop()
    assert got == [(0, 1, "ERROR", "failed\n  at a\n  at b"), (1, 4, "INFO", "ok")]


def test_follow_tables_and_start(spark, tmp_path):
    logs = tmp_path / "tables"
    logs.mkdir()
    (logs / "a.csv").write_text("Time,Level,Message\n2026-01-01T00:00:00Z,WARN,one\n2026-01-01T00:00:01Z,INFO,two\n")
    (logs / "b.csv").write_text("Time;Level;Message\n2026-01-01T00:00:02Z;ERROR;three\n")
    heads = read_heads(spark, [str(logs)])
    entries = follow.follow_entries(follow.tail(spark, str(logs / "*.csv")), "csv_tsv", 500, heads)
    q = follow.start(apply_filter(entries, FilterSpec(frozenset(["WARN", "ERROR"]))), "memory", str(tmp_path / "checkpoint"), "tables")
    try:
        wait_for(lambda: spark.table("tables").count() == 2)
        got = {(r["source_name"], r["level"], r["message"]) for r in spark.table("tables").collect()}
    finally:
        q.stop()
    assert got == {("a.csv", "WARN", "one"), ("b.csv", "ERROR", "three")}
    with pytest.raises(ValueError):
        follow.follow_entries(follow.tail(spark, str(logs / "*.csv")), "csv_tsv")


def test_all_that_is_there_in_bounded_batches(spark, tmp_path):
    """A file of many batches is read to its end, no batch being larger than asked for; a stream that goes on later does so from where it stood."""
    state, f = str(tmp_path / "state"), tmp_path / "logs" / "a.log"
    f.parent.mkdir()
    lines = lambda a, b: "".join(f"2026-01-01 00:00:00 INFO m{i}\n  at {i}\n\n" for i in range(a, b))
    entries = lambda: follow.follow_entries(follow.tail(spark, f.as_uri(), 2000, (tmp_path / "progress").as_uri()), "generic", 3_600_000)
    want = lambda n: [(i, 3 * i + 1, 3, f"m{i}\n  at {i}\n") for i in range(n)]
    for n, batches in ((600, 12), (900, 18)):
        with f.open("a") as g:
            g.write(lines(0 if n == 600 else 600, n))
        got = queries.stream_rows(spark, entries(), "append", state=state, bounded=True).orderBy("entry_no").collect()
        assert [(r["entry_no"], r["first_line"], r["physical_lines"], r["message"]) for r in got] == want(n - 1)
        assert len([x for x in (tmp_path / "state" / "checkpoint" / "commits").iterdir() if x.name.isdigit()]) >= batches


def test_chunks_are_put_in_order(monkeypatch):
    monkeypatch.setattr(follow, "CHUNK", 60)
    rng = random.Random(5)
    rows = [(name, 7, 10 * k, "" if k % 9 == 0 else f"{name} {k}", k % 4 == 0) for name in "ab" for k in range(80)]
    names = ["file", "generation", "position", "text", "start"]
    for shuffled in (False, True):
        if shuffled:
            rng.shuffle(rows)
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 30]]) for k in range(0, len(rows), 30)]
        chunks = [r for b in follow._chunked(iter(batches)) for r in b.to_pylist()]
        assert len(chunks) > 8
        for name in "ab":
            own = [(c["position"], c["positions"], c["starts"], c["texts"]) for c in chunks if c["file"] == name]
            got = [(t, bool(s)) for texts, starts in follow._in_order(own) for t, s in zip(texts, starts, strict=True)]
            assert got == [(r[3], r[4]) for r in sorted(rows) if r[0] == name]
